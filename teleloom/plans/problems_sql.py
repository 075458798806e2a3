"""DuckDB SQL with the results of the queries in ``problems``, where SQL can express them."""

from __future__ import annotations

#: A row of spans with ids in normal form; reused below.
_IDS = """ids AS (
  SELECT arrival_seq,
    CASE WHEN ltrim(coalesce(trace_id, ''), '0') = '' THEN '' ELSE lower(trim(trace_id)) END AS t,
    CASE WHEN ltrim(coalesce(span_id, ''), '0') = '' THEN '' ELSE lower(trim(span_id)) END AS s,
    CASE WHEN ltrim(coalesce(parent_span_id, ''), '0') = '' THEN '' ELSE lower(trim(parent_span_id)) END AS p
  FROM spans),
firsts AS (
  SELECT t, s, p FROM (
    SELECT t, s, p, row_number() OVER (PARTITION BY t, s ORDER BY arrival_seq) AS rn FROM ids WHERE t <> '' AND s <> '') AS x
  WHERE rn = 1)"""

_TREE = f"""WITH RECURSIVE {_IDS},
tree AS (
  SELECT f.t, f.s, f.s AS root, CAST(0 AS BIGINT) AS depth, f.s AS path
  FROM firsts AS f LEFT JOIN firsts AS q ON f.t = q.t AND f.p = q.s
  WHERE q.s IS NULL
  UNION ALL
  SELECT f.t, f.s, tree.root, tree.depth + 1, tree.path || '/' || f.s
  FROM firsts AS f JOIN tree ON f.t = tree.t AND f.p = tree.s)"""

_READINGS = """readings AS (
  SELECT service_name, metric_name, instance_id, value, ts_ns // 60000000000 AS slot FROM metric_points
  WHERE metric_type = 'Gauge' AND value IS NOT NULL AND isfinite(value) AND ts_ns IS NOT NULL AND ts_ns <> 0
    AND instance_id IS NOT NULL AND service_name IS NOT NULL AND metric_name IS NOT NULL)"""

_LATE = """rows_ AS (
  SELECT coalesce(service_name, '') AS service_name, coalesce(nullif(ts_ns, 0), nullif(observed_ts_ns, 0)) AS e,
    coalesce(nullif(observed_ts_ns, 0), nullif(ts_ns, 0)) AS a, coalesce(severity_number, 0) >= 17 AS bad FROM logs),
placed AS (
  SELECT *, e // 600000000000 * 600000000000 AS period_ns, a // 600000000000 * 600000000000 AS arrival_period_ns
  FROM rows_ WHERE e IS NOT NULL),
judged AS (SELECT *, a < period_ns + 7800000000000 AS ok FROM placed)"""

#: Every value of a payload by kind: spans, events, attribute sets, and below these plain and typed values.
_WALK = r"""WITH RECURSIVE walk AS (
  SELECT payload_id, 'top' AS kind, CAST(-1 AS INT) AS si, CAST(-1 AS INT) AS ei, '' AS path, CAST(payload AS JSON) AS j
  FROM trace_payloads WHERE payload IS NOT NULL AND json_valid(payload)
  UNION ALL
  SELECT payload_id, n.kind, n.si, n.ei, n.path, n.j FROM (
    SELECT payload_id, unnest(CASE
      WHEN kind IN ('top', 'spans', 'events', 'set') AND json_type(j) = 'VARCHAR' THEN
        CASE WHEN json_valid(j ->> '$') THEN [{'kind': kind, 'si': si, 'ei': ei, 'path': path, 'j': CAST(j ->> '$' AS JSON)}] END
      WHEN kind = 'top' AND json_type(j) = 'OBJECT' THEN [{'kind': 'spans', 'si': si, 'ei': ei, 'path': path, 'j': j -> 'spans'}]
      WHEN kind = 'spans' AND json_type(j) = 'ARRAY' THEN list_transform(CAST(j AS JSON[]), lambda x, i: {'kind': 'span', 'si': CAST(i - 1 AS INT), 'ei': ei, 'path': path, 'j': x})
      WHEN kind = 'spans' AND json_type(j) = 'OBJECT' THEN [{'kind': 'span', 'si': CAST(0 AS INT), 'ei': ei, 'path': path, 'j': j}]
      WHEN kind = 'span' AND json_type(j) = 'OBJECT' THEN [
        {'kind': 'set', 'si': si, 'ei': CAST(-1 AS INT), 'path': path, 'j': j -> 'attributes'}, {'kind': 'set', 'si': si, 'ei': CAST(-2 AS INT), 'path': path, 'j': j -> 'resource'},
        {'kind': 'events', 'si': si, 'ei': ei, 'path': path, 'j': j -> 'events'}]
      WHEN kind = 'events' AND json_type(j) = 'ARRAY' THEN list_transform(CAST(j AS JSON[]), lambda x, i: {'kind': 'event', 'si': si, 'ei': CAST(i - 1 AS INT), 'path': path, 'j': x})
      WHEN kind = 'events' AND json_type(j) = 'OBJECT' THEN [{'kind': 'event', 'si': si, 'ei': CAST(0 AS INT), 'path': path, 'j': j}]
      WHEN kind = 'event' AND json_type(j) = 'OBJECT' THEN [{'kind': 'set', 'si': si, 'ei': ei, 'path': path, 'j': j -> 'attributes'}]
      WHEN kind IN ('set', 'plain') AND json_type(j) = 'OBJECT' THEN
        list_transform(map_entries(CAST(j AS MAP(VARCHAR, JSON))), lambda e: {'kind': 'plain', 'si': si, 'ei': ei, 'path': path || '/' || e.key, 'j': e.value})
      WHEN kind = 'plain' AND json_type(j) = 'ARRAY' THEN
        list_transform(CAST(j AS JSON[]), lambda x, i: {'kind': 'plain', 'si': si, 'ei': ei, 'path': path || '/' || (i - 1), 'j': x})
      WHEN kind = 'set' AND json_type(j) = 'ARRAY' THEN
        list_transform(list_filter(CAST(j AS JSON[]), lambda x: json_type(x) = 'OBJECT' AND json_exists(x, '$.key')), lambda x: {'kind': 'typed', 'si': si, 'ei': ei, 'path': path || '/' || (x ->> 'key'), 'j': x -> 'value'})
      WHEN kind = 'typed' AND json_type(j) = 'OBJECT' THEN
        list_transform(list_filter(['stringValue', 'intValue', 'doubleValue', 'boolValue', 'bytesValue'], lambda k: json_exists(j, '$.' || k)), lambda k: {'kind': 'plain', 'si': si, 'ei': ei, 'path': path, 'j': j -> k})
        || coalesce(list_transform(CAST(j -> 'arrayValue' -> 'values' AS JSON[]), lambda x, i: {'kind': 'typed', 'si': si, 'ei': ei, 'path': path || '/' || (i - 1), 'j': x}), [])
        || coalesce(list_transform(CAST(j -> 'kvlistValue' -> 'values' AS JSON[]), lambda x: {'kind': 'typed', 'si': si, 'ei': ei, 'path': path || '/' || (x ->> 'key'), 'j': x -> 'value'}), [])
      END) AS n FROM walk) AS w)"""

SQL = {
    "p2_found": f"""{_TREE}
SELECT f.t AS trace_id, f.s AS span_id FROM firsts AS f
WHERE NOT EXISTS (SELECT 1 FROM tree WHERE tree.t = f.t AND tree.s = f.s)""",
    "p2_hierarchy": f"""{_TREE}
SELECT f.t AS trace_id, f.s AS span_id, tree.root AS root_span_id, tree.depth AS depth, tree.path AS path, tree.s IS NULL AS endless
FROM firsts AS f LEFT JOIN tree ON tree.t = f.t AND tree.s = f.s""",
    "p2_descendants": f"""{_TREE}, up AS (
  SELECT t AS trace_id, s AS ancestor_span_id, s AS span_id, CAST(0 AS BIGINT) AS distance FROM tree
  UNION ALL
  SELECT f.t, up.ancestor_span_id, f.s, up.distance + 1 FROM up JOIN firsts AS f ON f.t = up.trace_id AND f.p = up.span_id)
SELECT * FROM up WHERE distance > 0""",
    "p3_found": f"""WITH {_READINGS}, ends AS (
  SELECT service_name, metric_name, instance_id, min(slot) AS a, max(slot) AS b FROM readings GROUP BY ALL),
grid AS (SELECT service_name, metric_name, instance_id, unnest(generate_series(a, b)) AS slot FROM ends)
SELECT g.service_name, g.metric_name, g.instance_id, g.slot * 60000000000 AS slot_ns FROM grid AS g
WHERE NOT EXISTS (SELECT 1 FROM readings AS r WHERE r.service_name = g.service_name AND r.metric_name = g.metric_name
  AND r.instance_id = g.instance_id AND r.slot = g.slot)""",
    "p3_states": f"""WITH {_READINGS}, ends AS (
  SELECT service_name, metric_name, instance_id, min(slot) AS a, max(slot) AS b FROM readings GROUP BY ALL),
grid AS (SELECT service_name, metric_name, instance_id, unnest(generate_series(a, b)) AS slot FROM ends),
n AS (SELECT service_name, metric_name, instance_id, slot, count(*) AS n FROM readings GROUP BY ALL)
SELECT service_name, metric_name, instance_id, slot * 60000000000 AS slot_ns, CAST(coalesce(n, 0) AS BIGINT) AS readings, n IS NOT NULL AS observed
FROM grid LEFT JOIN n USING (service_name, metric_name, instance_id, slot)""",
    "p4_found": f"""WITH {_LATE}
SELECT DISTINCT service_name, period_ns, arrival_period_ns FROM judged WHERE ok AND arrival_period_ns > period_ns""",
    "p4_periods": f"""WITH {_LATE}
SELECT service_name, period_ns, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE ok AND arrival_period_ns > period_ns) AS BIGINT) AS late,
  CAST(count(*) FILTER (WHERE ok AND bad) AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS refused,
  CAST(NULL AS BOOLEAN) AS closed
FROM judged GROUP BY service_name, period_ns""",
    "p5_found": f"""{_WALK}
SELECT DISTINCT payload_id, si AS span_index, ei AS event_index, substr(path, 2) AS attr_path FROM walk
WHERE kind IN ('plain', 'typed') AND json_type(j) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE', 'BOOLEAN')""",
    "p5_spans": f"""{_WALK}
SELECT payload_id, si AS span_index, j ->> 'traceId' AS trace_id, j ->> 'spanId' AS span_id, j ->> 'parentSpanId' AS parent_span_id, j ->> 'name' AS name
FROM walk WHERE kind = 'span' AND json_type(j) = 'OBJECT'""",
    "p5_events": f"""{_WALK}
SELECT payload_id, si AS span_index, ei AS event_index, j ->> 'name' AS name FROM walk WHERE kind = 'event' AND json_type(j) = 'OBJECT'""",
    "p5_rejected": """WITH RECURSIVE top AS (
  SELECT payload_id, payload AS p FROM trace_payloads
  UNION ALL
  SELECT payload_id, CAST(p AS JSON) ->> '$' FROM top WHERE json_valid(p) AND json_type(CAST(p AS JSON)) = 'VARCHAR')
SELECT t.payload_id, CASE WHEN t.payload IS NULL THEN 'null' WHEN trim(t.payload, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'blank'
  WHEN NOT json_valid(t.payload) THEN 'not JSON' ELSE 'no object' END AS reason
FROM trace_payloads AS t
WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.payload_id = t.payload_id AND json_valid(p) AND json_type(CAST(p AS JSON)) = 'OBJECT')""",
    "p6_impossible": """WITH x AS (
  SELECT arrival_seq, metric_type, unit, list_transform([value, count, sum, min, max], lambda v: CASE WHEN isfinite(v) THEN v END) AS f FROM metric_points)
SELECT arrival_seq FROM x WHERE coalesce(list_min(f) < 0, false) OR coalesce(unit = '1' AND f[1] > 1, false)
  OR (coalesce(metric_type, '') = 'Histogram' AND (coalesce(f[4] > f[5], false) OR coalesce(f[3] > f[2] * f[5] * (1 + 1e-9), false) OR coalesce(f[3] > 0 AND coalesce(f[2], 0) = 0, false)))""",
    "p7_found": f"""WITH {_IDS}
SELECT arrival_seq FROM (
  SELECT arrival_seq, row_number() OVER (PARTITION BY t, s ORDER BY arrival_seq) AS rn FROM ids WHERE t <> '' AND s <> '') AS x
WHERE rn > 1""",
    "p7_winners": f"""WITH {_IDS}
SELECT x.arrival_seq, x.t AS trace_id, x.s AS span_id, n.name, n.service_name, n.start_ns, n.duration_ns, n.status_code FROM (
  SELECT arrival_seq, t, s, row_number() OVER (PARTITION BY t, s ORDER BY arrival_seq) AS rn FROM ids WHERE t <> '' AND s <> '') AS x
JOIN spans AS n ON n.arrival_seq = x.arrival_seq WHERE rn = 1""",
}

SQL["p4_stream"] = SQL["p4_periods"]
