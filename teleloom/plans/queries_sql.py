"""DuckDB SQL with the results of ``queries``, written from the definitions, not from the Spark plans."""

from __future__ import annotations

from teleloom.functions.catalog import label_map, rules


def _id(c: str) -> str:
    return f"CASE WHEN ltrim(lower(trim(coalesce({c}, ''))), '0') = '' THEN '' ELSE lower(trim({c})) END"


_C = f"""c AS (
  SELECT {_id('trace_id')} AS trace_id, {_id('span_id')} AS span_id, {_id('parent_span_id')} AS parent_span_id, coalesce(name, '') AS name,
    coalesce(service_name, '') AS service_name, start_ns, end_ns, end_ns - start_ns AS duration_ns, coalesce(status_code, 'Unset') AS status_code,
    events, batch_seq, arrival_seq FROM spans)"""
_S = f"""{_C},
s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY arrival_seq) AS rn FROM c) AS x WHERE rn = 1 OR span_id = '')"""
_T = f"""{_S},
roots AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY duration_ns DESC NULLS LAST, arrival_seq) AS rn FROM s WHERE parent_span_id = '') AS x WHERE rn = 1),
early AS (SELECT trace_id, service_name FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns NULLS LAST, arrival_seq) AS rn FROM s) AS x WHERE rn = 1),
firstname AS (SELECT trace_id, name FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY arrival_seq) AS rn FROM s) AS x WHERE rn = 1),
agg AS (SELECT trace_id, count(*) AS span_count, min(start_ns) AS start_ns, max(coalesce(end_ns, start_ns)) AS end_ns, bool_or(status_code = 'Error') AS has_error, min(arrival_seq) AS first_seq FROM s GROUP BY trace_id),
t AS (
  SELECT a.trace_id, a.span_count, a.start_ns, greatest(a.end_ns - a.start_ns, 0) AS duration_ns, a.has_error, a.first_seq, r.span_id AS root_span_id, r.name AS root_name,
    r.duration_ns AS root_duration, r.trace_id IS NOT NULL AS has_root, coalesce(r.status_code, 'Unset') AS root_status,
    coalesce(nullif(r.service_name, ''), e.service_name) AS service_name, coalesce(nullif(r.name, ''), nullif(f.name, ''), '-') AS display_name, coalesce(r.name, f.name) AS search_name
  FROM agg AS a LEFT JOIN roots AS r ON a.trace_id = r.trace_id JOIN early AS e ON a.trace_id = e.trace_id JOIN firstname AS f ON a.trace_id = f.trace_id)"""
_FLAT = "trace_id, service_name, display_name, root_span_id, root_status, span_count, start_ns, duration_ns, has_error, first_seq"
_L = f"""l AS (
  SELECT coalesce(ts_ns, 0) AS ts_ns, {_id('trace_id')} AS trace_id, {_id('span_id')} AS span_id, coalesce(severity_text, '') AS severity_text, coalesce(body, '') AS body,
    coalesce(service_name, '') AS service_name, arrival_seq FROM logs)"""
_TREE = f"""{_S},
f AS (SELECT trace_id, span_id, parent_span_id, service_name, lpad(CAST(greatest(coalesce(start_ns, 0), 0) AS VARCHAR), 19, '0') || '.' || lpad(CAST(arrival_seq AS VARCHAR), 19, '0') AS seg FROM s WHERE span_id <> ''),
tree AS (
  SELECT f.trace_id, f.span_id, f.service_name, CAST(0 AS BIGINT) AS depth, f.seg AS path FROM f LEFT JOIN f AS p ON f.trace_id = p.trace_id AND f.parent_span_id = p.span_id WHERE p.span_id IS NULL
  UNION ALL
  SELECT f.trace_id, f.span_id, f.service_name, tree.depth + 1, tree.path || '/' || f.seg FROM f JOIN tree ON f.trace_id = tree.trace_id AND f.parent_span_id = tree.span_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY path) AS position FROM tree)"""
_KEY = "coalesce(array_to_string(list_sort(list_transform(map_entries(attributes), lambda e: e.key || '=' || coalesce(e.value, 'null'))), ', '), '')"
_P = f"""r AS (
  SELECT coalesce(service_name, '') AS service_name, coalesce(metric_name, '') AS metric_name, coalesce(description, '') AS description, coalesce(unit, '') AS unit, coalesce(metric_type, '') AS metric_type,
    coalesce(temporality, 'Unspecified') AS temporality, coalesce(is_monotonic, false) AS is_monotonic, ts_ns, value, count AS n, sum AS s, min AS lo, max AS hi, attributes, {_KEY} AS attr_key, received_at, arrival_seq
  FROM metric_points),
nums AS (SELECT * REPLACE (coalesce(value, 0.0) AS value) FROM r WHERE metric_type IN ('Gauge', 'Sum') AND isfinite(coalesce(value, 0.0))),
dists AS (SELECT * FROM r WHERE metric_type IN ('Histogram', 'Summary', 'ExponentialHistogram') AND (s IS NULL OR isfinite(s))),
pass_ AS (
  SELECT service_name, metric_name, attr_key, arrival_seq, received_at, attributes, ts_ns, value, CAST(NULL AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi
  FROM nums WHERE NOT (metric_type = 'Sum' AND temporality = 'Cumulative' AND is_monotonic)
  UNION ALL
  SELECT service_name, metric_name, attr_key, arrival_seq, received_at, attributes, ts_ns, CASE WHEN s IS NOT NULL AND n > 0 THEN s / n ELSE 0.0 END, n, s, lo, hi
  FROM dists WHERE temporality <> 'Cumulative' AND metric_type <> 'Summary'),
nlag AS (SELECT *, lag(value) OVER w AS pv, lag(received_at) OVER w AS pr FROM nums WHERE metric_type = 'Sum' AND temporality = 'Cumulative' AND is_monotonic
  WINDOW w AS (PARTITION BY service_name, metric_name, attr_key ORDER BY arrival_seq)),
ndelta AS (SELECT service_name, metric_name, attr_key, arrival_seq, received_at, attributes, ts_ns, value - pv AS value, CAST(NULL AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, pr
  FROM nlag WHERE pv IS NOT NULL AND value >= pv),
dlag AS (SELECT *, lag(n) OVER w AS pn, lag(s) OVER w AS ps FROM dists WHERE (temporality = 'Cumulative' OR metric_type = 'Summary') AND n IS NOT NULL AND NOT isnan(n)
  WINDOW w AS (PARTITION BY service_name, metric_name, attr_key ORDER BY arrival_seq)),
ddelta AS (SELECT service_name, metric_name, attr_key, arrival_seq, received_at, attributes, ts_ns, CASE WHEN s - ps IS NOT NULL AND n - pn > 0 THEN (s - ps) / (n - pn) ELSE 0.0 END AS value, n - pn AS n, s - ps AS s, lo, hi
  FROM dlag WHERE pn IS NOT NULL AND n >= pn),
pts AS (SELECT * FROM pass_ UNION ALL SELECT * EXCLUDE (pr) FROM ndelta UNION ALL SELECT * FROM ddelta)"""
_M = f"""{_P},
shown AS (SELECT r.* FROM r JOIN pts ON r.arrival_seq = pts.arrival_seq),
m AS (SELECT service_name, metric_name, arg_min(description, arrival_seq) AS description, arg_min(unit, arrival_seq) AS unit, arg_min(metric_type, arrival_seq) AS metric_type, count(*) AS point_count, max(received_at) AS received_at
  FROM shown GROUP BY service_name, metric_name)"""
_MK = "service_name, metric_name"
_SK = "service_name, metric_name, attr_key"


def _plain(v: str) -> str:
    return f"CASE WHEN {v} IS NULL OR {v} = 'null' THEN '(unset)' WHEN starts_with({v}, '\"') THEN json_extract_string('{{\"v\":' || {v} || '}}', '$.v') ELSE {v} END"


_CARD = f"""{_P},
vals AS (SELECT DISTINCT service_name, metric_name, e.key AS attribute, {_plain('e.value')} AS v FROM (SELECT service_name, metric_name, unnest(map_entries(attributes)) AS e FROM pts) AS x WHERE e.value IS NOT NULL AND e.value <> 'null'),
card AS (SELECT service_name, metric_name, attribute, least(count(*), 21) AS n FROM vals GROUP BY service_name, metric_name, attribute)"""
_RULES = ", ".join("({}, '{}', {}, {}, {})".format(i, p, f"'{u}'" if u else "NULL", "[" + ", ".join(f"'{a}'" for a in at) + "]" if at else "NULL", f"'{lb}'" if lb else "NULL") for i, p, u, at, lb in rules())
_LABELS = ", ".join(f"('{a}', '{b}')" for a, b in label_map().items())
_RULE_OF = f"rules(ordinal, pattern, unit, attributes, label) AS (VALUES {_RULES})"
_TONE = "CASE WHEN severity_text = 'INFO' THEN 'primary' WHEN severity_text = 'WARN' THEN 'warning' WHEN severity_text IN ('ERROR', 'FATAL') THEN 'destructive' ELSE 'muted' END"



def _fixed(v: str) -> str:
    """F10, with ties away from zero."""
    return f"""CASE WHEN {v} >= 100 THEN printf('%.0f', {v} + CASE WHEN {v} - floor({v}) = 0.5 THEN 0.1 ELSE 0.0 END)
  WHEN {v} >= 10 THEN printf('%.1f', {v} + CASE WHEN {v} * 4 = floor({v} * 4) AND ({v} * 20) % 2 = 1 THEN 0.01 ELSE 0.0 END)
  ELSE printf('%.2f', {v} + CASE WHEN {v} * 8 = floor({v} * 8) AND ({v} * 200) % 2 = 1 THEN 0.001 ELSE 0.0 END) END"""


def _tenths(unit: str) -> str:
    return f"((n * 10 + {unit} // 2) // {unit})"


def _compact() -> str:
    text = lambda t: f"CAST({t} // 10 AS VARCHAR) || CASE WHEN {t} % 10 = 0 THEN '' ELSE '.' || CAST({t} % 10 AS VARCHAR) END"
    steps = " ".join(f"WHEN n < {top} THEN {text(_tenths(unit))} || '{name}'" for unit, top, name in (("1000", 999950, "K"), ("1000000", 999950000, "M"), ("1000000000", 999950000000, "B")))
    return f"CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) {steps} ELSE {text(_tenths('1000000000000'))} || 'T' END"


SQL = {
    "trace_merge": f"WITH {_T} SELECT {_FLAT} FROM t",
    "trace_errors_rank": f"WITH {_T} SELECT trace_id, has_error, duration_ns, row_number() OVER (ORDER BY has_error DESC, duration_ns DESC NULLS LAST, first_seq) AS n FROM t",
    "metric_last_thousand": f"WITH {_P} SELECT {_MK}, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY {_MK} ORDER BY arrival_seq DESC) AS rn FROM pts) AS x WHERE rn <= 1000",
    "series_tracked": f"WITH {_P} SELECT {_SK}, max(arrival_seq) AS last_seq FROM r GROUP BY {_SK} ORDER BY last_seq DESC LIMIT 50000",
    "points_newest": f"WITH {_P} SELECT {_MK}, arrival_seq, row_number() OVER (ORDER BY arrival_seq DESC) AS n FROM pts",
    "search_logs_of_trace": f"WITH {_L} SELECT arrival_seq FROM l WHERE trace_id = (SELECT min(trace_id) FROM l WHERE trace_id <> '') AND (contains(lower(body), 'e') OR contains(lower(service_name), 'e') OR contains(lower(severity_text), 'e') OR contains(trace_id, 'e'))",
    "fmt_units": f"""WITH d AS (SELECT DISTINCT abs(duration_ns) AS n FROM spans WHERE duration_ns IS NOT NULL),
v AS (SELECT n, n / 1e9 AS s, n / 1e6 AS ms FROM d),
w AS (SELECT *, CASE WHEN s >= 1 THEN s WHEN s >= 1e-3 THEN s * 1e3 ELSE s * 1e6 END AS sv, CASE WHEN ms >= 1000 THEN ms / 1000 WHEN ms >= 1 THEN ms ELSE ms * 1000 END AS mv, s - floor(s / 60) * 60 AS left_ FROM v)
SELECT n, printf('%.1f', ms + CASE WHEN n % 100000 = 50000 AND n % 250000 = 0 THEN 0.01 ELSE 0.0 END) || 'ms' AS of_ms,
  CASE WHEN n = 0 THEN '0 s' WHEN s >= 60 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm ' || printf('%.0f', left_ + CASE WHEN left_ - floor(left_) = 0.5 THEN 0.1 ELSE 0.0 END) || 's'
    ELSE {_fixed('sv')} || CASE WHEN s >= 1 THEN ' s' WHEN s >= 1e-3 THEN ' ms' ELSE ' μs' END END AS seconds,
  {_fixed('mv')} || CASE WHEN ms >= 1000 THEN ' s' WHEN ms >= 1 THEN ' ms' ELSE ' μs' END AS millis, {_compact()} AS compact FROM w""",
    "fmt_relative": f"""WITH {_L}, k AS (SELECT arrival_seq, 1772798400000 - ts_ns // 1000000 AS d FROM l)
SELECT arrival_seq, CASE WHEN d < 1000 THEN 'now' WHEN d < 60000 THEN CAST(d // 1000 AS VARCHAR) || 's ago' WHEN d < 3600000 THEN CAST(d // 60000 AS VARCHAR) || 'm ago' WHEN d < 86400000 THEN CAST(d // 3600000 AS VARCHAR) || 'h ago' ELSE CAST(d // 86400000 AS VARCHAR) || 'd ago' END AS text FROM k""",
    "feed_union": f"""WITH {_T}, {_L}, {_M} SELECT 'traces' AS type, CAST(json_object('trace_id', trace_id, 'span_count', span_count) AS VARCHAR) AS data FROM t
UNION ALL SELECT 'metrics', CAST(json_object('service_name', service_name, 'metric_name', metric_name, 'point_count', point_count) AS VARCHAR) FROM m
UNION ALL SELECT 'logs', CAST(json_object('arrival_seq', arrival_seq, 'trace_id', trace_id) AS VARCHAR) FROM l""",
    "span_dedup": f"WITH {_S} SELECT trace_id, span_id, parent_span_id, name, service_name, start_ns, duration_ns, status_code, arrival_seq FROM s",
    "span_dedup_reference": f"""WITH {_C}, x AS (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY arrival_seq) AS rn, min(batch_seq) OVER (PARTITION BY trace_id) AS fb FROM c)
SELECT trace_id, span_id, arrival_seq FROM x WHERE batch_seq = fb OR rn = 1 OR span_id = ''""",
    "trace_list": f"WITH {_T} SELECT {_FLAT} FROM t",
    "trace_list_page": f"WITH {_T} SELECT {_FLAT} FROM t ORDER BY first_seq DESC LIMIT 50 OFFSET 50",
    "trace_root_span": f"WITH {_T} SELECT trace_id, root_span_id AS span_id, root_name AS name, root_duration AS duration_ns FROM t WHERE has_root",
    "trace_service_label": f"WITH {_T} SELECT trace_id, service_name FROM t",
    "trace_errors_first": f"WITH {_T} SELECT trace_id, has_error, duration_ns FROM t ORDER BY has_error DESC, duration_ns DESC, first_seq LIMIT 100",
    "trace_by_id": f"WITH {_T} SELECT {_FLAT} FROM t WHERE trace_id = (SELECT min(lower(trace_id)) FROM spans WHERE trace_id <> '')",
    "trace_bounds": f"WITH {_T} SELECT trace_id, coalesce(start_ns, 0) AS base_ns, greatest(coalesce(duration_ns, 1), 1) AS total_ns FROM t",
    "span_trace": f"WITH {_T} SELECT s.trace_id, s.span_id, s.arrival_seq, t.service_name AS trace_service, t.span_count AS trace_spans FROM s JOIN t ON s.trace_id = t.trace_id",
    "trace_logs": f"WITH {_S}, {_L} SELECT trace_id, arrival_seq, body, severity_text FROM l WHERE trace_id <> '' AND trace_id IN (SELECT trace_id FROM s)",
    "trace_log_counts": f"WITH {_S}, {_L}, k AS (SELECT DISTINCT trace_id FROM s) SELECT k.trace_id, count(l.arrival_seq) AS log_count FROM k LEFT JOIN l ON l.trace_id = k.trace_id AND l.trace_id <> '' GROUP BY k.trace_id",
    "log_trace_edge": f"WITH {_T}, {_L} SELECT l.arrival_seq, l.trace_id, t.service_name AS trace_service, t.span_count FROM l LEFT JOIN t ON l.trace_id = t.trace_id AND l.trace_id <> ''",
    "log_span_edge": f"WITH {_S}, {_L} SELECT l.arrival_seq, l.trace_id, l.span_id, s.name AS span_name, s.service_name AS span_service FROM l LEFT JOIN s ON l.trace_id = s.trace_id AND l.span_id = s.span_id AND l.trace_id <> '' AND l.span_id <> ''",
    "span_parent": f"WITH {_S} SELECT s.trace_id, s.span_id, s.arrival_seq, p.name AS parent_name FROM s LEFT JOIN s AS p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id AND s.parent_span_id <> ''",
    "orphan_spans": f"WITH {_S} SELECT trace_id, span_id, parent_span_id, arrival_seq FROM s WHERE parent_span_id <> '' AND NOT EXISTS (SELECT 1 FROM s AS p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id)",
    "spans_with_children": f"WITH {_S} SELECT trace_id, span_id FROM s WHERE span_id <> '' AND EXISTS (SELECT 1 FROM s AS k WHERE k.span_id <> '' AND k.trace_id = s.trace_id AND k.parent_span_id = s.span_id)",
    "service_nodes": f"WITH {_S} SELECT service_name AS service, count(*) AS span_count, count(*) FILTER (WHERE status_code = 'Error') AS error_count FROM s GROUP BY service_name",
    "service_edges": f"WITH {_S} SELECT p.service_name AS source, s.service_name AS target, count(*) AS call_count FROM s JOIN s AS p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id WHERE s.parent_span_id <> '' AND p.service_name <> s.service_name GROUP BY p.service_name, s.service_name",
    "service_edges_resolved": f"""WITH {_S}, n AS (SELECT service_name, count(*) AS k FROM s GROUP BY service_name),
e AS (SELECT p.service_name AS source, s.service_name AS target, count(*) AS call_count FROM s JOIN s AS p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id WHERE s.parent_span_id <> '' AND p.service_name <> s.service_name GROUP BY p.service_name, s.service_name)
SELECT source, target, call_count, a.k AS source_spans, b.k AS target_spans FROM e JOIN n AS a ON a.service_name = source JOIN n AS b ON b.service_name = target""",
    "service_radius": f"WITH {_S}, n AS (SELECT service_name AS service, count(*) AS span_count FROM s GROUP BY service_name) SELECT service, span_count, round(20.0 + span_count / (SELECT max(span_count) FROM n) * 20.0, 6) AS radius FROM n",
    "span_tree": f"WITH RECURSIVE {_TREE} SELECT trace_id, span_id, depth, EXISTS (SELECT 1 FROM f WHERE f.trace_id = placed.trace_id AND f.parent_span_id = placed.span_id) AS has_children, position FROM placed",
    "span_tree_collapsed": f"WITH RECURSIVE {_TREE} SELECT trace_id, span_id, depth FROM placed WHERE depth <= 1",
    "waterfall_bars": f"""WITH {_S}, n AS (SELECT * FROM s WHERE span_id <> ''), b AS (SELECT trace_id, min(start_ns) AS base, greatest(max(coalesce(end_ns, start_ns)) - min(start_ns), 1) AS total_ns FROM n GROUP BY trace_id)
SELECT n.trace_id, n.span_id, greatest(n.start_ns - b.base, 0) AS offset_ns, greatest(coalesce(n.duration_ns, 0), 0) AS width_ns, b.total_ns FROM n JOIN b ON n.trace_id = b.trace_id""",
    "timeline_ticks": f"WITH {_T} SELECT trace_id, tick, greatest(duration_ns, 1) / 5.0 * tick AS at_ns FROM (SELECT trace_id, CAST(coalesce(duration_ns, 0) AS DOUBLE) AS duration_ns, unnest([0, 1, 2, 3, 4, 5]) AS tick FROM t) AS x",
    "trace_services": f"""WITH RECURSIVE {_TREE}, a AS (SELECT trace_id, service_name, min(position) AS p FROM placed GROUP BY trace_id, service_name)
SELECT trace_id, service_name, (row_number() OVER (PARTITION BY trace_id ORDER BY p) - 1) % 8 AS colour FROM a""",
    "span_events": f"""WITH {_S}, x AS (SELECT trace_id, span_id, unnest(events) AS e, generate_subscripts(events, 1) - 1 AS event_index FROM s)
SELECT trace_id, span_id, event_index, e.name AS name, e.ts_ns AS ts_ns, {_KEY.replace('attributes', 'e.attributes').replace('lambda e: e.key', 'lambda k: k.key').replace('coalesce(e.value', 'coalesce(k.value')} AS attributes FROM x""",
    "resource_service": f"SELECT arrival_seq, coalesce(CASE WHEN v IS NULL THEN NULL ELSE {_plain('v')} END, '') AS service FROM (SELECT arrival_seq, resource['service.name'] AS v FROM spans) AS x",
    "span_duration": "SELECT arrival_seq, end_ns - start_ns AS duration_ns, (end_ns - start_ns) / 1e6 AS duration_ms FROM spans",
    "unset_ids": "SELECT " + ", ".join(f"count(*) FILTER (WHERE coalesce({c}, '') IN ('', repeat('0', 16), repeat('0', 32))) AS {c}" for c in ("trace_id", "span_id", "parent_span_id")) + " FROM spans",
    "nonfinite_filter": "SELECT coalesce(service_name, '') AS service_name, coalesce(metric_name, '') AS metric_name, count(*) AS skipped FROM metric_points WHERE metric_type IN ('Gauge', 'Sum') AND value IS NOT NULL AND NOT isfinite(value) GROUP BY 1, 2",
    "metric_passthrough": f"WITH {_P} SELECT {_SK}, arrival_seq, value, n AS count FROM pass_",
    "metric_delta": f"WITH {_P} SELECT {_SK}, arrival_seq, value FROM ndelta",
    "metric_delta_ttl": f"WITH {_P} SELECT {_SK}, arrival_seq, value FROM ndelta WHERE NOT coalesce(epoch_us(received_at) - epoch_us(pr) > 600000000, false)",
    "metric_hist_delta": f"WITH {_P} SELECT {_SK}, arrival_seq, value, n AS count, s AS sum, lo AS min, hi AS max FROM ddelta",
    "metric_points": f"WITH {_P} SELECT {_SK}, arrival_seq, ts_ns, value, n AS count, s AS sum, lo AS min, hi AS max FROM pts",
    "metric_merge": f"WITH {_M} SELECT {_MK}, description, unit, metric_type, point_count, epoch_us(received_at) AS received_us FROM m",
    "metric_last_points": f"WITH {_P} SELECT {_MK}, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY {_MK} ORDER BY arrival_seq DESC) AS rn FROM pts) AS x WHERE rn <= 100",
    "metric_latest": f"WITH {_P} SELECT {_MK}, arg_max(value, arrival_seq) AS value, max(arrival_seq) AS arrival_seq FROM pts GROUP BY {_MK}",
    "series_latest": f"WITH {_P} SELECT {_SK}, arg_max(value, arrival_seq) AS value, max(arrival_seq) AS arrival_seq FROM pts GROUP BY {_SK}",
    "series_newest": f"WITH {_P} SELECT {_SK}, max(arrival_seq) AS last_seq FROM r GROUP BY {_SK} ORDER BY last_seq DESC LIMIT 1000",
    "series_points": f"WITH {_P} SELECT {_SK}, ts_ns, arrival_seq, value, row_number() OVER (PARTITION BY {_SK} ORDER BY ts_ns // 1000000, arrival_seq) AS n FROM pts",
    "series_facet": f"WITH {_P} SELECT {_MK}, series, count(*) AS n, max(value) AS top FROM (SELECT {_MK}, value, {_plain('z')} AS series FROM (SELECT *, attributes['zone'] AS z FROM pts) AS y) AS x GROUP BY {_MK}, series",
    "series_colours": f"WITH {_P} SELECT {_SK}, (row_number() OVER (PARTITION BY {_MK} ORDER BY f) - 1) % 5 AS colour FROM (SELECT {_SK}, min(arrival_seq) AS f FROM pts GROUP BY {_SK}) AS x",
    "axis_domain": f"""WITH {_P}, g AS (SELECT {_MK}, min(ts_ns) AS x_min, max(ts_ns) AS x_max, least(min(value), 0.0) AS lo, greatest(max(value), 1.0) AS hi FROM pts GROUP BY {_MK})
SELECT {_MK}, x_min, x_max, lo - (hi - lo) * CAST(0.1 AS DOUBLE) AS y_min, hi + (hi - lo) * CAST(0.1 AS DOUBLE) AS y_max FROM g""",
    "nearest_point": f"""WITH {_P}, k AS (SELECT *, ts_ns // 1000000 AS t, 1772798400000 AS cur FROM pts),
f AS (SELECT {_SK}, min(arrival_seq) AS f FROM k GROUP BY {_SK}),
near AS (SELECT * FROM (SELECT {_SK}, t, row_number() OVER (PARTITION BY {_SK} ORDER BY abs(t - cur), t, arrival_seq) AS rn FROM k) AS x WHERE rn = 1),
g AS (SELECT * FROM (SELECT {_MK}, t AS at_ms, row_number() OVER (PARTITION BY {_MK} ORDER BY abs(t - 1772798400000), f) AS rn FROM near JOIN f USING ({_SK})) AS x WHERE rn = 1)
SELECT {_SK}, at_ms, value FROM (SELECT k.service_name, k.metric_name, k.attr_key, g.at_ms, k.value, row_number() OVER (PARTITION BY k.service_name, k.metric_name, k.attr_key ORDER BY abs(k.t - g.at_ms), k.t, k.arrival_seq) AS rn
  FROM k JOIN g USING ({_MK})) AS x WHERE rn = 1""",
    "attr_cardinality": f"WITH {_CARD} SELECT {_MK}, attribute, n FROM card",
    "metric_facets": f"""WITH {_CARD}, {_RULE_OF}, labels(attribute, label) AS (VALUES {_LABELS}),
have AS (SELECT {_MK}, list(attribute) AS have FROM card GROUP BY {_MK}),
hit AS (SELECT * FROM (SELECT {_MK}, have, attributes, label, row_number() OVER (PARTITION BY {_MK} ORDER BY ordinal) AS rn FROM have JOIN rules ON starts_with(metric_name, pattern)) AS x WHERE rn = 1),
u AS (SELECT {_MK}, 0 AS part, array_to_string(attributes, '|') AS facet_id, label FROM hit WHERE attributes IS NOT NULL AND list_has_all(have, attributes)
  UNION ALL SELECT {_MK}, 1, c.attribute, coalesce(l.label, c.attribute) FROM card AS c LEFT JOIN labels AS l ON c.attribute = l.attribute WHERE n BETWEEN 2 AND 20)
SELECT {_MK}, row_number() OVER (PARTITION BY {_MK} ORDER BY part, facet_id) AS ordinal, facet_id, label FROM u""",
    "metric_any_attributes": f"WITH {_P} SELECT {_MK}, bool_or(coalesce(cardinality(attributes), 0) > 0) AS any_attributes FROM pts GROUP BY {_MK}",
    "metric_unit": f"""WITH {_RULE_OF}, d AS (SELECT DISTINCT metric_name, coalesce(unit, '') AS declared FROM metric_points),
n AS (SELECT d.*, coalesce((SELECT unit FROM rules WHERE starts_with(d.metric_name, pattern) ORDER BY ordinal LIMIT 1), '') AS by_name FROM d)
SELECT metric_name, declared, by_name, CASE WHEN declared <> '' THEN declared ELSE by_name END AS unit FROM n""",
    "metrics_by_name": f"WITH {_M} SELECT metric_name, service_name, point_count, row_number() OVER (ORDER BY metric_name, service_name) AS n FROM m",
    "logs_page": f"WITH {_L} SELECT arrival_seq, ts_ns, service_name, severity_text, body FROM l ORDER BY arrival_seq DESC LIMIT 50",
    "logs_by_trace": f"WITH {_L} SELECT arrival_seq, trace_id, body FROM l WHERE trace_id = (SELECT min(trace_id) FROM l WHERE trace_id <> '')",
    "search_traces": f"WITH {_T} SELECT trace_id FROM t WHERE contains(lower(search_name), 'orders') OR contains(lower(service_name), 'orders') OR contains(trace_id, 'orders') OR contains(lower(root_status), 'orders')",
    "search_logs": f"WITH {_L} SELECT arrival_seq FROM l WHERE contains(body, '_') OR contains(service_name, '_') OR contains(severity_text, '_') OR contains(trace_id, '_')",
    "search_metrics": f"WITH {_M} SELECT {_MK} FROM m WHERE contains(lower(metric_name), 'gauge') OR contains(lower(service_name), 'gauge') OR contains(lower(metric_type), 'gauge') OR contains(lower(description), 'gauge')",
    "severity_tone": f"WITH {_L} SELECT severity_text, count(*) AS n, {_TONE} AS tone FROM l GROUP BY severity_text",
    "status_tone": "SELECT coalesce(status_code, 'Unset') AS status_code, count(*) AS n, CASE coalesce(status_code, 'Unset') WHEN 'Ok' THEN 'success' WHEN 'Error' THEN 'destructive' WHEN 'Unset' THEN 'muted' END AS tone FROM spans GROUP BY 1",
    "log_clock": f"""WITH {_L} SELECT arrival_seq, strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S.') || lpad(CAST(ts_ns // 1000000 % 1000 AS VARCHAR), 3, '0') AS clock, substr(trace_id, 1, 16) AS short,
  CASE WHEN length(body) > 24 THEN substr(body, 1, 24) || '…' ELSE body END AS label FROM l""",
    "retention_fifo": f"WITH {_S}, k AS (SELECT trace_id FROM s GROUP BY trace_id ORDER BY min(arrival_seq) DESC LIMIT 1000) SELECT trace_id, count(*) AS spans FROM s WHERE trace_id IN (SELECT trace_id FROM k) GROUP BY trace_id",
    "newest_rank": f"WITH {_S} SELECT trace_id, min(arrival_seq) AS first_seq, row_number() OVER (ORDER BY min(arrival_seq) DESC) AS rank FROM s GROUP BY trace_id",
    "signal_counts": f"WITH {_S}, {_M} SELECT (SELECT count(DISTINCT trace_id) FROM s) AS trace_count, (SELECT count(*) FROM m) AS metric_count, (SELECT count(*) FROM logs) AS log_count",
    "fmt_duration": """SELECT DISTINCT duration_ns, CASE WHEN duration_ns < 1000 THEN CAST(duration_ns AS VARCHAR) || 'ns'
  WHEN duration_ns < 1000000 THEN printf('%.1f', duration_ns / 1e3 + CASE WHEN duration_ns % 100 = 50 AND duration_ns % 250 = 0 THEN 0.01 ELSE 0.0 END) || 'µs'
  WHEN duration_ns < 1000000000 THEN printf('%.1f', duration_ns / 1e6 + CASE WHEN duration_ns % 100000 = 50000 AND duration_ns % 250000 = 0 THEN 0.01 ELSE 0.0 END) || 'ms'
  ELSE printf('%.2f', duration_ns / 1e9 + CASE WHEN duration_ns % 10000000 = 5000000 AND duration_ns % 125000000 = 0 THEN 0.001 ELSE 0.0 END) || 's' END AS text
FROM (SELECT end_ns - start_ns AS duration_ns FROM spans) AS x""",
    "fmt_bytes": """WITH d AS (SELECT DISTINCT duration_ns FROM spans WHERE duration_ns IS NOT NULL),
k AS (SELECT duration_ns, least(5, CASE WHEN abs(duration_ns) < 1024 THEN 0 WHEN abs(duration_ns) < 1048576 THEN 1 WHEN abs(duration_ns) < 1073741824 THEN 2 WHEN abs(duration_ns) < 1099511627776 THEN 3 WHEN abs(duration_ns) < 1125899906842624 THEN 4 ELSE 5 END) AS k FROM d),
v AS (SELECT duration_ns, k, abs(duration_ns) / CAST(power(1024, k) AS DOUBLE) AS v FROM k)
SELECT duration_ns, CASE WHEN duration_ns < 0 THEN '-' ELSE '' END ||
  CASE WHEN v >= 100 THEN printf('%.0f', v + CASE WHEN v - floor(v) = 0.5 THEN 0.1 ELSE 0.0 END)
       WHEN v >= 10 THEN printf('%.1f', v + CASE WHEN v * 4 = floor(v * 4) AND (v * 20) % 2 = 1 THEN 0.01 ELSE 0.0 END)
       ELSE printf('%.2f', v + CASE WHEN v * 8 = floor(v * 8) AND (v * 200) % 2 = 1 THEN 0.001 ELSE 0.0 END) END
  || [' B', ' KiB', ' MiB', ' GiB', ' TiB', ' PiB'][k + 1] AS text FROM v""",
}
