import json
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from helpers import LOG, POINT, SPAN, frame, rows
from pyspark.sql import functions as F

from teleloom.operators import grid, hierarchy, late, spikes
from teleloom.operators.dedup import DedupStore
from teleloom.operators.nested import NestedTables
from teleloom.plans.skew import hot_keys, lookup_join
from teleloom.plans.storage import Workspace

# hierarchies


def brute_tree(data):
    first = {}
    for r in data:
        t, s = (r.get("trace_id") or "").lower().strip("0") and r["trace_id"].lower(), (r.get("span_id") or "").lower()
        if t and s.strip("0"):
            first.setdefault((t, s), (r.get("parent_span_id") or "").lower())
    out = {}
    for t, s in first:
        path, seen, at = [s], {s}, s
        while True:
            p = first[t, at]
            if not p.strip("0") or (t, p) not in first:
                out[t, s] = "/".join(reversed(path))
                break
            if p in seen:
                out[t, s] = None
                break
            seen.add(p)
            path.append(p)
            at = p
    return out


def random_spans(seed, n=300):
    rng = random.Random(seed)
    t = [f"{i:032x}" for i in range(1, 5)]
    ids = [f"{i:016x}" for i in range(1, 40)]
    data = [{"trace_id": rng.choice([t[0], *t, t[1].upper()]), "span_id": rng.choice(ids), "parent_span_id": rng.choice([*ids, None, "", "0" * 16])} for _ in range(n)]
    return data + [{"trace_id": t[0], "span_id": None}, {"trace_id": None, "span_id": ids[0]}, {"trace_id": "0" * 32, "span_id": ids[0]}, {}]


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_brute_force(spark, seed):
    data = random_spans(seed)
    df = frame(spark, SPAN, data).withColumn("node", F.lit(1)).withColumn("path", F.lit("clash"))
    want = brute_tree(data)
    tree = {(r["trace_id"], r["span_id"]): r for r in hierarchy.hierarchy(df).collect()}
    assert {k: r["path"] for k, r in tree.items()} == want
    assert all(r["root_span_id"] == want[k].split("/")[0] and r["depth"] == want[k].count("/") for k, r in tree.items() if want[k])
    assert {tuple(r) for r in hierarchy.endless(df).collect()} == {k for k, v in want.items() if v is None}


def test_long_chain_and_descendants(spark):
    t = "a" * 32
    chain = [{"trace_id": t, "span_id": f"{i:016x}", "parent_span_id": f"{i - 1:016x}" if i > 1 else ""} for i in range(1, 201)]
    random.Random(0).shuffle(chain)
    tree = hierarchy.hierarchy(frame(spark, SPAN, chain))
    assert tree.agg(F.max("depth")).first()[0] == 199
    d = hierarchy.descendants(tree)
    assert d.count() == 199 * 200 // 2 and d.filter(f"ancestor_span_id = '{1:016x}'").count() == 199
    assert hierarchy.endless(frame(spark, SPAN, chain)).count() == 0


def test_odd_ids_and_empty_tables(spark):
    data = [{"trace_id": "t", "span_id": "a", "parent_span_id": "b"}, {"trace_id": "t", "span_id": "b", "parent_span_id": "a"}, {"trace_id": "t", "span_id": "c", "parent_span_id": "a"}, {"trace_id": "u", "span_id": "a", "parent_span_id": "b"}]
    assert rows(hierarchy.endless(frame(spark, SPAN, data)), "trace_id", "span_id") == [("t", "a"), ("t", "b"), ("t", "c")]
    assert hierarchy.endless(frame(spark, SPAN, [])).count() == 0 and hierarchy.hierarchy(frame(spark, SPAN, [])).count() == 0


def test_lookup_join_with_a_hot_key(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("bigint").alias("k"), "id").unionByName(spark.createDataFrame([(None, 9999)], "k bigint, id bigint"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert hot_keys(left, "k") == [7]
    for how in ("inner", "left"):
        assert rows(lookup_join(left, right, "k", how), "k", "id", "v") == rows(left.join(right, "k", how), "k", "id", "v")


# regular grid


def test_grid_marks_gaps(spark):
    m = grid.SLOT_NS
    data = [{"service_name": "s", "metric_name": "m", "instance_id": i, "ts_ns": t, "value": v} for i, t, v in (
        ("a", 10 * m, 1.0), ("a", 10 * m + 5, 3.0), ("a", 13 * m + 1, 4.0), ("b", 5 * m, 1.0), ("a", 0, 9.0), (None, 11 * m, 1.0), ("a", 11 * m, float("nan")), ("a", 12 * m, None), ("a", 20 * m, float("inf")))]
    df = frame(spark, POINT, data).withColumn("block", F.lit("clash")).withColumn("slot", F.lit(1))
    out = grid.regular_grid(df, ["service_name", "metric_name", "instance_id"])
    got = {(r["instance_id"], r["slot_ns"] // m): (r["value"], r["readings"], r["state"]) for r in out.collect()}
    assert {k for k, v in got.items() if v[2] != "observed"} == {("a", 11), ("a", 12)} and len(got) == 5
    assert got["a", 10] == (2.0, 2, "observed") and got["a", 11][2] == "imputed"
    assert grid.regular_grid(frame(spark, POINT, []), ["service_name"]).count() == 0


def test_grid_blocks_agree_with_the_whole(spark):
    m, rng = grid.SLOT_NS, random.Random(5)
    seen = sorted(rng.sample(range(1, 3000), 1500)) + [9000]
    data = [{"service_name": "s", "ts_ns": t * m, "value": float(np.sin(t / 9))} for t in seen]
    out = grid.regular_grid(frame(spark, POINT, data), ["service_name"], core=200, margin=40).toPandas()
    assert sorted(out.slot_ns // m) == list(range(seen[0], 9001))
    assert set(out[out.state == "observed"].slot_ns // m) == set(seen)
    early = out[(out.state == "imputed") & (out.slot_ns < 2900 * m)]
    assert len(early) > 1000 and np.abs(early.value - np.sin(early.slot_ns / m / 9)).mean() < 0.1
    assert set(out[(out.slot_ns > 4000 * m) & (out.slot_ns < 8000 * m)].state) == {"missing"}


def test_ssa_recovers_a_period():
    t = np.arange(400)
    x = 10 + np.sin(t / 8)
    gap = x.copy()
    gap[100:130] = np.nan
    gap[::7] = np.nan
    assert np.abs(grid.ssa_fill(gap)[100:130] - x[100:130]).max() < 0.1
    assert np.isnan(grid.ssa_fill(np.full(5, np.nan))).all() and grid.ssa_fill(np.array([1.0, np.nan, 3.0])).tolist() == [1.0, 2.0, 3.0]


def test_ssa_goes_on_to_rest():
    rng, t = np.random.default_rng(7), np.arange(300)
    x = 50 + 5 * np.sin(t / 11) + 2 * np.sin(t / 4) + rng.normal(0, 1, 300)
    x[rng.random(300) < 0.3] = np.nan
    x[80:125], x[200:240] = np.nan, np.nan
    gap, (y, how) = np.isnan(x), grid.ssa_impute(x)
    exact, _ = grid.ssa_impute(x, tol=1e-7)
    assert how == "spectrum" and np.abs(y - exact)[gap].max() < 0.02 * np.nanstd(x)
    assert grid.ssa_impute(x, settle=1, rounds=1)[1] == "unsettled" and grid.ssa_impute(np.array([1.0, np.nan, 3.0]))[1] == "lines"


def test_held_out_readings_are_met_better_than_by_lines():
    rng, t = np.random.default_rng(9), np.arange(500)
    x = 50 + 5 * np.sin(t / 11) + rng.normal(0, 1, 500)
    x[rng.integers(0, 500, 5)] += 200  # spikes lead neither the spectrum nor its neighbours astray
    seen = np.flatnonzero(x < 100)
    hidden = rng.choice(seen[1:-1], 150, replace=False)
    gap = x.copy()
    gap[hidden] = np.nan
    there = ~np.isnan(gap)
    error = lambda y: np.sqrt(np.mean((y[hidden] - x[hidden]) ** 2))
    lines = np.interp(t, t[there], gap[there])
    got = grid.ssa_fill(gap)
    assert error(got) < 0.9 * np.sqrt(np.mean(np.clip(lines[hidden] - x[hidden], -6, 6) ** 2)) and error(got) < 1.4
    assert (got[there] == gap[there]).all()


def test_grid_tells_how_a_slot_was_filled(spark):
    m = grid.SLOT_NS
    data = [{"service_name": s, "ts_ns": t * m, "value": float(np.sin(t / 5))} for s, ts in (("a", (1, 2, 4)), ("b", [t for t in range(1, 200) if t % 7])) for t in ts]
    got = grid.regular_grid(frame(spark, POINT, data), ["service_name"]).toPandas()
    assert set(got[got.state == "imputed"].groupby("service_name").fill.first().items()) == {("a", "lines"), ("b", "spectrum")}
    assert got[got.state == "observed"].fill.isna().all()


# late events


def test_late_corrections(spark):
    p, s = late.PERIOD_NS, 10**9
    data = [{"ts_ns": t, "observed_ts_ns": o, "service_name": n} for t, o, n in (
        (p, p + 1, "a"), (p, 2 * p, "a"), (p, 2 * p, "a"), (p + p - 1, 2 * p + 7200 * s - 1, "a"), (p, 2 * p + 7200 * s, "a"), (0, 5 * p, "b"), (None, 5 * p, None), (4 * p, 0, ""), (4 * p, None, "c"), (None, None, "d"), (0, 0, "d"), (4 * p, 2 * p, "early"))]
    df = frame(spark, LOG, data).withColumn("event", F.lit(1)).withColumn("batch", F.lit(2))
    part = late.partials(df)
    assert {tuple(r) for r in late.corrections(part).collect()} == {("a", p, 13 * p), ("a", p, 2 * p)}
    got = {(r["service_name"], r["period_ns"] // p): (r["n"], r["late"], r["refused"]) for r in late.period_totals(part).collect()}
    assert got == {("a", 1): (4, 3, 1), ("b", 5): (1, 0, 0), ("", 5): (1, 0, 0), ("", 4): (1, 0, 0), ("c", 4): (1, 0, 0), ("early", 4): (1, 0, 0)}
    early = {r["period_ns"] // p: (r["n"], r["closed"]) for r in late.period_totals(part.filter("service_name = 'a'"), as_of_ns=2 * p).collect()}
    assert early == {1: (3, False)}
    assert late.corrections(late.partials(frame(spark, LOG, []))).count() == 0


def test_batches_of_logs_add_up(spark):
    rng = random.Random(4)
    data = [{"ts_ns": rng.randrange(1, 10**13), "observed_ts_ns": rng.randrange(1, 10**13), "service_name": rng.choice("ab")} for _ in range(300)]
    df = frame(spark, LOG, data)
    parts = late.partials(df.filter("arrival_seq < 120"), batch=F.lit(1)).unionByName(late.partials(df.filter("arrival_seq >= 120"), batch=F.lit(2)))
    cols = ("service_name", "period_ns", "n", "late", "refused")
    assert rows(late.period_totals(parts), *cols) == rows(late.period_totals(late.partials(df)), *cols)


def test_late_store_equals_one_batch(spark):
    rng = random.Random(6)
    data = [{"ts_ns": rng.randrange(1, 10**13), "observed_ts_ns": rng.randrange(1, 10**13), "service_name": rng.choice("ab"), "severity_number": rng.choice([None, 9, 17])} for _ in range(400)]
    df, cols = frame(spark, LOG, data), ("service_name", "period_ns", "n", "late", "errors", "refused")
    want = rows(late.period_totals(late.partials(df)), *cols)
    store = late.LateStore(spark, Workspace(spark, "test").root)
    assert store.read().count() == 0 and rows(late.corrections(store.read())) == []
    part = lambda a, b: df.filter(f"arrival_seq > {a} and arrival_seq <= {b}")
    store.add(part(0, 100), 0)
    store.add(part(100, 200), 1)
    store.add(part(100, 200), 1)  # tried again
    before = rows(late.period_totals(store.read()), *cols)
    store.compact()
    store.compact()
    store.add(part(0, 100), 0)  # tried again after it was added up
    assert rows(late.period_totals(store.read()), *cols) == before
    store.add(part(200, 400), 2)
    assert rows(late.period_totals(store.read()), *cols) == want
    store.compact()
    assert rows(late.period_totals(store.read()), *cols) == want and rows(late.corrections(store.read()), "service_name", "period_ns", "arrival_period_ns") == rows(late.corrections(late.partials(df)), "service_name", "period_ns", "arrival_period_ns")


# nested records


def brute_leaves(x, path=()):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from brute_leaves(v, (*path, k))
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from brute_leaves(v, (*path, str(i)))
    elif x is not None:
        yield "/".join(path)


def otlp(x):
    def value(v):
        if isinstance(v, bool):
            return {"boolValue": v}
        if isinstance(v, dict):
            return {"kvlistValue": {"values": [{"key": k, "value": value(e)} for k, e in v.items()]}}
        if isinstance(v, list):
            return {"arrayValue": {"values": [value(e) for e in v]}}
        return {"intValue": str(v)} if isinstance(v, int) else {"doubleValue": v} if isinstance(v, float) else {"stringValue": v} if isinstance(v, str) else {}

    return [{"key": k, "value": value(v)} for k, v in x.items()]


def test_nested_against_brute_force(spark):
    rng = random.Random(7)
    trees = [{"a": 1}, {"a": "[1,2]", "b": [True, {"c": None, "d": 2.5}], "e": {}}, {}, {"deep": {"er": {"x": [[], [0, "y"]]}}}]
    style = lambda x: rng.choice([x, otlp(x), json.dumps(x), json.dumps(otlp(x))])
    payloads, want, bare = [], set(), defaultdict(int)
    for pid in range(60):
        spans = []
        for i in range(rng.randrange(4)):
            if rng.random() < 0.1:
                spans.append(None)
                continue
            s = {"spanId": str(i)}
            for role, e in (("attributes", -1), ("resource", -2)):
                if rng.random() < 0.8:
                    x = rng.choice(trees)
                    s[role] = style(x)
                    want |= {(pid, i, e, p) for p in brute_leaves(x)}
            ev = []
            for k in range(rng.randrange(3)):
                x = rng.choice(trees)
                ev.append({"name": "n", "attributes": style(x)})
                want |= {(pid, i, k, p) for p in brute_leaves(x)}
            if ev:
                s["events"] = ev[0] if len(ev) == 1 and rng.random() < 0.5 else rng.choice([ev, json.dumps(ev)])
            spans.append(s)
        top = {"traceId": "t", "rootSpan": {"attributes": {"no": 1}}, "spans": spans[0] if len(spans) == 1 and isinstance(spans[0], dict) else rng.choice([spans, json.dumps(spans)])}
        text = json.dumps(top)
        payloads.append((pid, json.dumps(text) if rng.random() < 0.2 else text))
        bare[pid] += 1
    payloads += [(100, None), (101, ""), (102, "null"), (103, "[]"), (104, payloads[0][1][:-3] + "{"), (105, '{"spans": NaN}'), (106, '{"spans": [3, "x", [1]]}'), (107, '"not json"'), (108, "1"), (109, '{"spans":[{"attributes":[1,{"value":2},{"key":"k"}],"events":[null,3]}]}')]
    df = spark.createDataFrame(payloads, "payload_id bigint, payload string").withColumn("h", F.lit("clash"))
    n = NestedTables(df)
    assert {tuple(r) for r in n.attributes().select("payload_id", "span_index", "event_index", "attr_path").collect()} == want
    assert n.objects.count() == n.objects.select("h").distinct().count()
    assert n.spans().filter("payload_id < 100").count() == sum(1 for _, p in payloads[:60] for s in _span_list(p) if isinstance(s, dict))
    assert NestedTables(spark.createDataFrame([], "payload_id bigint, payload string")).attributes().count() == 0


def _span_list(text):
    x = json.loads(text)
    x = json.loads(x) if isinstance(x, str) else x
    s = x["spans"]
    s = json.loads(s) if isinstance(s, str) else s
    return [s] if isinstance(s, dict) else s


def test_equal_objects_in_any_writing_are_stored_once(spark):
    a = {"spans": [{"attributes": {"x": 1, "y": "z"}}]}
    b = {"spans": [{"attributes": json.dumps([{"key": "y", "value": {"stringValue": "z"}}, {"key": "x", "value": {"intValue": "1"}}])}]}
    n = NestedTables(spark.createDataFrame([(1, json.dumps(a)), (2, json.dumps(b))], "payload_id bigint, payload string"))
    assert n.objects.filter("kind = 'attributes'").count() == 1 and n.roots.select("root").distinct().count() == 1 and n.attributes().count() == 4


def test_very_deep_payload_is_no_crash(spark):
    deep = "[" * 100_000 + "]" * 100_000
    n = NestedTables(spark.createDataFrame([(1, '{"spans":[{"attributes":{"a":' + deep + "}}]}")], "payload_id bigint, payload string"))
    assert n.attributes().count() == 0


def rebuilt(n, h):
    """The value of an attribute set from its objects and bridge rows."""
    body = {bytes(r["h"]): json.loads(r["content"]) for r in n.objects.collect()}
    links = defaultdict(list)
    for r in n.bridge.collect():
        links[bytes(r["parent"])].append((r["key"], r["ordinal"], bytes(r["child"])))

    def value(h):
        own = body[h]
        for key, i, child in links[h]:
            own[key if isinstance(own, dict) else i] = value(child)
        return own

    return value(h)


def test_payloads_far_deeper_than_the_stack(spark):
    text = '{"intValue":"1"}'
    plain = '{"k":' * 20_000 + "1" + "}" * 20_000
    for _ in range(2000):
        text = '{"kvlistValue":{"values":[{"key":"a","value":' + text + "}]}}"
    payloads = [(1, '{"spans":[{"attributes":[{"key":"a","value":' + text + "}]}]}"), (2, '{"spans":[{"resource":' + plain + "}]}"), (3, '{"spans":[{"resource":' + plain[:-5] + "}]}"), (4, '{"spans":[{"attributes":{"a":1}}]}')]
    n = NestedTables(spark.createDataFrame(payloads, "payload_id bigint, payload string"))
    got = {r["payload_id"]: r["attr_path"] for r in n.attributes().collect()}
    assert {k: (v.count("/"), v[:3]) for k, v in got.items()} == {1: (2000, "a/a"), 2: (19_999, "k/k"), 4: (0, "a")}
    assert [(r["payload_id"], r["reason"]) for r in n.rejected.collect()] == [(3, "not JSON")]


def test_deep_loads_is_the_parser():
    from teleloom.operators.nested import deep_loads

    texts = ["[]", "{}", " [1 , 2.5e3,-0,[{}],\"\\u00e9\\n\"] ", '{"a":{"b":[null,true,false]},"a":2}', "[1,]", "[,1]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "[1}", "{]", "[1 2]", "1 2", "", " ", "nul", "NaN", "-", "01", "1.", '"a', '["\\x"]', "[[1]", "]", '{1:2}', '"\t"', "\ufeff1", "[1]]", "tru", "3", '"s"']
    for t in texts:
        try:
            want = json.loads(t, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
        except ValueError:
            with pytest.raises(ValueError):
                deep_loads(t)
        else:
            assert deep_loads(t) == want, t


def test_layers_root_spans_and_odd_values(spark):
    layered = json.dumps({"a": 1})
    for _ in range(12):
        layered = json.dumps(layered)
    lone = {"spanId": "r", "attributes": {"only": "here"}}
    payloads = [(1, '{"spans":[{"attributes":' + layered + "}]}"), (2, json.dumps({"spans": [], "rootSpan": lone})), (3, json.dumps({"spans": [lone], "rootSpan": lone})),
                (4, '{"spans":[{"attributes":[{"key":"a","value":{"arrayValue":"x"}},{"key":"b","value":{"kvlistValue":[1]}},{"key":"c","value":{"arrayValue":null}}]}]}'),
                (5, '{"spans":[{"name":"\\ud800","attributes":{"\\udfff":"\\ud800x"}}]}'), (6, '{"spans":[{"attributes":{"n":' + "9" * 5000 + "}}]}"), (7, ' "[]" '), (8, "\t"), (9, None)]
    n = NestedTables(spark.createDataFrame(payloads, "payload_id bigint, payload string"))
    assert sorted((r["payload_id"], r["attr_path"]) for r in n.attributes().collect()) == [(1, "a"), (3, "only"), (5, "?"), (6, "n")]
    root = n.bridge.filter("role = 'root'").join(n.objects, F.col("child") == F.col("h"))
    assert root.count() == 2 and root.select("child").distinct().count() == 1 and root.filter("content like '%\"r\"%'").count() == 2
    assert {r["payload_id"]: r["reason"] for r in n.rejected.collect()} == {7: "no object", 8: "blank", 9: "null"}


def test_nested_objects_are_shared_at_any_depth(spark):
    inner = {"p": 1, "q": [{"r": 2}, None, "s", [{"r": 2}]]}
    trees = [{"x": inner}, {"y": inner, "z": [inner, 3]}, {"deep": {"er": {"x": inner}}}]
    payloads = [(i, json.dumps({"spans": [{"attributes": style(t)}]})) for i, t in enumerate(trees) for style in (lambda t: t, otlp) if style is not otlp or i == 1]
    payloads = [(i, p) for i, (_, p) in enumerate(payloads)]
    n = NestedTables(spark.createDataFrame(payloads, "payload_id bigint, payload string"))
    of = lambda c: n.objects.filter(F.col("content") == c).count()
    assert of('{"r":2}') == 1 and of('{"p":1}') == 1 and n.objects.filter("kind = 'attributes'").count() == 3
    child = n.objects.filter("content = '{\"p\":1}'").first()["h"]
    assert n.bridge.filter(F.col("child") == F.lit(bytes(child))).count() == 4
    want = {json.dumps(t, sort_keys=True) for t in trees}
    assert {json.dumps(rebuilt(n, bytes(r["h"])), sort_keys=True) for r in n.objects.filter("kind = 'attributes'").collect()} == want


# spikes


def source(values, kind="Gauge", unit="ms", inst="i", t0=10**15, **more):
    return [{"service_name": "s", "metric_name": "m", "instance_id": inst, "metric_type": kind, "unit": unit, "temporality": "Unspecified", "ts_ns": t0 + i * 10**10, "value": None if v is None else float(v), **more} for i, v in enumerate(values)]


def flagged(spark, data, **kw):
    return {r["arrival_seq"]: r["reason"] for r in spikes.flag(frame(spark, POINT, data).withColumn("bin", F.lit("clash")).withColumn("reading", F.lit(1)), **kw).collect()}


def test_spikes_stuck_and_impossible(spark):
    rng = np.random.default_rng(1)
    x = 100 + rng.normal(0, 1, 300)
    x[150:] += 60  # a lasting change of level
    x[50], x[200:203], x[90:98] = 180, [20.0, 25.0, 22.0], x[90]
    data = source(x)
    data[250]["value"] = -5.0
    data.append(dict(data[50]))  # a copy
    got = flagged(spark, data)
    assert {k for k, v in got.items() if v == "spike"} == {51, 201, 202, 203, 301}
    assert {k for k, v in got.items() if v == "stuck"} == set(range(91, 99)) and got[251] == "impossible" and len(got) == 14


def test_small_blocks_find_the_same(spark):
    rng = np.random.default_rng(2)
    x = 100 + rng.normal(0, 1, 3000)
    x[[5, 63, 64, 1500, 2990]] += 80
    x[[700 + i for i in range(9)]] = x[700]
    want = flagged(spark, source(x))
    assert flagged(spark, source(x), block=128) == want and len(want) == 14


def test_blocks_judge_by_the_whole_source(spark):
    rng = np.random.default_rng(8)
    x = 100 + rng.normal(0, 1, 1200) * np.where(np.arange(1200) < 600, 0.05, 1)  # a quiet half and a busy one
    x[300] += 3
    x[900] += 80
    x[400:560], x[-20:] = x[400], x[-20]  # a block and more; nearly all of the last block
    y = np.cumsum(np.where(np.arange(1200) < 900, 40.0, 1.0) * rng.uniform(1, 2, 1200))
    y[1100] += 300  # not much beside the usual steps
    short = source(100 + rng.normal(0, 1, 120), inst="k") + source(100 + rng.normal(0, 1, 250), inst="l")  # their last blocks hold only context
    data = [r | {"arrival_seq": i + 1} for i, r in enumerate(source(x) + [r | {"temporality": "Cumulative"} for r in source(y, "Sum", inst="j")] + short)]
    want = flagged(spark, data)
    assert {k for k, v in want.items() if v == "stuck"} == {*range(401, 561), *range(1181, 1201)} and {k for k, v in want.items() if v == "spike"} == {901}
    assert flagged(spark, data, block=128) == want


def test_the_tail_decides(spark):
    rng = np.random.default_rng(11)
    light, heavy = 100 + rng.uniform(-1, 1, 400), 100 + np.clip(rng.standard_t(1.5, 400), -12, 12)
    light[200] += 5  # some 7 scatters of the light source; the heavy one goes that far by itself
    data = [r | {"arrival_seq": i + 1} for i, r in enumerate(source(light, inst="a") + source(heavy, inst="b"))]
    assert flagged(spark, data) == {201: "spike"}
    z = np.abs(spikes.residuals(heavy))
    assert (z / (1.4826 * np.median(z))).max() > 5 / (1.4826 * np.median(np.abs(spikes.residuals(light))))
    assert len(flagged(spark, data, risk=0.05)) > 1 and flagged(spark, data, risk=1e-30) == {}


def test_a_reading_copied_many_times_and_a_hot_minute(spark):
    rng = np.random.default_rng(12)
    x = 100 + rng.normal(0, 1, 900)
    x[500] += 60
    data = [r | {"ts_ns": 10**15 + i * 10**6} for i, r in enumerate(source(x))]  # all within a second
    data += [dict(data[500])] * 300
    data = [r | {"arrival_seq": i + 1} for i, r in enumerate(data)]
    want = {501: "spike"} | {k: "spike" for k in range(901, 1201)}
    assert flagged(spark, data) == want and flagged(spark, data, block=100) == want


def test_normal_behaviour_is_not_flagged(spark):
    rng = np.random.default_rng(3)
    steps = [3.0] * 100 + [5.0] * 80 + [4.0] * 90
    ramp = np.cumsum(rng.uniform(1, 3, 150))
    restart = [*ramp + 1e6, *([ramp[-1] + 1e6] * 20), *np.cumsum(rng.uniform(1, 3, 150))]
    data = source(steps, inst="a") + source(restart, "Sum", "By", "b", is_monotonic=True) + source(rng.exponential(5, 400), inst="c") + source([0.0] * 30 + list(rng.uniform(1, 2, 200)), inst="d")
    for r in data:
        if r["metric_type"] == "Sum":
            r["temporality"] = "Cumulative"
    data = [r | {"arrival_seq": i + 1} for i, r in enumerate(data)]
    assert flagged(spark, data) == {}


def test_ramp_spike(spark):
    x = np.cumsum(np.random.default_rng(4).uniform(1, 3, 200)) + 1000
    x[77] *= 5
    assert flagged(spark, [r | {"temporality": "Cumulative"} for r in source(x, "Sum")]) == {78: "spike"}


def test_impossible_figures(spark):
    h = {"metric_type": "Histogram", "unit": "s"}
    data = [h | {"count": 2.0, "sum": 1.0, "min": 0.6, "max": 0.5}, h | {"count": 2.0, "sum": 5.0, "max": 2.0}, h | {"count": 0.0, "sum": 5.0}, h | {"sum": 5.0}, h | {"count": 2.0, "sum": 4.0, "min": 1.0, "max": 2.0}, h | {"count": 0.0, "sum": 0.0},
            {"metric_type": "Gauge", "unit": "1", "value": 1.5}, {"metric_type": "Gauge", "unit": "1", "value": 1.0}, {"metric_type": "Gauge", "value": float("-inf")}, {"metric_type": "Gauge", "value": -1.0}, {}, h | {"min": -1.0}]
    assert set(flagged(spark, data)) == {1, 2, 3, 4, 7, 10, 12}
    assert flagged(spark, []) == {}


# delivered more than once


def deliveries(seed, n=400):
    rng = random.Random(seed)
    return pd.DataFrame([(rng.choice(["hot"] * 10 + [f"k{rng.randrange(150)}", None]), i, f"p{i * 5 // n}") for i in range(1, n + 1)], columns=["key", "arrival_seq", "part"])


@pytest.mark.parametrize("shuffled", [False, True])
def test_store_against_brute_force(spark, shuffled):
    df = deliveries(1)
    df = df.sample(frac=1, random_state=2) if shuffled else df
    store = DedupStore(spark, Workspace(spark, "test").root)
    schema = "key string, arrival_seq bigint, part string"
    for i in range(0, len(df), 150):
        store.merge(spark.createDataFrame([tuple(r) for r in df.iloc[i : i + 150].itertuples(index=False)], schema))
    known = df.dropna(subset=["key"])
    keep = set(known.groupby("key").arrival_seq.min())
    assert {r["arrival_seq"] for r in store.read().collect()} == keep and store.read().count() == len(keep)
    lost = [r[0] for r in store.losers().collect()]
    assert sorted(lost) == sorted(set(known.arrival_seq) - keep)
    m = store.manifest()
    if shuffled:
        assert any(f.startswith("data-3") for fs in m["partitions"].values() for f in fs)
    store.merge(spark.createDataFrame([], schema))
    assert store.read().count() == len(keep)


def test_only_touched_partitions_are_rewritten(spark):
    store = DedupStore(spark, Workspace(spark, "test").root)
    schema = "key string, arrival_seq bigint, part string, other string"
    store.merge(spark.createDataFrame([("a", 10, "x", "1"), ("b", 11, "y", "2"), ("c", 12, "y", None)], schema))
    before = store.manifest()["partitions"]
    store.merge(spark.createDataFrame([("b", 5, "z", "3"), ("d", 20, "z", "4")], schema))
    after = store.manifest()["partitions"]
    assert after["x"] == before["x"] and after["y"] != before["y"] and sorted(after) == ["x", "y", "z"]
    assert rows(store.read(), "key", "arrival_seq", "part", "other") == [("a", 10, "x", "1"), ("b", 5, "z", "3"), ("c", 12, "y", None), ("d", 20, "z", "4")]
    assert [r[0] for r in store.losers().collect()] == [11]


def test_an_unfinished_merge_changes_nothing(spark):
    store = DedupStore(spark, Workspace(spark, "test").root)
    one = spark.createDataFrame([("a", 1, "x")], "key string, arrival_seq bigint, part string")
    store.merge(one)
    store._commit, commit = lambda m: (_ for _ in ()).throw(OSError("lost")), store._commit
    with pytest.raises(OSError):
        store.merge(spark.createDataFrame([("a", 0, "x"), ("b", 2, "x")], one.schema))
    assert rows(store.read(), "key", "arrival_seq") == [("a", 1)]
    store._commit = commit
    store.merge(spark.createDataFrame([("a", 0, "x"), ("b", 2, "x")], one.schema))  # what the dead run left behind is overwritten
    assert rows(store.read(), "key", "arrival_seq") == [("a", 0), ("b", 2)]


MESSAGE = "key string, arrival_seq bigint, part string"


def test_a_batch_reads_only_the_buckets_it_touches(spark):
    store = DedupStore(spark, Workspace(spark, "test").root, buckets=64)
    for k in range(3):
        store.merge(spark.createDataFrame([(f"k{i}", i, "x") for i in range(k * 500, k * 500 + 500)], MESSAGE))
    m = store.manifest()
    assert sum(r["rows"] for r in m["index"]) == 1500 and len(m["index"]) <= 2
    loaded, load = [], store._load
    store._load = lambda folders: (loaded.extend(folders), load(folders))[1]
    store.merge(spark.createDataFrame([("k7", 9000, "x"), ("k8", -1, "x"), ("new", 9001, "y")], MESSAGE))
    touched = {f for f in loaded if f.startswith(tuple(r["folder"] for r in m["index"]))}
    assert len(touched) <= 3 * len(m["index"])
    assert store.read().count() == 1501 and sorted(r[0] for r in store.losers().collect()) == [8, 9000]


def test_of_two_writers_one_wins_and_the_other_can_try_again(spark):
    root = Workspace(spark, "test").root
    a, b = DedupStore(spark, root), DedupStore(spark, root)
    a.merge(spark.createDataFrame([("x", 5, "p")], MESSAGE))
    commit = a._commit

    def late(m):  # the other writer commits in between
        b.merge(spark.createDataFrame([("y", 6, "p"), ("x", 3, "q")], MESSAGE))
        commit(m)

    a._commit = late
    mine = spark.createDataFrame([("x", 4, "p"), ("z", 7, "r")], MESSAGE)
    with pytest.raises(RuntimeError):
        a.merge(mine)
    assert rows(a.read(), "key", "arrival_seq") == [("x", 3), ("y", 6)]
    a._commit = commit
    a.merge(mine)
    assert rows(b.read(), "key", "arrival_seq") == [("x", 3), ("y", 6), ("z", 7)]
    assert sorted(r[0] for r in a.losers().collect()) == [4, 5]
    assert a.vacuum() and rows(a.read(), "key", "arrival_seq") == [("x", 3), ("y", 6), ("z", 7)] and a.vacuum() == []


def test_a_store_of_nothing(spark):
    store = DedupStore(spark, Workspace(spark, "test").root)
    store.merge(spark.createDataFrame([(None, 1, "p")], MESSAGE))
    assert store.read().columns == ["key", "arrival_seq", "part"] and store.read().count() == 0 and store.losers().count() == 0


def test_a_manifest_cut_off_is_no_version(spark):
    from teleloom.plans.storage import create_if_absent

    store = DedupStore(spark, Workspace(spark, "test").root)
    store.merge(spark.createDataFrame([("x", 5, "p")], MESSAGE))
    assert create_if_absent(spark, f"{store.root}/manifest-00000002.json", b'{"version": 2, "part')
    assert not create_if_absent(spark, f"{store.root}/manifest-00000002.json", b"{}")
    assert rows(store.read(), "key") == [("x",)]
    store.merge(spark.createDataFrame([("x", 6, "p"), ("y", 7, "p")], MESSAGE))
    assert store.manifest()["version"] == 3 and rows(store.read(), "key", "arrival_seq") == [("x", 5), ("y", 7)]


def test_parallel_writers_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = Workspace(spark, "test").root

    def write(k):
        store, batch = DedupStore(spark, root), spark.createDataFrame([("hot", 100 - k, "p"), (f"k{k}", 1000 + k, f"p{k % 2}")], MESSAGE)
        for _ in range(10):
            try:
                return store.merge(batch)
            except RuntimeError:
                continue
        raise AssertionError("no turn")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    store = DedupStore(spark, root)
    assert rows(store.read(), "key", "arrival_seq") == [("hot", 98), ("k0", 1000), ("k1", 1001), ("k2", 1002)]
    assert sorted(r[0] for r in store.losers().collect()) == [99, 100]
