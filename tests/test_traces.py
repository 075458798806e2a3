import random

import pytest
from helpers import MS, SPAN, frame, rows, span

from teleloom.operators import graph, retention, search, traces
from teleloom.sources import canonical


def dedup(spark, data, mode="strict"):
    return traces.dedup_spans(canonical.spans(frame(spark, SPAN, data)), mode)


def roll(spark, data):
    out = {}
    for r in traces.rollup(dedup(spark, data)).collect():
        out[r["trace_id"]] = r
    return out


def test_dedup_and_promotion(spark):
    t = roll(spark, [span("t1", "a", "x", 0, 10), span("t1", "a", "x", 0, 10, batch_seq=2), span("t1", "b", "", 5, 10, batch_seq=2, service_name="svc-b")])["t1"]
    assert (t["span_count"], t["root"]["span_id"], t["service_name"], t["start_ns"], t["duration_ns"]) == (2, "b", "svc-b", 0, 10 * MS)


def test_longest_root_wins_and_ties_go_to_the_first(spark):
    t = roll(spark, [span("t1", "turn", "", 0, 2), span("t1", "task", "", 1, 900), span("t1", "c", "task", 10, 950), span("t2", "r1", "", 0, 5), span("t2", "r2", "", 1, 6)])
    assert t["t1"]["root"]["span_id"] == "task" and t["t1"]["duration_ns"] == 950 * MS
    assert t["t2"]["root"]["span_id"] == "r1"


def test_start_moves_back_and_errors_or(spark):
    t = roll(spark, [span("t1", "a", "", 0, 10), span("t1", "b", "a", -1000, 0, status_code="Error")])["t1"]
    assert t["start_ns"] == -1000 * MS and t["has_error"]


def test_rootless_trace_has_the_earliest_service_and_no_root(spark):
    t = roll(spark, [span("t1", "a", "ff", 20, 40, service_name="late"), span("t1", "b", "ee", 0, 10, service_name="early")])["t1"]
    assert t["root"] is None and t["service_name"] == "early" and t["duration_ns"] == 40 * MS


def test_reference_mode_keeps_duplicates_of_the_first_batch(spark):
    data = [span("t1", "a"), span("t1", "a"), span("t1", "a", batch_seq=2), span("t1", "b", batch_seq=2)]
    assert dedup(spark, data, "reference").count() == 3
    assert dedup(spark, data).count() == 2
    with pytest.raises(ValueError):
        dedup(spark, data, "other")


def test_reference_label_is_that_of_the_first_batch(spark):
    data = [span("t1", "a", "x", 20, 40, service_name="late"), span("t1", "b", "y", 0, 10, service_name="early", batch_seq=2)]
    assert rows(traces.reference_label(canonical.spans(frame(spark, SPAN, data))), "trace_id", "service_name") == [("t1", "late")]


def test_any_split_into_batches_gives_the_same_rollup(spark):
    rng = random.Random(3)
    data = [span(f"t{rng.randrange(4)}", f"s{rng.randrange(9)}", rng.choice(["", "s1", "s2"]), rng.randrange(50), rng.randrange(60), service_name=rng.choice("abc"), arrival_seq=i) for i in range(60)]
    whole = canonical.spans(frame(spark, SPAN, data))
    cut = rng.randrange(60)
    a, b = whole.filter(f"arrival_seq < {cut}"), whole.filter(f"arrival_seq >= {cut}")
    cols = ("trace_id", "span_count", "start_ns", "duration_ns", "service_name", "first_seq")
    assert rows(traces.merge_rollup(traces.dedup_spans(a), b), *cols) == rows(traces.rollup(traces.dedup_spans(whole)), *cols)


def test_dirty_rows_are_defined(spark):
    """Nulls anywhere, unset ids in any writing, unfinished and negative spans, extra columns."""
    data = [{}, {"trace_id": "0" * 32, "span_id": "0" * 16}, span("T1", "A", None, 5, 3), {"trace_id": "t1", "span_id": "B", "start_ns": 7}]
    df = frame(spark, SPAN, data).selectExpr("*", "'x' as root", "1 as _early", "2 as x")
    t = {r["trace_id"]: r for r in traces.rollup(traces.dedup_spans(canonical.spans(df))).collect()}
    assert t[""]["span_count"] == 2
    # the unfinished span starts and ends at 7 ns, the other runs backwards from 5 to 3 ms
    assert (t["t1"]["span_count"], t["t1"]["start_ns"], t["t1"]["duration_ns"]) == (2, 7, 3 * MS - 7)
    assert roll(spark, []) == {}


def test_parent_orphans_children_edges(spark):
    data = [span("t", "r", service_name="web"), span("t", "c", "r", service_name="api"), span("t", "o", "gone", service_name="api"), span("t", "s", "s", service_name="web"), span("u", "x", "r", service_name="api")]
    s = dedup(spark, data)
    assert rows(graph.with_parent(s, ["name"]), "trace_id", "span_id", "parent_name") == [("t", "c", "r"), ("t", "o", None), ("t", "r", None), ("t", "s", "s"), ("u", "x", None)]
    assert rows(graph.orphans(s), "trace_id", "span_id") == [("t", "o"), ("u", "x")]
    assert rows(graph.with_children(s), "span_id") == [("r",), ("s",)]
    assert rows(graph.service_edges(s), "source", "target", "call_count") == [("web", "api", 1)]
    nodes = graph.service_nodes(s)
    assert rows(graph.resolved_edges(graph.service_edges(s), nodes), "source", "target", "call_count", "source_spans", "target_spans") == [("web", "api", 1, 2, 3)]
    assert rows(graph.node_sizes(nodes), "service", "radius") == [("api", 40.0), ("web", 20.0 + 2 / 3 * 20)]


def test_span_tree(spark):
    data = [span("t", "root", "", 0, 9), span("t", "late", "root", 5, 6), span("t", "early", "root", 1, 8), span("t", "g", "early", 2, 3), span("t", "orphan", "gone", 4, 5), span("t", "l1", "l2"), span("t", "l2", "l1"), span("t", "me", "me")]
    flat = graph.span_tree(dedup(spark, data))
    got = [(r["span_id"], r["depth"], r["has_children"]) for r in sorted(flat.collect(), key=lambda r: r["position"])]
    assert got == [("root", 0, True), ("early", 1, True), ("g", 2, False), ("late", 1, False), ("orphan", 0, False)]
    shut = spark.createDataFrame([("t", "early")], "trace_id string, span_id string")
    assert rows(graph.collapse(flat, shut), "span_id") == [("early",), ("late",), ("orphan",), ("root",)]
    assert graph.span_tree(dedup(spark, [])).count() == 0


def test_bars_and_ticks(spark):
    s = dedup(spark, [span("t", "a", "", 10, 20), span("t", "b", "a", 15, 12), span("u", "z", "", 3, 3)])
    t = traces.rollup(s)
    assert rows(graph.waterfall_bars(s, t), "span_id", "offset_ns", "width_ns", "total_ns") == [("a", 0, 10 * MS, 10 * MS), ("b", 5 * MS, 0, 10 * MS), ("z", 0, 0, 1)]
    assert sorted(r["at_ns"] for r in graph.timeline_ticks(t).filter("trace_id = 't'").collect()) == [i * 2.0 * MS for i in range(6)]


def test_pages(spark):
    df = spark.range(1, 6).withColumnRenamed("id", "arrival_seq")
    page = lambda o, n: [r[0] for r in retention.page(df, n, o).collect()]
    assert page(0, 0) == [5, 4, 3, 2, 1] and page(0, 2) == [5, 4] and page(2, 2) == [3, 2] and page(10, 5) == [] and page(4, 10) == [1] and page(-5, 1) == [5] and page(0, -1) == [5, 4, 3, 2, 1]
    c = retention.connection(df, 2, 1)
    assert (c.total, c.limit, c.offset) == (5, 2, 1)
    assert sorted(tuple(r) for r in retention.newest_rank(df).collect()) == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]


def test_fifo(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "k string, arrival_seq bigint")
    assert rows(retention.fifo(df, ["k"], 2), "k", "arrival_seq") == [("b", 2), ("c", 4)]
    with pytest.raises(ValueError):
        retention.fifo(df, ["k"], 0)


def test_search_takes_wildcards_literally(spark):
    t = traces.rollup(dedup(spark, [span("t1", "a", "", 0, 1, name="100%_done"), span("t2", "b", "", 0, 1, name="other", status_code="Ok")]))
    find = lambda q: [r["trace_id"] for r in search.search_traces(t, q).orderBy("trace_id").collect()]
    assert find("%_") == ["t1"] and find("DONE") == ["t1"] and find("ok") == ["t2"] and find("") == ["t1", "t2"] and find("x_y") == []
