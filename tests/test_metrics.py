from datetime import datetime, timedelta

from helpers import POINT, frame, rows

from teleloom.functions import catalog
from teleloom.operators import metrics, series
from teleloom.sources import canonical

T0 = datetime(2026, 1, 1)


def raw(spark, data):
    return canonical.raw_points(frame(spark, POINT, [{"service_name": "s", "metric_name": "m", "received_at": T0, "ts_ns": i, **r} for i, r in enumerate(data)]))


def cum(*values, **more):
    return [{"metric_type": "Sum", "temporality": "Cumulative", "is_monotonic": True, "value": float(v), **more} for v in values]


def values(df, col="value"):
    return [r[col] for r in df.orderBy("arrival_seq").collect()]


def test_number_deltas(spark):
    assert values(metrics.number_deltas(raw(spark, cum(10, 15, 18)))) == [5.0, 3.0]
    assert values(metrics.number_deltas(raw(spark, cum(100, 120, 5, 8, 8)))) == [20.0, 3.0, 0.0]


def test_lag_over_run_borders(spark):
    from teleloom.plans.ordered import lag_by_key

    df = spark.createDataFrame([(k, i, i * 10 + k) for i in range(25) for k in range(2)], "k int, o bigint, v bigint")
    got = {(r["k"], r["o"]): r["prev_v"] for r in lag_by_key(df, ["k"], "o", ["v"], run=4).collect()}
    assert got == {(k, i): (None if i == 0 else (i - 1) * 10 + k) for i in range(25) for k in range(2)}


def test_ttl(spark):
    data = cum(100, 150, 170)
    data[2]["received_at"] = T0 + timedelta(minutes=11)
    assert values(metrics.number_deltas(raw(spark, data), metrics.TTL_NS)) == [50.0]
    assert values(metrics.number_deltas(raw(spark, data))) == [50.0, 20.0]


def test_histograms(spark):
    h = {"metric_type": "Histogram", "temporality": "Cumulative"}
    data = [{**h, "count": 10.0, "sum": 2.5, "min": 0.01, "max": 0.8}, {**h, "count": 15.0, "sum": 4.0, "min": 0.02, "max": 0.9}, {**h, "count": 16.0, "sum": 3.0}, {**h, "count": 2.0, "sum": 1.0}, {**h, "count": 3.0}, {**h, "count": 3.0, "sum": 1.0}]
    r = metrics.distribution_deltas(raw(spark, data)).orderBy("arrival_seq").collect()
    assert [(x["count"], x["sum"], x["value"]) for x in r] == [(5.0, 1.5, 0.3), (1.0, -1.0, -1.0), (1.0, None, 0.0), (0.0, None, 0.0)]
    assert (r[0]["min"], r[0]["max"]) == (0.02, 0.9)


def test_passthrough_and_non_finite(spark):
    g = [{"metric_type": "Gauge", "value": v} for v in (float("nan"), float("inf"), float("-inf"), 1.5, None)]
    data = g + [{"metric_type": "Sum", "temporality": "Cumulative", "is_monotonic": False, "value": 42.0}, {"metric_type": "Sum", "temporality": "Cumulative", "is_monotonic": True, "value": float("nan")}, {"metric_type": "Histogram", "temporality": "Delta", "count": 4.0, "sum": 2.0}]
    r = raw(spark, data)
    assert values(metrics.metric_points(r)) == [1.5, 0.0, 42.0, 0.5]
    assert rows(metrics.skipped(r), "skipped") == [(4,)]


def test_summaries_are_always_deltas(spark):
    s = {"metric_type": "Summary", "temporality": None}
    assert values(metrics.metric_points(raw(spark, [{**s, "count": 1.0, "sum": 1.0}, {**s, "count": 3.0, "sum": 5.0}]))) == [2.0]


def test_series_key_ignores_order_of_attributes(spark):
    r = raw(spark, cum(1, 4) + cum(9))
    k = raw(spark, [dict(cum(1)[0], attributes={"a": "1", "b": '"x"'}), dict(cum(4)[0], attributes={"b": '"x"', "a": "1"}), dict(cum(9)[0], attributes={"a": '"1"', "b": '"x"'}), dict(cum(5)[0], attributes={"a": None})])
    assert values(metrics.number_deltas(k)) == [3.0]
    assert values(metrics.number_deltas(r)) == [3.0, 5.0]


def test_state_of_series_expires_and_is_capped(spark):
    at = lambda s: {"received_at": T0 + timedelta(seconds=s)}
    hist = {"metric_type": "Histogram", "temporality": "Cumulative", "count": 2.0, "sum": 3.0}
    r = raw(spark, [*cum(1, **at(0)), *cum(5, **at(1)), {**hist, **at(2)}, *cum(7, metric_name="old", **at(-700)), {"metric_type": "Gauge", "value": 1.0, **at(3)}, *cum(float("nan"), **at(4))])
    assert rows(metrics.last_observed(r), "metric_name", "value", "count") == [("m", 5.0, None), ("m", None, 2.0), ("old", 7.0, None)]
    assert rows(metrics.last_observed(r, metrics.TTL_NS), "metric_name", "value") == [("m", 5.0), ("m", None)]
    assert rows(metrics.last_observed(r, cap=2), "metric_name", "count") == [("m", 2.0), ("old", None)]
    assert metrics.last_observed(raw(spark, []), metrics.TTL_NS).count() == 0


def test_merge_hides_a_baseline_and_keeps_the_first_description(spark):
    r = raw(spark, cum(100))
    assert metrics.merge(r, metrics.metric_points(r)).count() == 0
    data = [{"metric_type": "Gauge", "value": 42.0, "description": "one", "unit": "s"}, {"metric_type": "Gauge", "value": 55.0, "description": "two", "received_at": T0 + timedelta(seconds=9)}]
    r = raw(spark, data)
    m = metrics.merge(r, metrics.metric_points(r)).collect()
    assert [(x["description"], x["unit"], x["point_count"], x["received_at"]) for x in m] == [("one", "s", 2, T0 + timedelta(seconds=9))]
    assert values(metrics.last_points(metrics.metric_points(r), 1)) == [55.0]
    assert rows(metrics.latest(metrics.metric_points(r), metrics.METRIC), "value") == [(55.0,)]


def test_facets_and_cardinality(spark):
    name = "http.server.request.duration"
    data = [{"metric_name": name, "metric_type": "Gauge", "value": 1.0, "attributes": {"http.request.method": f'"{"GET" if i % 2 else "PUT"}"', "http.route": f'"/{i % 3}"', "id": str(i), "fixed": "1", "gone": None}} for i in range(30)]
    p = metrics.metric_points(raw(spark, data))
    assert rows(series.cardinality(p), "attribute", "n") == [("fixed", 1), ("http.request.method", 2), ("http.route", 3), ("id", 21)]
    got = [(r["facet_id"], r["label"]) for r in series.facets(p).orderBy("ordinal").collect()]
    assert got == [("http.request.method|http.route", "Method + Route"), ("http.request.method", "Method"), ("http.route", "Route")]
    assert ["|".join(a) for a, _ in catalog.resolve_facets(name, {"http.request.method": 2, "http.route": 3, "id": 500})] == [g[0] for g in got]
    f = series.facet_series(p, ["http.request.method", "nothing"])
    assert {r[0] for r in f.select("series").collect()} == {"GET (unset)", "PUT (unset)"}


def test_attribute_values_keep_their_type(spark):
    p = metrics.metric_points(raw(spark, [{"metric_type": "Gauge", "value": 1.0, "attributes": {"a": "1"}}, {"metric_type": "Gauge", "value": 2.0, "attributes": {"a": '"1"'}}]))
    assert metrics.latest(p, metrics.SERIES).count() == 2


def test_rules_and_units(spark):
    assert catalog.lookup_rule("http.server.connection.duration")[1] == "http.server." and catalog.lookup_rule("http.server.request.duration")[2] == "s" and catalog.lookup_rule("what") is None
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("http.server.request.duration", ""), ("http.server.request.duration", "ms"), ("what", "")], "n string, u string")
    assert [r[0] for r in df.select(catalog.metric_unit(F.col("n"), F.col("u"))).collect()] == ["s", "ms", ""]
    assert catalog.pick_facet([(["a"], "A"), (["b"], "B")], "b") == (["b"], "B") and catalog.pick_facet([(["a"], "A")]) == (["a"], "A") and catalog.pick_facet([]) is None


def test_axis_and_nearest(spark):
    ms = 10**6
    data = [{"metric_type": "Gauge", "value": v, "ts_ns": t * ms, "attributes": {"s": s}} for s, t, v in (("1", 10, 5.0), ("1", 20, 6.0), ("2", 14, 7.0), ("2", 16, 8.0))]
    p = metrics.metric_points(raw(spark, data))
    assert rows(series.nearest(p, 15 * ms), "attr_key", "at_ms", "value") == [("s=1", 14, 5.0), ("s=2", 14, 7.0)]
    assert rows(series.axis_domain(p), "x_min", "x_max", "y_min", "y_max") == [(10 * ms, 20 * ms, -0.8, 8.8)]
    flat = metrics.metric_points(raw(spark, [{"metric_type": "Gauge", "value": 0.5}]))
    assert rows(series.axis_domain(flat), "y_min", "y_max") == [(-0.1, 1.1)]


def test_empty(spark):
    p = metrics.metric_points(raw(spark, []))
    assert p.count() == 0 and series.facets(p).count() == 0 and series.nearest(p, 0).count() == 0 and series.axis_domain(p).count() == 0
