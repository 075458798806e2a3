"""The queries of the library's own operators over the driver's telemetry tables, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.functions import catalog, format
from teleloom.functions.ids import is_zero_id
from teleloom.operators import correlate, feed, graph, metrics, retention, search, series, traces
from teleloom.plans.ordered import rank_by_key
from teleloom.sources import canonical
from teleloom.sources.tables import table

#: Idle time of the TTL queries: the tables' series report every few seconds to minutes.
TTL_NS = 600 * 10**9
CAP = 1000


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return traces.dedup_spans(canonical.spans(table(spark, d, "spans")))


def _slim(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated spans without the wide columns."""
    wide = ("attributes", "events", "resource")
    s = canonical.spans(table(spark, d, "spans"))
    return traces.dedup_spans(s.select(*[c for c in s.columns if c not in wide]))


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return traces.rollup(_slim(spark, d))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return canonical.logs(table(spark, d, "logs"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return canonical.raw_points(table(spark, d, "metric_points"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_points(_raw(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d)
    return metrics.merge(raw, metrics.metric_points(raw, carry=metrics.HEAD))


def _flat_trace(t: DataFrame) -> DataFrame:
    return t.select("trace_id", "service_name", traces.display_name().alias("display_name"), F.col("root.span_id").alias("root_span_id"), F.coalesce("root.status_code", F.lit("Unset")).alias("root_status"),
        "span_count", "start_ns", "duration_ns", "has_error", "first_seq")


POINT_KEYS = ["service_name", "metric_name", "attr_key", "arrival_seq"]


def span_dedup(spark, d):
    return _spans(spark, d).select("trace_id", "span_id", "parent_span_id", "name", "service_name", "start_ns", "duration_ns", "status_code", "arrival_seq")


def span_dedup_reference(spark, d):
    s = canonical.spans(table(spark, d, "spans")).select("trace_id", "span_id", "batch_seq", "arrival_seq")
    return traces.dedup_spans(s, "reference").select("trace_id", "span_id", "arrival_seq")


def trace_list(spark, d):
    return _flat_trace(_traces(spark, d))


def trace_list_page(spark, d):
    """L1 and L3: the second page of fifty, newest first."""
    return _flat_trace(retention.page(_traces(spark, d), 50, 50, "first_seq"))


def trace_root_span(spark, d):
    return _traces(spark, d).filter("root is not null").select("trace_id", F.col("root.span_id").alias("span_id"), F.col("root.name").alias("name"), F.col("root.duration_ns").alias("duration_ns"))


def trace_service_label(spark, d):
    return _traces(spark, d).select("trace_id", "service_name")


def trace_errors_first(spark, d):
    """A report of the hundred traces to look at first."""
    return traces.errors_first(_traces(spark, d)).limit(100).select("trace_id", "has_error", "duration_ns")


def trace_by_id(spark, d):
    """J6 for the smallest trace id there is."""
    t = _traces(spark, d)
    least = table(spark, d, "spans").select(F.lower("trace_id").alias("t")).filter("t <> ''").agg(F.min("t")).first()[0]
    return _flat_trace(traces.by_id(t, least or "none"))


def trace_bounds(spark, d):
    return graph.bounds(_traces(spark, d))


def span_trace(spark, d):
    return traces.with_trace(_slim(spark, d), _traces(spark, d)).select("trace_id", "span_id", "arrival_seq", "trace_service", "trace_spans")


def trace_logs(spark, d):
    return correlate.trace_logs(_traces(spark, d), _logs(spark, d))


def trace_log_counts(spark, d):
    return correlate.trace_log_counts(_traces(spark, d), _logs(spark, d))


def log_trace_edge(spark, d):
    return correlate.log_trace(_logs(spark, d), _traces(spark, d))


def log_span_edge(spark, d):
    return correlate.log_span(_logs(spark, d), _slim(spark, d))


def span_parent(spark, d):
    s = _slim(spark, d).select("trace_id", "span_id", "parent_span_id", "name", "arrival_seq")
    return graph.with_parent(s, ["name"]).select("trace_id", "span_id", "arrival_seq", "parent_name")


def orphan_spans(spark, d):
    return graph.orphans(_slim(spark, d).select("trace_id", "span_id", "parent_span_id", "arrival_seq"))


def spans_with_children(spark, d):
    return graph.with_children(_slim(spark, d).filter("span_id <> ''").select("trace_id", "span_id", "parent_span_id", "arrival_seq")).select("trace_id", "span_id")


def service_nodes(spark, d):
    return graph.service_nodes(_slim(spark, d))


def service_edges(spark, d):
    return graph.service_edges(_slim(spark, d))


def service_edges_resolved(spark, d):
    s = _slim(spark, d)
    return graph.resolved_edges(graph.service_edges(s), graph.service_nodes(s))


def service_radius(spark, d):
    return graph.node_sizes(graph.service_nodes(_slim(spark, d))).withColumn("radius", F.round("radius", 6))


def span_tree(spark, d):
    return graph.span_tree(_slim(spark, d)).select("trace_id", "span_id", "depth", "has_children", "position")


def span_tree_collapsed(spark, d):
    """W13 with every span of depth 1 collapsed."""
    from teleloom.plans.storage import Workspace

    flat = Workspace(spark, "collapsed").put("flat", graph.span_tree(_slim(spark, d)))
    return graph.collapse(flat, flat.filter("depth = 1")).select("trace_id", "span_id", "depth")


def waterfall_bars(spark, d):
    s = _slim(spark, d)
    return graph.waterfall_bars(s.filter("span_id <> ''"), traces.rollup(s))


def timeline_ticks(spark, d):
    return graph.timeline_ticks(_traces(spark, d))


def trace_services(spark, d):
    s = _slim(spark, d)
    return graph.services_present(graph.span_tree(s), s)


def span_events(spark, d):
    """The events of the spans, one row each."""
    e = _spans(spark, d).select("trace_id", "span_id", F.posexplode("events").alias("event_index", "e"))
    return e.select("trace_id", "span_id", "event_index", F.col("e.name").alias("name"), F.col("e.ts_ns").alias("ts_ns"), canonical.attr_key("e.attributes").alias("attributes"))


def resource_service(spark, d):
    """The service named by a span's resource, in plain text."""
    s = table(spark, d, "spans")
    value = F.try_element_at("resource", F.lit("service.name"))
    return s.select("arrival_seq", F.coalesce(F.when(value.isNotNull(), series.plain(value)), F.lit("")).alias("service"))


def span_duration(spark, d):
    """P7 and P12."""
    return canonical.spans(table(spark, d, "spans")).select("arrival_seq", "duration_ns", (F.col("duration_ns") / 1e6).alias("duration_ms"))


def unset_ids(spark, d):
    """How many spans have an unset trace, span or parent id."""
    s = table(spark, d, "spans")
    n = lambda c: F.count_if(F.coalesce(is_zero_id(c), F.lit(True))).alias(c)
    return s.agg(n("trace_id"), n("span_id"), n("parent_span_id"))


def nonfinite_filter(spark, d):
    return metrics.skipped(_raw(spark, d))


def metric_passthrough(spark, d):
    return metrics.passthrough(_raw(spark, d)).select(*POINT_KEYS, "value", "count")


def metric_delta(spark, d):
    return metrics.number_deltas(_raw(spark, d)).select(*POINT_KEYS, "value")


def metric_delta_ttl(spark, d):
    return metrics.number_deltas(_raw(spark, d), TTL_NS).select(*POINT_KEYS, "value")


def metric_hist_delta(spark, d):
    return metrics.distribution_deltas(_raw(spark, d)).select(*POINT_KEYS, "value", "count", "sum", "min", "max")


def metric_points(spark, d):
    return _points(spark, d).select(*POINT_KEYS, "ts_ns", "value", "count", "sum", "min", "max")


def metric_merge(spark, d):
    return _metrics(spark, d).select("service_name", "metric_name", "description", "unit", "metric_type", "point_count", F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"))


def metric_last_points(spark, d):
    return metrics.last_points(_points(spark, d), 100).select("service_name", "metric_name", "arrival_seq")


def metric_latest(spark, d):
    return metrics.latest(_points(spark, d), metrics.METRIC)


def series_latest(spark, d):
    return metrics.latest(_points(spark, d), metrics.SERIES)


def series_newest(spark, d):
    """W7 with room for a thousand series."""
    return metrics.newest_series(_raw(spark, d), CAP)


def series_points(spark, d):
    """The points of each series numbered in order of time."""
    p = _points(spark, d)
    return rank_by_key(p.select(*metrics.SERIES, "ts_ns", "arrival_seq", "value"), metrics.SERIES, [F.floor(F.col("ts_ns") / F.lit(10**6)), F.col("arrival_seq")], "n")


def series_facet(spark, d):
    """Points and mean of each series by the attribute ``zone``."""
    p = series.facet_series(_points(spark, d), ["zone"])
    return p.groupBy(*metrics.METRIC, "series").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


def series_colours(spark, d):
    return series.colours(_points(spark, d))


def axis_domain(spark, d):
    return series.axis_domain(_points(spark, d))


def nearest_point(spark, d):
    """J8 at a fixed time, 6 March 2026, noon."""
    return series.nearest(_points(spark, d), 1772798400 * 10**9)


def attr_cardinality(spark, d):
    return series.cardinality(_points(spark, d))


def metric_facets(spark, d):
    return series.facets(_points(spark, d))


def metric_any_attributes(spark, d):
    return series.any_attributes(_points(spark, d))


def metric_unit(spark, d):
    return table(spark, d, "metric_points").select("metric_name", F.coalesce("unit", F.lit("")).alias("declared")).distinct().select("metric_name", "declared", catalog.metric_unit(F.col("metric_name"), F.lit("")).alias("by_name"), catalog.metric_unit(F.col("metric_name"), F.col("declared")).alias("unit"))


def metrics_by_name(spark, d):
    """L4: metrics numbered by name."""
    m = _metrics(spark, d).select("metric_name", "service_name", "point_count")
    return rank_by_key(m, [], [F.col("metric_name"), F.col("service_name")], "n")


def logs_page(spark, d):
    """L1: the newest fifty logs."""
    return retention.page(_logs(spark, d), 50, 0).select("arrival_seq", "ts_ns", "service_name", "severity_text", "body")


def logs_by_trace(spark, d):
    """The logs of the trace with the smallest id, newest first."""
    logs = _logs(spark, d)
    least = logs.filter("trace_id <> ''").agg(F.min("trace_id")).first()[0]
    return retention.page(correlate.by_trace(logs, least or "none"), 0, 0).select("arrival_seq", "trace_id", "body")


def search_traces(spark, d):
    return search.search_traces(_traces(spark, d), "ORDERS").select("trace_id")


def search_logs(spark, d):
    """P18 with a character that LIKE would take for a wildcard."""
    return search.search_logs(_logs(spark, d), "_").select("arrival_seq")


def search_metrics(spark, d):
    return search.search_metrics(_metrics(spark, d), "Gauge").select("service_name", "metric_name")


def fmt_duration(spark, d):
    return canonical.spans(table(spark, d, "spans")).select("duration_ns").distinct().select("duration_ns", format.format_duration(F.col("duration_ns")).alias("text"))


def fmt_metric_value(spark, d):
    """F6 to F11 over all readings."""
    v = table(spark, d, "metric_points").select("value", F.coalesce("unit", F.lit("")).alias("unit")).filter("value is not null").distinct()
    return v.select("unit", F.when(F.isnan("value"), "NaN").otherwise(F.col("value").cast("string")).alias("v"), format.format_metric_value(F.col("value"), F.col("unit")).alias("text")).filter("v <> ''")


def fmt_bytes(spark, d):
    return table(spark, d, "spans").select("duration_ns").filter("duration_ns is not null").distinct().select("duration_ns", format.format_bytes(F.col("duration_ns").cast("double")).alias("text"))


def severity_tone(spark, d):
    return _logs(spark, d).groupBy("severity_text").agg(F.count(F.lit(1)).alias("n")).withColumn("tone", format.severity_tone(F.col("severity_text")))


def status_tone(spark, d):
    return canonical.spans(table(spark, d, "spans")).groupBy("status_code").agg(F.count(F.lit(1)).alias("n")).withColumn("tone", format.status_tone(F.col("status_code")))


def log_clock(spark, d):
    """F4, F5 and F22."""
    return _logs(spark, d).select("arrival_seq", format.format_clock(F.col("ts_ns")).alias("clock"), format.short_id(F.col("trace_id")).alias("short"), format.truncate(F.col("body"), 24).alias("label"))


def retention_fifo(spark, d):
    """The spans of the thousand traces inserted last."""
    s = _slim(spark, d).select("trace_id", "span_id", "arrival_seq")
    return retention.fifo(s, ["trace_id"], CAP).groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"))


def newest_rank(spark, d):
    """W11 over all traces."""
    return retention.newest_rank(_traces(spark, d).select("trace_id", "first_seq"), "first_seq")


def signal_counts(spark, d):
    return retention.signal_counts(_traces(spark, d), _metrics(spark, d), _logs(spark, d))


def feed_union(spark, d):
    t = _traces(spark, d).select("trace_id", "span_count")
    m = _metrics(spark, d).select("service_name", "metric_name", "point_count")
    return feed.feed(t, m, _logs(spark, d).select("arrival_seq", "trace_id"))


def trace_merge(spark, d):
    """The traces after the spans of the later half of arrival came to those of the earlier."""
    s = canonical.spans(table(spark, d, "spans")).drop("attributes", "events", "resource")
    half = s.agg(F.floor((F.min("arrival_seq") + F.max("arrival_seq")) / 2)).first()[0] or 0
    return _flat_trace(traces.merge_rollup(s.filter(F.col("arrival_seq") <= half), s.filter(F.col("arrival_seq") > half)))


def trace_errors_rank(spark, d):
    """L7 over all traces."""
    t = _traces(spark, d).select("trace_id", "has_error", "duration_ns", "first_seq")
    return rank_by_key(t, [], [F.desc("has_error"), F.desc("duration_ns"), F.col("first_seq")], "n").drop("first_seq")


def metric_last_thousand(spark, d):
    """W9 with the number of points that is usual."""
    return metrics.last_points(_points(spark, d)).select("service_name", "metric_name", "arrival_seq")


def series_tracked(spark, d):
    """W7 with the number of series that is usual."""
    return metrics.newest_series(_raw(spark, d))


def points_newest(spark, d):
    """Points numbered from the newest on."""
    return rank_by_key(_points(spark, d).select("service_name", "metric_name", "arrival_seq"), [], [F.desc("arrival_seq")], "n")


def search_logs_of_trace(spark, d):
    """Logs with a letter in the trace of the smallest id that has any."""
    logs = _logs(spark, d)
    least = logs.filter("trace_id <> ''").agg(F.min("trace_id")).first()[0]
    return search.search_logs(logs, "E", least or "none").select("arrival_seq")


def _sizes(spark, d):
    return table(spark, d, "spans").filter("duration_ns is not null").select(F.abs("duration_ns").alias("n")).distinct()


def fmt_units(spark, d):
    """F2, F8, F9 and F11."""
    n = F.col("n").cast("double")
    return _sizes(spark, d).select("n", format.format_duration_as(F.col("n"), F.lit(5 * 10**8)).alias("of_ms"), format.format_seconds(n / 1e9).alias("seconds"), format.format_millis(n / 1e6).alias("millis"), format.compact(n).alias("compact"))


def fmt_relative(spark, d):
    """F3, as of 6 March 2026, noon."""
    return _logs(spark, d).select("arrival_seq", format.format_relative(F.floor(F.col("ts_ns") / F.lit(10**6)), 1772798400000).alias("text"))


QUERIES = {f.__name__: f for f in (
    trace_merge, trace_errors_rank, metric_last_thousand, series_tracked, points_newest, search_logs_of_trace, fmt_units, fmt_relative,
    trace_list, trace_list_page, span_dedup, span_dedup_reference, trace_root_span, trace_service_label, trace_errors_first, trace_by_id, trace_bounds, span_trace,
    trace_logs, trace_log_counts, log_trace_edge, log_span_edge, span_parent, orphan_spans, spans_with_children, service_nodes, service_edges, service_edges_resolved, service_radius,
    span_tree, span_tree_collapsed, waterfall_bars, timeline_ticks, trace_services, span_events, resource_service, span_duration, unset_ids,
    nonfinite_filter, metric_passthrough, metric_delta, metric_delta_ttl, metric_hist_delta, metric_points, metric_merge, metric_last_points, metric_latest, series_latest, series_newest,
    series_points, series_facet, series_colours, axis_domain, nearest_point, attr_cardinality, metric_facets, metric_any_attributes, metric_unit, metrics_by_name,
    logs_page, logs_by_trace, search_traces, search_logs, search_metrics, fmt_duration, fmt_metric_value, fmt_bytes, severity_tone, status_tone, log_clock,
    retention_fifo, newest_rank, signal_counts, feed_union,
)}
