"""The queries of the general data problems (p2 to p7), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.functions.ids import normal_id, pack_ids
from teleloom.operators import grid, hierarchy, late, spikes
from teleloom.operators.dedup import DedupStore
from teleloom.operators.nested import NestedTables
from teleloom.plans.storage import Workspace
from teleloom.sources.tables import table

SOURCE = ["service_name", "metric_name", "instance_id"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.endless(table(spark, sf_dir, "spans"))


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "spans"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, sf_dir, "spans")))


def _gauge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular_grid(table(spark, sf_dir, "metric_points"), SOURCE, extra=F.col("metric_type") == "Gauge")


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gauge_grid(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gauge_grid(spark, sf_dir).filter("state <> 'observed'").select(*SOURCE, "slot_ns")


def p3_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the grid, how many readings fell into it, and whether it was observed."""
    return _gauge_grid(spark, sf_dir).select(*SOURCE, "slot_ns", "readings", (F.col("state") == "observed").alias("observed"))


def late_store(spark: SparkSession, sf_dir: str, batches: int = 4) -> late.LateStore:
    """All logs taken into a new store in ``batches`` runs of arrival of about equal length; half of them added up in between."""
    logs = table(spark, sf_dir, "logs")
    lo, hi = logs.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    store = late.LateStore(spark, Workspace(spark, "late").root)
    lo, hi = (0, 0) if lo is None else (lo, hi)
    cuts = [lo + (hi - lo + 1) * i // batches for i in range(batches + 1)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = (F.col("arrival_seq") >= a) & (F.col("arrival_seq") < b)
        store.add(logs.filter(part | F.col("arrival_seq").isNull() if i == 0 else part), i)
        if i + 1 == batches // 2:
            store.compact()
    return store


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.corrections(late_store(spark, sf_dir).read())


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.period_totals(late_store(spark, sf_dir).read())


def p4_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by Structured Streaming: logs read as a stream, each micro-batch added to the store."""
    from teleloom.streaming.ingest import late_stream, table_stream

    ws = Workspace(spark, "late")
    store = late.LateStore(spark, ws.path("store"))
    query = late_stream(table_stream(spark, sf_dir, "logs"), store, ws.path("checkpoint"))
    query.awaitTermination()
    return late.period_totals(store.read())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NestedTables(table(spark, sf_dir, "trace_payloads")).attributes().select("payload_id", "span_index", "event_index", "attr_path")


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"trace_id": "traceId", "span_id": "spanId", "parent_span_id": "parentSpanId", "name": "name"}
    return NestedTables(table(spark, sf_dir, "trace_payloads")).spans().select("payload_id", "span_index", *[F.get_json_object("content", f"$.{k}").alias(c) for c, k in fields.items()])


def p5_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NestedTables(table(spark, sf_dir, "trace_payloads")).events().select("payload_id", "span_index", "event_index", F.get_json_object("content", "$.name").alias("name"))


def p5_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NestedTables(table(spark, sf_dir, "trace_payloads")).rejected.select("payload_id", "reason")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag(table(spark, sf_dir, "metric_points")).select("arrival_seq")


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag(table(spark, sf_dir, "metric_points"))


def p6_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag(table(spark, sf_dir, "metric_points")).filter("reason = 'impossible'").select("arrival_seq")


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with set ids as messages: all their columns, key and part (day of arrival)."""
    t, s = normal_id("trace_id"), normal_id("span_id")
    rows = table(spark, sf_dir, "spans").withColumns({"trace_id": t, "span_id": s, "part": F.coalesce(F.date_format("received_at", "yyyy-MM-dd"), F.lit("none"))})
    return rows.filter("trace_id <> '' and span_id <> ''").withColumn("key", pack_ids(F.col("trace_id"), F.col("span_id")))


def span_store(spark: SparkSession, sf_dir: str, batches: int = 3) -> DedupStore:
    """All spans taken into a new store in ``batches`` runs of export requests of about equal length."""
    rows = _deliveries(spark, sf_dir)
    lo, hi = table(spark, sf_dir, "spans").agg(F.min("batch_seq"), F.max("batch_seq")).first()
    store = DedupStore(spark, Workspace(spark, "dedup").root)
    if lo is None:
        store.merge(rows)
        return store
    cuts = [lo + (hi - lo + 1) * i // batches for i in range(batches + 1)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = (F.col("batch_seq") >= a) & (F.col("batch_seq") < b)
        store.merge(rows.filter(part | F.col("batch_seq").isNull() if i == 0 else part))
    return store


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_store(spark, sf_dir).losers()


def p7_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that stay: one whole row per trace_id and span_id, the one that arrived first."""
    return span_store(spark, sf_dir).read().select("arrival_seq", "trace_id", "span_id", "name", "service_name", "start_ns", "duration_ns", "status_code")


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p3_found, p3_grid, p3_states, p4_found, p4_periods, p4_stream, p5_found, p5_spans, p5_events, p5_rejected, p6_found, p6_reasons, p6_impossible, p7_found, p7_winners)}
