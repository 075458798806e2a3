"""Logs joined to traces and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.functions.ids import pack_ids
from teleloom.plans.skew import lookup_join
from teleloom.plans.storage import Workspace


def by_trace(logs: DataFrame, trace_id: str | None) -> DataFrame:
    """Logs of a trace; no filter for '' or None."""
    return logs.filter(F.col("trace_id") == trace_id.lower()) if trace_id else logs


def trace_logs(traces: DataFrame, logs: DataFrame) -> DataFrame:
    """(trace_id, arrival_seq, body, severity_text) of each log of a known trace, one row per log.

    Rows, not arrays: a trace may have any number of logs. Newest first is descending arrival_seq.
    """
    known = logs.filter("trace_id <> ''").select("trace_id", "arrival_seq", "body", "severity_text")
    return lookup_join(known, traces.select("trace_id").withColumn("_t", F.lit(True)), "trace_id").drop("_t")


def trace_log_counts(traces: DataFrame, logs: DataFrame) -> DataFrame:
    """(trace_id, log_count), 0 for traces without logs."""
    n = logs.filter("trace_id <> ''").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    return traces.select("trace_id").join(n, "trace_id", "left").select("trace_id", F.coalesce("n", F.lit(0)).alias("log_count"))


def log_trace(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """(arrival_seq, trace_id, trace_service, span_count); nulls where the id is unset or the trace unknown."""
    t = traces.filter("trace_id <> ''").select("trace_id", F.col("service_name").alias("trace_service"), "span_count")
    return lookup_join(logs.select("arrival_seq", "trace_id"), t, "trace_id", "left").select("arrival_seq", "trace_id", "trace_service", "span_count")


def log_span(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """(arrival_seq, trace_id, span_id, span_name, span_service) by deduplicated spans, of which the first arrived wins."""
    key = F.when((F.col("trace_id") != "") & (F.col("span_id") != ""), pack_ids(F.col("trace_id"), F.col("span_id")))
    left = Workspace(logs.sparkSession, "logs").put("logs", logs.select("arrival_seq", "trace_id", "span_id", key.alias("_key")))
    right = spans.filter("span_id <> ''").select(pack_ids(F.col("trace_id"), F.col("span_id")).alias("_key"), F.col("name").alias("span_name"), F.col("service_name").alias("span_service"))
    return lookup_join(left, right, "_key", "left").select("arrival_seq", "trace_id", "span_id", "span_name", "span_service")
