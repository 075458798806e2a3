"""Spans to traces: dedup, rollup, representative root, label, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.plans.skew import lookup_join

ROOT = ["span_id", "name", "service_name", "status_code", "start_ns", "duration_ns", "arrival_seq"]
_LOW = -(2**63)


def dedup_spans(spans: DataFrame, mode: str = "strict") -> DataFrame:
    """A5: of the spans of one trace_id and span_id, the one that arrived first.

    Spans with an unset span id have no identity and all stay. ``mode="reference"`` also keeps duplicates that came
    in the batch which created their trace (batch_seq). The aggregation is partial before its shuffle, so copies of
    one span may hold any share of the rows.
    """
    cols = spans.columns
    known = spans.filter("span_id <> ''")
    first = known.groupBy("trace_id", "span_id").agg(F.min_by(F.struct(*cols), "arrival_seq").alias("x")).select("x.*")
    out = first.unionByName(spans.filter("span_id = ''"))
    if mode == "strict":
        return out
    if mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")
    start = spans.groupBy("trace_id").agg(F.min("batch_seq").alias("first_batch"))
    early = lookup_join(spans, start, "trace_id").filter("batch_seq <=> first_batch").select(*cols)
    return early.unionByName(lookup_join(out, start, "trace_id").filter("not (batch_seq <=> first_batch)").select(*cols))


def rollup(spans: DataFrame) -> DataFrame:
    """A1-A3: one row per trace_id of deduplicated spans.

    span_count, start_ns, end_ns, duration_ns (not below 0), has_error, root (struct of ROOT; null if no span is
    parentless), service_name, first_seq, first_name. The root is the parentless span of the longest duration, ties
    to the first arrived; an unfinished span is shorter than any and ends where it starts. The label is the root's
    service or, if there is none or it is unset, that of the span that started first.
    """
    end = F.coalesce("end_ns", "start_ns")
    order = F.struct(F.coalesce("duration_ns", F.lit(_LOW)), -F.col("arrival_seq"))
    parentless = F.col("parent_span_id") == ""
    early = F.struct(F.coalesce("start_ns", F.lit(2**63 - 1)), F.col("arrival_seq"))
    g = spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"), F.min("start_ns").alias("start_ns"), F.max(end).alias("end_ns"), F.max(F.col("status_code") == "Error").alias("has_error"),
        F.max_by(F.when(parentless, F.struct(*ROOT)), F.when(parentless, order)).alias("root"), F.min_by("service_name", early).alias("_early"),
        F.min("arrival_seq").alias("first_seq"), F.min_by("name", "arrival_seq").alias("first_name"))
    return g.select("trace_id", "span_count", "start_ns", "end_ns", F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0)).alias("duration_ns"), "has_error", "root",
        F.coalesce(F.nullif(F.col("root.service_name"), F.lit("")), "_early").alias("service_name"), "first_seq", "first_name")


def merge_rollup(spans: DataFrame, more: DataFrame) -> DataFrame:
    """The rollup after ``more`` spans arrived; recomputed from the deduplicated union, so any split gives the same."""
    return rollup(dedup_spans(spans.unionByName(more)))


def reference_label(spans: DataFrame) -> DataFrame:
    """Q2: (trace_id, service_name) with a rootless trace's label taken from its first batch only."""
    first = spans.groupBy("trace_id").agg(F.min("batch_seq").alias("first_batch"))
    batch = lookup_join(spans, first, "trace_id").filter("batch_seq <=> first_batch")
    early = rollup(dedup_spans(batch.select(*spans.columns))).select("trace_id", F.col("service_name").alias("_first"))
    now = rollup(dedup_spans(spans))
    return now.join(early, "trace_id").select("trace_id", F.coalesce(F.nullif(F.col("root.service_name"), F.lit("")), "_first").alias("service_name"))


def display_name() -> Column:
    """root name, else first span name, else ``-``."""
    return F.coalesce(F.nullif(F.col("root.name"), F.lit("")), F.nullif(F.col("first_name"), F.lit("")), F.lit("-"))


def errors_first(traces: DataFrame) -> DataFrame:
    """Triage order."""
    return traces.orderBy(F.desc("has_error"), F.desc("duration_ns"), "first_seq")


def by_id(traces: DataFrame, trace_id: str) -> DataFrame:
    """The trace of an id (in any case); no row if there is none."""
    return traces.filter(F.col("trace_id") == trace_id.lower())


def with_trace(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """Each span with its trace's label, count and start."""
    t = traces.select("trace_id", F.col("service_name").alias("trace_service"), F.col("span_count").alias("trace_spans"), F.col("start_ns").alias("trace_start_ns"))
    return lookup_join(spans, t, "trace_id")


def nested(spans: DataFrame) -> DataFrame:
    """Traces with their spans as an array in order of arrival; for the traces of a page, as a trace may be large."""
    s = F.array_sort(F.collect_list(F.struct("arrival_seq", *[c for c in spans.columns if c not in ("arrival_seq", "trace_id")])))
    return spans.groupBy("trace_id").agg(s.alias("spans"))
