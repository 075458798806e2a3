"""Canonical forms of the three signals: ids in normal form, strings never null, time in nanoseconds.

Only named columns are taken, so further columns of an input, of whatever name, change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.functions.ids import normal_id


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c)


def spans(raw: DataFrame) -> DataFrame:
    """Canonical spans. A duration is end minus start and may be negative; an unfinished span has neither end nor duration."""
    return raw.select(
        normal_id("trace_id").alias("trace_id"), normal_id("span_id").alias("span_id"), normal_id("parent_span_id").alias("parent_span_id"),
        text("name"), text("kind"), text("service_name"), "start_ns", "end_ns", (F.try_subtract("end_ns", "start_ns")).alias("duration_ns"),
        F.coalesce("status_code", F.lit("Unset")).alias("status_code"), text("status_message"), "attributes", "events", "resource", "batch_seq", "arrival_seq")


def logs(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.coalesce("ts_ns", F.lit(0)).alias("ts_ns"), F.coalesce("observed_ts_ns", F.lit(0)).alias("observed_ts_ns"), normal_id("trace_id").alias("trace_id"), normal_id("span_id").alias("span_id"),
        F.coalesce("severity_number", F.lit(0)).alias("severity_number"), text("severity_text"), text("body"), text("service_name"), "attributes", "resource", "arrival_seq")


def raw_points(raw: DataFrame) -> DataFrame:
    return raw.select(
        text("service_name"), text("metric_name"), text("description"), text("unit"), text("metric_type"), F.coalesce("temporality", F.lit("Unspecified")).alias("temporality"),
        F.coalesce("is_monotonic", F.lit(False)).alias("is_monotonic"), "ts_ns", "value", "count", "sum", "min", "max", "attributes", attr_key("attributes").alias("attr_key"), "resource", "received_at", "batch_seq", "arrival_seq")


def attr_key(c: str) -> Column:
    """Identity of an attribute set: ``k=json`` for each entry in order of keys, joined by ``, ``; '' for none."""
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return F.array_join(entries, ", ")
