"""The live feed: signals in one stream of messages (U1), and export as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message(df: DataFrame, kind: str) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.to_json(F.struct(*df.columns)).alias("data"))


def feed(traces: DataFrame, metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """(type, data): the rows of the three signals as JSON."""
    return message(traces, "traces").unionByName(message(metrics, "metrics")).unionByName(message(logs, "logs"))


def export_json(df: DataFrame) -> DataFrame:
    """One column ``json``: each row as indented JSON."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("json"))


def export_name(trace_id: str) -> str:
    """File name of an exported trace."""
    return f"trace-{trace_id[:8]}.json"
