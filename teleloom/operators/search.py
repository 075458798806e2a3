"""Case-insensitive substring search (P15, P17-P19). ``%`` and ``_`` are ordinary characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(text: str, fields: list[Column]) -> Column:
    q = F.lower(F.lit(text))
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(f, F.lit(""))), q)
    return hit


def search_traces(traces: DataFrame, text: str) -> DataFrame:
    """Root name (else first span's name), service, trace id, root status (else ``Unset``); '' finds all."""
    fields = [F.coalesce("root.name", "first_name"), F.col("service_name"), F.col("trace_id"), F.coalesce("root.status_code", F.lit("Unset"))]
    return traces.filter(_any(text, fields)) if text else traces


def search_logs(logs: DataFrame, text: str, trace_id: str | None = None) -> DataFrame:
    """Body, service, severity text, trace id; together with the trace filter if one is given."""
    out = logs.filter(_any(text, [F.col(c) for c in ("body", "service_name", "severity_text", "trace_id")])) if text else logs
    return out.filter(F.col("trace_id") == trace_id) if trace_id else out


def search_metrics(metrics: DataFrame, text: str) -> DataFrame:
    """Name, service, type, description."""
    return metrics.filter(_any(text, [F.col(c) for c in ("metric_name", "service_name", "metric_type", "description")])) if text else metrics
