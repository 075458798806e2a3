"""Bounded retention and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.plans.ordered import rank_by_key


def fifo(rows: DataFrame, keys: list[str], cap: int, order: str = "arrival_seq") -> DataFrame:
    """Rows of the ``cap`` keys that were inserted last, by their first arrival.

    Later rows of a key do not refresh its place. Exact as long as no key comes back after its eviction (see
    ``streaming.state`` for the sequential form). At most ``cap`` keys are sorted (a top-k) and joined.
    """
    if cap < 1:
        raise ValueError("a capacity must be at least 1")
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    kept = first.orderBy(F.desc("_first")).limit(cap).select(*keys)
    return rows.join(kept, keys, "left_semi").select(*rows.columns)


def newest_rank(rows: DataFrame, order: str = "arrival_seq", name: str = "rank") -> DataFrame:
    """1 for the newest row, 2 for the next; ranked in parallel over ranges."""
    return rank_by_key(rows, [], [F.desc(order)], name)


@dataclass
class Page:
    """Items of a page, the number of all items, and the limit and offset as they were asked for."""

    items: DataFrame
    total: int
    limit: int
    offset: int


def page(rows: DataFrame, limit: int = 50, offset: int = 0, order: str = "arrival_seq") -> DataFrame:
    """L1: newest first. A limit of 0 or less means all, a negative offset 0, an offset past the end no rows."""
    out = rows.orderBy(F.desc(order)).offset(max(offset, 0))
    return out.limit(limit) if limit > 0 else out


def connection(rows: DataFrame, limit: int = 50, offset: int = 0, order: str = "arrival_seq") -> Page:
    """L3: a page with its total; limit and offset are echoed raw."""
    return Page(page(rows, limit, offset, order), rows.count(), limit, offset)


def signal_counts(traces: DataFrame, metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """One row (trace_count, metric_count, log_count)."""
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return one(traces, "trace_count").join(one(metrics, "metric_count"), F.lit(True)).join(one(logs, "log_count"), F.lit(True))
