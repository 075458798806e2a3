"""Joins that keep their shape when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.plans.storage import Workspace

#: A key is hot when it holds more than one row in so many. At most this many keys can be hot, which bounds what is broadcast.
HOT_SHARE = 64


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE, total: int | None = None) -> list:
    """Values of ``key`` that hold more than 1/share of the rows; fewer than ``share`` values, whatever the data.

    ``total`` is the number of rows where the caller knows it.

    The count is a partial aggregation before its shuffle; the threshold is applied on the executors.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n")).limit(share).collect()  # at most `share` rows, each a key
    total = df.count() if total is None else total
    return [r[key] for r in top if r["n"] * share > max(total, share * 1000)]


def _stored(df: DataFrame) -> DataFrame:
    """``df`` itself if its plan only reads, filters and selects, else a stored copy."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    costly = ("Join ", "Aggregate ", "Window ", "Generate ", "MapIn", "FlatMapGroups", "Sort ")
    return Workspace(df.sparkSession, "left").put("rows", df) if any(x in plan for x in costly) else df


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has at most one row per ``key``.

    Rows of hot keys meet their at most ``HOT_SHARE`` partner rows in a broadcast; all others go through a shuffle.
    ``left`` is read twice or more: it is stored first unless it comes straight from files. ``total`` is its number
    of rows if known.
    """
    if total is not None and total <= HOT_SHARE * 1000:
        return left.join(right, key, how)  # no key can be hot
    left = _stored(left)
    hot = hot_keys(left, key, total=total)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.filter(F.col(key).isin(hot)))
    return left.filter(~is_hot).join(right.filter(~F.col(key).isin(hot)), key, how).unionByName(left.filter(is_hot).join(few, key, how))
