"""Metric points: deltas, non-finite filter, merge and retention per metric.

All work on canonical raw points (``sources.canonical.raw_points``). Order is order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.plans.ordered import lag_by_key

SERIES = ["service_name", "metric_name", "attr_key"]
METRIC = ["service_name", "metric_name"]
#: The metric types with a distribution per window.
DISTRIBUTIONS = ("Histogram", "Summary", "ExponentialHistogram")
#: Idle time after which a series starts anew (nanoseconds).
TTL_NS = 600 * 10**9
POINT = ["service_name", "metric_name", "ts_ns", "value", "count", "sum", "min", "max", "attributes", "attr_key", "received_at", "arrival_seq"]


def is_distribution(c: str = "metric_type") -> Column:
    """P21."""
    return F.col(c).isin(*DISTRIBUTIONS)


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def numbers(raw: DataFrame) -> DataFrame:
    """Gauge and Sum points, an absent value being 0, without those whose value is not finite."""
    v = F.coalesce("value", F.lit(0.0))
    return raw.filter(F.col("metric_type").isin("Gauge", "Sum")).withColumn("value", v).filter(is_finite(v))


def skipped(raw: DataFrame) -> DataFrame:
    """(service_name, metric_name, skipped): how many points the non-finite filter drops."""
    bad = raw.filter(F.col("metric_type").isin("Gauge", "Sum")).filter(F.col("value").isNotNull() & ~is_finite(F.col("value")))
    return bad.groupBy(*METRIC).agg(F.count(F.lit(1)).alias("skipped"))


def window_mean(count: Column, total: Column) -> Column:
    """Sum / count, 0 where there is no sum or the count is not positive."""
    return F.coalesce(F.when(total.isNotNull() & (count > 0), total / count), F.lit(0.0))


def _expired(ttl_ns: int | None) -> Column:
    """The series was idle for longer than the TTL (by received_at) before this point."""
    if ttl_ns is None:
        return F.lit(False)
    return F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("prev_received_at").cast("timestamp")) > ttl_ns // 1000, F.lit(False))


def classified(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Raw points with ``_how`` they are shown: ``pass`` (as they are), ``number`` or ``distribution`` (as the delta from
    the one before in their series). What is not shown is left out: non-finite numbers, distributions without a count
    where it is needed and, with ``strict``, with a non-finite sum."""
    kind, cumulative = F.col("metric_type"), F.col("temporality") == "Cumulative"
    v = F.coalesce("value", F.lit(0.0))
    number = kind.isin("Gauge", "Sum") & is_finite(v)
    dist = is_distribution()
    if strict:
        dist = dist & (F.col("sum").isNull() | is_finite(F.col("sum")))
    counted = F.col("count").isNotNull() & ~F.isnan("count")
    how = (F.when(number & (kind == "Sum") & cumulative & F.col("is_monotonic"), "number").when(number, "pass")
           .when(dist & (cumulative | (kind == "Summary")), F.when(counted, "distribution")).when(dist, "pass"))
    return raw.withColumns({"_how": how, "value": F.when(kind.isin("Gauge", "Sum"), v).otherwise(F.col("value"))}).filter("_how is not null")


def _deltas(known: DataFrame, ttl_ns: int | None, carry: list[str]) -> DataFrame:
    """Deltas of points that ``classified`` does not pass, numbers and distributions in one go."""
    x = lag_by_key(known, [*SERIES, "_how"], "arrival_seq", ["value", "count", "sum", "received_at"])
    number = F.col("_how") == "number"
    n, s = F.col("count") - F.col("prev_count"), F.col("sum") - F.col("prev_sum")
    ok = F.when(number, F.col("value") >= F.col("prev_value")).otherwise(F.col("count") >= F.col("prev_count")) & ~_expired(ttl_ns)
    none = F.lit(None).cast("double")
    new = {"value": F.when(number, F.col("value") - F.col("prev_value")).otherwise(window_mean(n, s)), "count": F.when(number, none).otherwise(n), "sum": F.when(number, none).otherwise(s), "min": F.when(number, none).otherwise(F.col("min")), "max": F.when(number, none).otherwise(F.col("max"))}
    return x.filter(ok).select(*[new[c].alias(c) if c in new else F.col(c) for c in [*POINT, *carry]])


def _passed(known: DataFrame, carry: list[str]) -> DataFrame:
    dist = is_distribution()
    new = {"value": F.when(dist, window_mean(F.col("count"), F.col("sum"))).otherwise(F.col("value"))} | {c: F.when(dist, F.col(c)) for c in ("count", "sum", "min", "max")}
    return known.select(*[new[c].alias(c) if c in new else F.col(c) for c in [*POINT, *carry]])


def number_deltas(raw: DataFrame, ttl_ns: int | None = None) -> DataFrame:
    """Cumulative monotonic Sums as deltas.

    The first point of a series, one whose value is below the one before (a reset) and, with ``ttl_ns``, one after an
    idle time give no row and become the baseline; an equal value gives 0.
    """
    return _deltas(classified(raw).filter("_how = 'number'"), ttl_ns, [])


def distribution_deltas(raw: DataFrame, ttl_ns: int | None = None, strict: bool = True) -> DataFrame:
    """Cumulative histograms, and summaries whatever their temporality, as deltas of count and sum.

    A reset is told by the count alone; the delta of the sum may be negative, and is null where either sum is
    missing. min and max pass through; value is the window's mean. ``strict`` leaves points with a non-finite sum out.
    """
    return _deltas(classified(raw, strict).filter("_how = 'distribution'"), ttl_ns, [])


def passthrough(raw: DataFrame, strict: bool = True) -> DataFrame:
    """W5 and the other half of W3 and W4: gauges, non-cumulative or non-monotonic sums, delta histograms."""
    return _passed(classified(raw, strict).filter("_how = 'pass'"), [])


def metric_points(raw: DataFrame, ttl_ns: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """All points as the reference shows them, with further columns of the raw points to ``carry``."""
    known = classified(raw)
    return _passed(known.filter("_how = 'pass'"), carry or []).unionByName(_deltas(known.filter("_how <> 'pass'"), ttl_ns, carry or []))


#: What a metric takes over from its points.
HEAD = ["description", "unit", "metric_type", "resource"]


def merge(raw: DataFrame, points: DataFrame) -> DataFrame:
    """One row per (service_name, metric_name) that has points.

    Description, unit, type and resource are the first seen among rows that gave a point, received_at the last; point_count counts all points
    (``last_points`` bounds them). Points that carry HEAD are not joined to the raw ones.
    """
    head = points
    if not set(HEAD) <= set(points.columns):
        head = raw.select(*METRIC, *HEAD, "arrival_seq").join(points.select("arrival_seq", "received_at"), "arrival_seq")
    return head.groupBy(*METRIC).agg(
        *[F.min_by(c, "arrival_seq").alias(c) for c in HEAD], F.max("received_at").alias("received_at"),
        F.count(F.lit(1)).alias("point_count"), F.min("arrival_seq").alias("first_seq"))


def last_observed(raw: DataFrame, ttl_ns: int | None = None, cap: int = 50_000) -> DataFrame:
    """The raw points that the next delta of each series is taken from: its last one, unless it is older
    than ``ttl_ns`` before the newest of all; of more than ``cap`` series those seen last."""
    last = classified(raw).filter("_how <> 'pass'").select(*raw.columns, "_how")
    last = last.groupBy(*SERIES, "_how").agg(F.max_by(F.struct(*raw.columns), "arrival_seq").alias("x")).select("x.*")
    if ttl_ns is not None:
        now = raw.agg(F.max(F.unix_micros(F.col("received_at").cast("timestamp"))).alias("_now"))
        last = last.join(F.broadcast(now), F.unix_micros(F.col("received_at").cast("timestamp")) >= F.col("_now") - ttl_ns // 1000, "left_semi")
    return last.orderBy(F.desc("arrival_seq")).limit(cap)


def last_points(points: DataFrame, n: int = 1000) -> DataFrame:
    """The ``n`` last arrived points of each metric, all its series together.

    A window with a limit on its rank keeps at most n rows of a key in each task before the shuffle.
    """
    w = Window.partitionBy(*METRIC).orderBy(F.desc("arrival_seq"))
    return points.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def latest(points: DataFrame, keys: list[str]) -> DataFrame:
    """P20 (keys METRIC) and L8 (keys SERIES): the value of the last arrived point."""
    return points.groupBy(*keys).agg(F.max_by("value", "arrival_seq").alias("value"), F.max("arrival_seq").alias("arrival_seq"))


def newest_series(raw: DataFrame, cap: int = 50_000) -> DataFrame:
    """The series that stay when at most ``cap`` are tracked: those last seen most recently."""
    return raw.groupBy(*SERIES).agg(F.max("arrival_seq").alias("last_seq")).orderBy(F.desc("last_seq")).limit(cap)
