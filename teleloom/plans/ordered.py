"""Ordered computations per key that never bring a whole key into one task.

Spark's window sorts all rows of a key in one task. Where a key may hold a third of all rows, the rows of a key are
cut into runs of their order instead, worked on apart, and joined at their ends by a table of one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.plans.storage import Workspace

#: Values of the order column in a run; arrival_seq grows by one a row, so a run holds at most so many rows.
RUN = 100_000


def lag_by_key(df: DataFrame, keys: list[str], order: str, cols: list[str], run: int = RUN) -> DataFrame:
    """``df`` with ``prev_<col>`` of the row before in order of ``order`` (an integer, unique) within ``keys``.

    The first row of a key has nulls. Nulls in ``order`` come first.
    """
    df = df.withColumn("_run", F.coalesce(F.floor(F.col(order) / F.lit(run)), F.lit(-1)).cast("bigint"))
    inside = Window.partitionBy(*keys, "_run").orderBy(F.col(order).asc_nulls_first())
    here = df.withColumns({f"prev_{c}": F.lag(c).over(inside) for c in cols} | {"_first": F.row_number().over(inside) == 1})
    last = df.groupBy(*keys, "_run").agg(F.max_by(F.struct(*cols), F.coalesce(F.col(order), F.lit(-(2**62)))).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_run")
    before = last.withColumn("_before", F.lag("_last").over(over)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_run").alias("_r"), "_before").filter("_before is not null").withColumn("_f", F.lit(True))
    cond = F.col("_first") == F.col("_f")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = here.join(before, cond & (F.col("_run") == F.col("_r")), "left")
    filled = joined.withColumns({f"prev_{c}": F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")) for c in cols})
    return filled.drop("_run", "_first", "_r", "_before", "_f", *[f"_k_{k}" for k in keys])


def rank_by_key(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in order of ``order`` within ``keys`` (none: over all rows).

    Rows are range-partitioned by key and order, numbered within a partition, and moved on by the sizes of the
    partitions before (one row per key and partition). The partitioned rows are stored, so that a lost executor
    cannot change them.
    """
    ws = Workspace(df.sparkSession, "rank")
    cols = df.columns
    by = [F.col(k) for k in keys] + order
    placed = ws.put("placed", df.repartitionByRange(*by).withColumn("_pid", F.spark_partition_id()))
    inner = Window.partitionBy("_pid", *keys).orderBy(*order)
    sizes = placed.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    cond = F.col("_pid") == F.col("_p")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.withColumn("_i", F.row_number().over(inner)).join(starts, cond).select(*cols, (F.col("_start") + F.col("_i")).cast("bigint").alias(name))
