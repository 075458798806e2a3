"""Per-period aggregates by event time that late records correct until the period is closed.

The store is a table of mergeable partial aggregates, one row for each key, event period and arrival period. A batch
adds partials for its own records only; a period's figure is the sum of its partials, so it is corrected by reading
once more. Records that arrive after their period is closed are refused and counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.plans.storage import create_if_absent, delete, subfolders

PERIOD_NS = 600 * 10**9
LATENESS_NS = 7200 * 10**9


def period_start(c: Column, period_ns: int) -> Column:
    return c - F.pmod(c, F.lit(period_ns))


def partials(logs: DataFrame, period_ns: int = PERIOD_NS, lateness_ns: int = LATENESS_NS, batch: Column | None = None) -> DataFrame:
    """(service_name, period_ns, arrival_period_ns, batch, accepted, refused, errors): the partial aggregates of a batch of logs.

    Event time is ts_ns or, where that is 0 or null, observed_ts_ns; arrival is observed_ts_ns or, where that is 0
    or null, the event time. Records without either have no period and are left out. A null service is ``''``.
    Repeated rows count as rows. The sums are taken before the shuffle, so one service may hold any share.
    """
    ts, seen = F.nullif(F.col("ts_ns"), F.lit(0)), F.nullif(F.col("observed_ts_ns"), F.lit(0))
    rows = logs.select(F.coalesce("service_name", F.lit("")).alias("service_name"), F.coalesce(ts, seen).alias("event"), F.coalesce(seen, ts).alias("arrival"), (F.coalesce("severity_number", F.lit(0)) >= 17).alias("bad"), (batch if batch is not None else F.lit(0)).cast("bigint").alias("batch"))
    rows = rows.filter("event is not null").withColumns({"period_ns": period_start(F.col("event"), period_ns), "arrival_period_ns": period_start(F.col("arrival"), period_ns)})
    ok = F.col("arrival") < F.col("period_ns") + period_ns + lateness_ns
    return rows.groupBy("service_name", "period_ns", "arrival_period_ns", "batch").agg(
        F.count(F.when(ok, 1)).alias("accepted"), F.count(F.when(~ok, 1)).alias("refused"), F.count(F.when(ok & F.col("bad"), 1)).alias("errors"))


def merge_partials(partial: DataFrame) -> DataFrame:
    """The same partials with those of all batches added up (compaction of the store)."""
    return partial.groupBy("service_name", "period_ns", "arrival_period_ns").agg(*(F.sum(c).alias(c) for c in ("accepted", "refused", "errors")))


def corrections(partial: DataFrame) -> DataFrame:
    """(service_name, period_ns, arrival_period_ns) of each later arrival period that changed a period's figure."""
    return merge_partials(partial).filter("accepted > 0 and arrival_period_ns > period_ns").select("service_name", "period_ns", "arrival_period_ns")


def period_totals(partial: DataFrame, as_of_ns: int | None = None, period_ns: int = PERIOD_NS, lateness_ns: int = LATENESS_NS) -> DataFrame:
    """The figure of each (service_name, period_ns) as known at ``as_of_ns`` (default: all that arrived).

    ``on_time`` arrived within its period or before it, ``late`` after; ``closed`` says whether corrections are over.
    """
    p = partial if as_of_ns is None else partial.filter(F.col("arrival_period_ns") <= as_of_ns)
    late = F.col("arrival_period_ns") > F.col("period_ns")
    out = p.groupBy("service_name", "period_ns").agg(
        F.sum("accepted").alias("n"), F.sum(F.when(late, F.col("accepted")).otherwise(0)).alias("late"), F.sum("errors").alias("errors"), F.sum("refused").alias("refused"))
    closed = F.lit(None).cast("boolean") if as_of_ns is None else F.col("period_ns") + period_ns + lateness_ns <= as_of_ns
    return out.withColumn("closed", closed)


PARTIAL = "service_name string, period_ns bigint, arrival_period_ns bigint, batch bigint, accepted bigint, refused bigint, errors bigint"


class LateStore:
    """Partial aggregates in a folder, added batch by batch and added up on reading.

    A batch has a folder of its own, which a new try overwrites: every batch counts once. ``compact`` adds up all
    batches up to one; a marker that is created last makes the sum valid in place of these batches, so that a reader
    sees either. Batches are added in rising order, by one writer.
    """

    def __init__(self, spark: SparkSession, root: str, period_ns: int = PERIOD_NS, lateness_ns: int = LATENESS_NS):
        self.spark, self.root, self.period_ns, self.lateness_ns = spark, root, period_ns, lateness_ns

    def add(self, logs: DataFrame, batch: int) -> None:
        """Adds the partials of a batch; records of closed periods are refused and counted. One file: partials are few."""
        if batch <= self._summed():
            return  # tried again after it was added up
        partials(logs, self.period_ns, self.lateness_ns, F.lit(batch)).write.mode("overwrite").parquet(f"{self.root}/b={batch}")

    def _summed(self) -> int:
        return max([int(n[5:]) for n in subfolders(self.spark, self.root) if n.startswith("done-")], default=-1)

    def _batches(self) -> list[int]:
        return sorted(int(n[2:]) for n in subfolders(self.spark, self.root) if n.startswith("b="))

    def read(self) -> DataFrame:
        """The partials of all batches; an empty table if there are none."""
        upto = self._summed()
        paths = [f"{self.root}/b={b}" for b in self._batches() if b > upto] + ([f"{self.root}/sum-{upto}"] if upto >= 0 else [])
        return self.spark.read.schema(PARTIAL).parquet(*paths) if paths else self.spark.createDataFrame([], PARTIAL)

    def compact(self) -> None:
        """Adds up all batches there are, and deletes what the sum stands for."""
        old, batches = self._summed(), self._batches()
        new = [b for b in batches if b > old]
        if not new:
            return
        merge_partials(self.read()).withColumn("batch", F.lit(new[-1]).cast("bigint")).select(*[c.split()[0] for c in PARTIAL.split(", ")]).write.mode("overwrite").parquet(f"{self.root}/sum-{new[-1]}")
        create_if_absent(self.spark, f"{self.root}/done-{new[-1]}", b"")
        for name in [f"b={b}" for b in batches] + ([f"done-{old}", f"sum-{old}"] if old >= 0 else []):
            delete(self.spark, f"{self.root}/{name}")
