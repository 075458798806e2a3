"""Exactly one copy of messages that were delivered at least once, kept up batch by batch.

A store is a folder of historical partitions of whole messages plus an index of identifiers (identifier, order and
partition of its winner), cut into buckets by a hash of the identifier. A batch

1. is reduced to its own winners (partial aggregation, so a hot identifier costs no more than any other),
2. meets those buckets of the index its identifiers fall into; known ones tell which partitions they touch,
3. for partitions whose winner is beaten by an incoming copy, history and incoming rows are combined and single
   winners taken anew; exactly those partitions are written under a new version,
4. is made visible by the next manifest, one small file that is created only if no other writer has created it. A
   reader sees the old or the new set of files, never a mixture; every writer stages under names of its own, so that
   a job that dies or comes second leaves what was committed as it is.

The index grows by one run a batch. Runs are merged like a binary counter, the last into the one before while that is
not twice as long, so there are few of them and an identifier is rewritten a logarithmic number of times.

The winner of an identifier is the copy of the smallest order, ties going to the one whose partition sorts first.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from teleloom.plans.storage import create_if_absent, delete, exists, subfolders

#: Most orders (8 bytes each) that are broadcast; more are met in a shuffle.
FEW = 1_000_000


class DedupStore:
    """``key`` and ``order`` name columns of every batch; ``part`` names the column of its partition (a string).

    Rows whose key is null have no identifier: they are not messages of this store and are left out.
    ``order`` must be unique over all batches and not null. ``buckets`` is fixed when a store is made: so many that
    one bucket of the index is work for one task.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "key", order: str = "arrival_seq", part: str = "part", buckets: int = 16):
        self.spark, self.root, self.key, self.order, self.part, self.buckets = spark, root, key, order, part, buckets

    def _manifests(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in subfolders(self.spark, self.root) if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict:
        """{version, partitions: {name: [folders]}, index: [{folder, rows, buckets}], losers: [folders], schema} of the newest whole version."""
        for v in reversed(self._manifests()):
            rows = self.spark.read.text(f"{self.root}/manifest-{v:08d}.json", wholetext=True).collect()
            try:
                return json.loads(rows[0][0])
            except (ValueError, IndexError):  # its writer died while creating it: not committed
                continue
        return {"version": 0, "partitions": {}, "index": [], "losers": []}

    def _commit(self, m: dict) -> None:
        if not create_if_absent(self.spark, f"{self.root}/manifest-{m['version']:08d}.json", json.dumps(m).encode()):
            raise RuntimeError(f"version {m['version']} was committed by another writer")

    def _load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def _write_index(self, entries: DataFrame, folder: str) -> dict:
        """Stores (key, o, p, ...) in a folder for each bucket."""
        b = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        entries.withColumn("_b", b).repartition(self.buckets, "_b").write.partitionBy("_b").parquet(f"{self.root}/{folder}")
        got = sorted(int(n[3:]) for n in subfolders(self.spark, f"{self.root}/{folder}") if n.startswith("_b="))
        return {"folder": folder, "rows": self._load_index([{"folder": folder, "buckets": got}]).count() if got else 0, "buckets": got}

    def _load_index(self, runs: list[dict], buckets: set[int] | None = None) -> DataFrame | None:
        paths = [f"{r['folder']}/_b={b}" for r in runs for b in r["buckets"] if buckets is None or b in buckets]
        return self._load(paths) if paths else None

    def _without(self, rows: DataFrame, orders: DataFrame, n: int) -> DataFrame:
        """``rows`` but those of ``n`` orders (one column of ``orders``)."""
        return rows.join(F.broadcast(orders) if n <= FEW else orders, self.order, "left_anti")

    def merge(self, batch: DataFrame) -> None:
        """Takes in a batch; afterwards ``read`` has the winners and ``losers`` the orders of all rows that had to go."""
        m, versions = self.manifest(), self._manifests()
        v, key, order, part = max([m["version"], *versions]) + 1, self.key, self.order, self.part
        tag = f"{v}-{uuid.uuid4().hex[:12]}"
        batch = batch.filter(F.col(key).isNotNull())
        best = F.min(F.struct(F.col(order).alias("o"), F.col(part).alias("p"))).alias("w")
        mine = self._write_index(batch.groupBy(key).agg(best).select(key, F.col("w.o").alias("o"), F.col("w.p").alias("p")), f"mine-{tag}")
        runs = list(m["index"])
        known = self._load_index(runs, set(mine["buckets"]))
        new = mine
        if known is not None and mine["rows"]:
            known = known.groupBy(key).agg(F.min(F.struct("o", "p")).alias("h"))
            both = self._load_index([mine]).join(known, key, "left").select(key, "o", "p", F.col("h.o").alias("ho"), F.col("h.p").alias("hp"))
            # The entries of this version: identifiers that are new or whose incoming copy beats history.
            new = self._write_index(both.filter("ho is null or o < ho"), f"index-{tag}")
        entries = self._load_index([new]) if new["rows"] else self.spark.createDataFrame([], f"{key} {dict(batch.dtypes)[key]}, o bigint, p string")
        beaten = entries.filter("ho is not null").select(F.col("ho").alias(order), "hp") if new is not mine and new["rows"] else None
        # At most one name for each partition of the store: the manifest lists them all anyway.
        touched = sorted(r[0] for r in beaten.select("hp").distinct().collect()) if beaten is not None else []
        # order is unique, so rows are told apart without the (possibly hot) identifier
        lost = batch.select(order).join(entries.select(F.col("o").alias(order)), order, "left_anti")
        lost.write.parquet(f"{self.root}/losers-{tag}-a")
        losers = [f"losers-{tag}-a"]
        winners = self._without(batch, self._load(losers), self._load(losers).count())
        parts = {k: list(f) for k, f in m["partitions"].items()}
        if touched:
            beaten.select(order).write.parquet(f"{self.root}/losers-{tag}-b")
            losers.append(f"losers-{tag}-b")
            gone = self._load(losers[1:])
            kept = self._without(self._load([f for t in touched for f in parts[t]]), gone, gone.count())
            winners = kept.unionByName(winners)
            for t in touched:
                parts[t] = []
        at = f"data-{tag}"
        winners.withColumn("_part", F.col(part)).write.partitionBy("_part").parquet(f"{self.root}/{at}")
        for name in subfolders(self.spark, f"{self.root}/{at}"):
            if name.startswith("_part="):
                parts.setdefault(unquote(name[6:]), []).append(f"{at}/{name}")
        if new["rows"]:
            runs.append(new)
        if len(runs) > 1 and runs[-1]["rows"] * 2 > runs[-2]["rows"]:
            runs = self._compacted(runs, f"run-{tag}")
        self._commit({"version": v, "partitions": {k: f for k, f in parts.items() if f}, "index": runs, "losers": [*m["losers"], *losers], "schema": batch.schema.jsonValue()})

    def _compacted(self, runs: list[dict], folder: str) -> list[dict]:
        """``runs`` with the last ones merged into one, as far back as the lengths say."""
        total, keep = runs[-1]["rows"], len(runs) - 1
        while keep and total * 2 > runs[keep - 1]["rows"]:
            keep -= 1
            total += runs[keep]["rows"]
        w = F.min(F.struct("o", "p")).alias("w")
        merged = self._load_index(runs[keep:]).groupBy(self.key).agg(w).select(self.key, F.col("w.o").alias("o"), F.col("w.p").alias("p"))
        return [*runs[:keep], self._write_index(merged, folder)]

    def read(self) -> DataFrame:
        """The winners: one row per identifier; no rows, in the columns of the last batch, if there are none."""
        m = self.manifest()
        folders = [f for x in m["partitions"].values() for f in x]
        return self._load(folders) if folders else self.spark.createDataFrame([], StructType.fromJson(m["schema"]))

    def losers(self) -> DataFrame:
        """One column, the order of each row taken in that is not a winner."""
        m = self.manifest()
        return self._load(m["losers"])

    def vacuum(self) -> list[str]:
        """Deletes what no reader of the newest version needs: the folders of dead writers and of older versions.

        Not while another writer is at work: what it has staged is in no manifest yet.
        """
        m = self.manifest()
        used = {f.split("/")[0] for x in m["partitions"].values() for f in x} | {r["folder"] for r in m["index"]} | set(m["losers"]) | {f"manifest-{m['version']:08d}.json"}
        gone = [n for n in subfolders(self.spark, self.root) if n not in used and not n.startswith((".", "_"))]
        for n in gone:
            delete(self.spark, f"{self.root}/{n}")
        return gone


__all__ = ["DedupStore", "exists"]
