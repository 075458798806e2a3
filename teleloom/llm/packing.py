"""Texts into packs of fixed capacity, by best-two-fit.

A pack is filled greedily, the largest item that fits coming first. When none fits, its smallest item is replaced by
the two unpacked items that fill the widened gap most tightly, if they fill it better than the item did. A text is
divided only if it alone exceeds the capacity: its full-length pieces are packs of their own, the rest is an item.

Items are dealt to shards of bounded size by a hash of their number, so no task sees more than a shard whatever the
input and however full packs can get. Packs that a shard leaves less full than ``good`` are opened again and dealt
anew, to as many shards as what is left needs. The rounds end when a last one fits one shard, or when a round closes
less than a tenth of what it was given: sizes that do not go together better stay as they are, and each shard leaves
one pack at most that another shard could have filled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.plans.storage import Workspace, spread

TOKENIZERS = "/opt/tokenizers"
SHARD, GOOD = 20_000, 0.98


@lru_cache(maxsize=2)
def _encoding(folder: str, name: str):
    import base64
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens) over whole texts; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(folder, name)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["i"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]]})

    return spread(docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))).mapInPandas(count, "doc_id bigint, n_tokens bigint")


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of the items of each pack; every size is between 1 and ``capacity``."""
    order = np.argsort(sizes, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order.tolist():
        stacks.setdefault(int(sizes[i]), []).append(i)
    there = np.array(sorted(stacks), dtype=np.int64)
    packs: list[list[int]] = []

    def take(size: int) -> int:
        nonlocal there
        item = stacks[size].pop()
        if not stacks[size]:
            there = np.delete(there, np.searchsorted(there, size))
        return item

    def put_back(size: int, item: int) -> None:
        nonlocal there
        if not stacks.setdefault(size, []):
            there = np.insert(there, np.searchsorted(there, size), size)
        stacks[size].append(item)

    while len(there):
        pack, gap = [], capacity
        while gap and len(there) and there[0] <= gap:
            size = int(there[np.searchsorted(there, gap, side="right") - 1])
            pack.append((size, take(size)))
            gap -= size
        if gap and len(there) and len(pack) > 0:
            small = min(range(len(pack)), key=lambda j: pack[j][0])
            room = gap + pack[small][0]
            first = there[: np.searchsorted(there, room // 2, side="right")]
            if len(first):
                at = np.searchsorted(there, room - first, side="right") - 1
                both = first + there[at]
                lone = (there[at] == first) & np.array([len(stacks[int(s)]) < 2 for s in first])
                both[lone] = -1
                j = int(np.argmax(both))
                if both[j] > pack[small][0]:
                    size, item = pack.pop(small)
                    a, b = int(first[j]), int(there[at[j]])
                    pack += [(a, take(a)), (b, take(b))]
                    put_back(size, item)
        packs.append([i for _, i in pack])
    return packs


def _filler(tag: str, keep: float):
    def fill(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("item", kind="stable").reset_index(drop=True)
        cap, who = int(df["capacity"].iloc[0]), df["_shard"].iloc[0]
        n = df["n_tokens"].to_numpy(np.int64)
        name, opened = np.empty(len(df), object), np.zeros(len(df), bool)
        for j, items in enumerate(best_two_fit(n, cap)):
            name[items] = f"{tag}-{who}-{j}"
            opened[items] = n[items].sum() < keep * cap
        out = df[["pack_id", "capacity"]].assign(bin=name, item=df["item"], doc_id=df["doc_id"], start=df["start"], n_tokens=n)
        out["open"] = opened
        return out

    return fill


def shards_of(items: int, shard: int) -> int:
    """Into how many shards ``items`` are dealt by hash so that none gets more than ``shard``: the mean is six standard deviations below."""
    return 1 if items <= shard else -(-items // max(1, int(shard - 6 * shard**0.5)))


def pack(counts: DataFrame, capacities: DataFrame, shard: int = SHARD, good: float = GOOD) -> DataFrame:
    """(pack_id, bin, doc_id, start, n_tokens): the tokens of a text from ``start`` on that lie in pack ``bin``.

    ``counts`` is (doc_id, n_tokens); texts without tokens are in no pack, repeated rows and null ids are texts of
    their own. ``capacities`` is (pack_id, capacity_tokens), a small table of settings; rows with a null or
    non-positive capacity are left out, and settings of one pack_id with several capacities are packed apart.
    """
    spark = counts.sparkSession
    ws = Workspace(spark, "packing")
    counts = ws.put("counts", counts.filter("n_tokens > 0").withColumn("item", F.monotonically_increasing_id()))
    sizes = small(capacities.filter("capacity_tokens > 0").select("pack_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct())
    # Every text meets every capacity setting.
    each = counts.join(sizes, F.lit(True))
    full = each.filter("n_tokens >= capacity").select("pack_id", "item", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_tokens") / F.col("capacity")) - 1)).alias("i"))
    full = full.select("pack_id", F.concat(F.lit("w-"), "item", F.lit("-"), "capacity", F.lit("-"), "i").alias("bin"), "doc_id", (F.col("i") * F.col("capacity")).alias("start"), F.col("capacity").alias("n_tokens"))
    rest = each.withColumn("n", F.col("n_tokens") % F.col("capacity")).filter("n > 0").select("pack_id", "capacity", "item", "doc_id", (F.col("n_tokens") - F.col("n")).alias("start"), F.col("n").alias("n_tokens"))
    done, k, schema = [full], 0, "pack_id int, capacity bigint, bin string, item bigint, doc_id bigint, start bigint, n_tokens bigint, open boolean"
    left, before = counts.count(), None
    while left:
        shards = shards_of(left, shard)
        last = shards == 1 or (before is not None and left > 0.9 * before)
        placed = rest.withColumn("_shard", F.pmod(F.xxhash64("item", F.lit(k)), F.lit(shards))).groupBy("pack_id", "capacity", "_shard").applyInPandas(_filler(f"r{k}", 0.0 if last else good), schema)
        placed = ws.put(f"round{k}", placed)
        done.append(placed.filter("not open").select("pack_id", F.concat("bin", F.lit("-"), "capacity").alias("bin"), "doc_id", "start", "n_tokens"))
        rest = placed.filter("open").select("pack_id", "capacity", "item", "doc_id", "start", "n_tokens")
        before, k = left, k + 1
        left = 0 if last else rest.groupBy("pack_id", "capacity").count().agg(F.max("count")).first()[0] or 0
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def small(settings: DataFrame, most: int = 1000) -> DataFrame:
    """``settings`` to be broadcast; more than ``most`` rows are left to an ordinary join, none is dropped."""
    return F.broadcast(settings) if settings.limit(most + 1).count() <= most else settings


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_id, packs, tokens, unused, fewest): ``fewest`` is the number of packs no packing can beat."""
    caps = small(capacities.select("pack_id", "capacity_tokens"))
    per = packed.groupBy("pack_id", "bin").agg(F.sum("n_tokens").alias("t")).groupBy("pack_id").agg(F.count(F.lit(1)).alias("packs"), F.sum("t").alias("tokens"))
    cap = F.col("capacity_tokens").cast("bigint")
    return per.join(caps, "pack_id").select("pack_id", "packs", "tokens", (F.col("packs") * cap - F.col("tokens")).alias("unused"), F.ceil(F.col("tokens") / cap).alias("fewest"))


def violations(packed: DataFrame, counts: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_id, too_full, lost, divided): packs above their capacity, texts whose tokens are not all in packs exactly
    once, and texts that were divided though they fit; all zero for a right packing. One row for each usable setting.

    ``doc_id`` must be unique.
    """
    caps = small(capacities.filter("capacity_tokens > 0").select("pack_id", F.col("capacity_tokens").cast("bigint").alias("capacity")))
    full = packed.groupBy("pack_id", "bin").agg(F.sum("n_tokens").alias("t")).join(caps, "pack_id").groupBy("pack_id").agg(F.count_if(F.col("t") > F.col("capacity")).alias("too_full"))
    # Pieces that neither overlap nor leave gaps end where their sizes add up to.
    texts = packed.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("t"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("start").alias("starts"))
    each = counts.filter("n_tokens > 0").join(caps, F.lit(True)).select("pack_id", "doc_id", "n_tokens", "capacity")
    both = each.join(texts, ["pack_id", "doc_id"], "full")
    whole = F.coalesce((F.col("t") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("starts") == F.col("pieces")), F.lit(False))
    of = both.groupBy("pack_id").agg(F.count_if(~whole).alias("lost"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("divided"))
    return caps.select("pack_id").join(full, "pack_id", "left").join(of, "pack_id", "left").select("pack_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("too_full", "lost", "divided")])
