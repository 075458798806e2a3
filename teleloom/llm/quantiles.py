"""Percentiles per group of very large columns by deterministic buffer collapsing.

A summary holds at most ``b`` sorted buffers of ``k`` values, each with a weight, and a tail of fewer than ``k`` raw
values. A full summary collapses all buffers of its lowest level into one: of the weighted merge, it keeps every W-th
value, W being the sum of the weights, from the middle on (for even W alternately just below and above it). The
levels form a tree, so a value passes through few collapses. Each collapse moves no rank by more than (W + 1) / 2; the
sum is kept in the summary, so every answer comes with a proven bound. Groups of fewer than ``k`` values are exact.

A bound is known beforehand too. A buffer of level l + 1 comes of two of level l at least, so it weighs 2^(l+1) or more
and no level is above log2(n / k). A value takes part in one collapse a level at most, so the weights of all collapses
of a level add up to n / k at most. The error of n values is therefore below (log2(n / k) + 2) n / 2k in any order of
collapses and merges; ``buffer_size`` turns this around and gives the k for a wanted error.

Summaries of partitions, days or earlier runs merge into a summary of all, whose bound is the sum of theirs and of
its own collapses. A partition builds one summary for each of its groups; a group's summaries are merged first in
``fan`` parts and then in one, each merge a stream of bounded rows, so no group is ever gathered. They are merged in
the order of their contents, so that one set of summaries gives one result, however it was shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, B, FAN, CHUNK, MOST_GROUPS = 2048, 10, 16, 1 << 18, 20_000


def buffer_size(error: float, most: int) -> int:
    """The least power of two k with which no rank among up to ``most`` values is off by more than ``error`` times their number."""
    k = 1
    while k < most and (math.log2(max(1.0, most / k)) + 2) / (2 * k) > error:
        k *= 2
    return k


class Summary:
    """A mergeable quantile summary of numbers."""

    __slots__ = ("k", "b", "n", "error", "flip", "buffers", "tail", "loose")

    def __init__(self, k: int = K, b: int = B):
        self.k, self.b, self.n, self.error, self.flip = k, b, 0, 0, 0
        self.buffers: list[tuple[int, int, np.ndarray]] = []  # level, weight, sorted values
        self.tail: list[np.ndarray] = []
        self.loose = 0

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._pour(values)

    def _pour(self, values: np.ndarray) -> None:
        self.tail.append(values)
        self.loose += len(values)
        if self.loose < self.k:
            return
        raw = np.concatenate(self.tail)
        full = len(raw) // self.k * self.k
        for i in range(0, full, self.k):
            self.buffers.append((0, 1, np.sort(raw[i : i + self.k])))
            self._shrink()
        self.tail, self.loose = [raw[full:]], len(raw) - full

    def _shrink(self) -> None:
        while len(self.buffers) > self.b:
            levels = [x[0] for x in self.buffers]
            twice = [lv for lv in levels if levels.count(lv) > 1]
            if not twice:  # one buffer a level: no more of them than log2(n / k)
                return
            low = min(twice)
            chosen = [x for x in self.buffers if x[0] <= low]
            rest = [x for x in self.buffers if x[0] > low]
            total = sum(w for _, w, _ in chosen)
            values = np.concatenate([v for _, _, v in chosen])
            weights = np.repeat([w for _, w, _ in chosen], [len(v) for _, _, v in chosen])
            order = np.argsort(values, kind="stable")
            upto = np.cumsum(weights[order])
            if total % 2:
                first = (total + 1) // 2
            else:
                first, self.flip = total // 2 + self.flip, 1 - self.flip
            at = np.searchsorted(upto, first + total * np.arange(self.k))
            self.error += (total + 1) // 2
            self.buffers = [*rest, (low + 1, total, values[order][at])]

    def merge(self, other: "Summary") -> None:
        self.n += other.n
        self.error += other.error
        for x in other.buffers:
            self.buffers.append(x)
            self._shrink()
        for t in other.tail:
            if len(t):
                self._pour(t)

    def quantiles(self, qs) -> list:
        """For each q the smallest kept value whose estimated rank reaches ceil(q n); None if there are no values."""
        if not self.n:
            return [None] * len(qs)
        parts = [(1, t) for t in self.tail if len(t)] + [(w, v) for _, w, v in self.buffers]
        values = np.concatenate([v for _, v in parts])
        weights = np.repeat([w for w, _ in parts], [len(v) for _, v in parts])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        return [values[order][min(len(values) - 1, int(np.searchsorted(upto, max(1, math.ceil(q * self.n)))))] for q in qs]

    def row(self) -> tuple:
        tail = np.concatenate(self.tail) if self.tail else np.empty(0)
        values = np.concatenate([v for _, _, v in self.buffers] + [tail]) if self.buffers or len(tail) else tail
        return self.n, self.error, [x[0] for x in self.buffers], [x[1] for x in self.buffers], values

    @classmethod
    def of(cls, n, error, levels, weights, values, k: int = K, b: int = B) -> "Summary":
        s = cls(k, b)
        s.n, s.error = int(n), int(error)
        values = np.asarray(values)
        s.buffers = [(int(lv), int(w), values[i * k : (i + 1) * k]) for i, (lv, w) in enumerate(zip(levels, weights))]
        s.tail = [values[len(levels) * k :]]
        s.loose = len(s.tail[0])
        return s


def _fields(df: DataFrame, keys: list[str], kind: str) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys) + f", n bigint, rank_error bigint, levels array<int>, weights array<bigint>, points array<{kind}>"


def summaries(df: DataFrame, keys: list[str], value: str, k: int = K, b: int = B) -> DataFrame:
    """Summaries of each group, one row per partition in which it occurs: keys, n, rank_error, levels, weights, points.

    Null and NaN values are left out; a null key is a group of its own.
    """
    kind = "bigint" if dict(df.dtypes)[value] in ("bigint", "int", "smallint", "tinyint") else "double"
    rows = df.select(*keys, F.col(value).cast(kind).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Summary] = {}

        def out() -> pd.DataFrame:
            data = [(*key, *s.row()) for key, s in held.items()]
            held.clear()
            return pd.DataFrame(data, columns=[*keys, "n", "rank_error", "levels", "weights", "points"])

        def take(parts: list[pd.DataFrame]) -> None:
            chunk = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            codes = None
            uniques = []
            for c in keys:
                code, u = pd.factorize(chunk[c], use_na_sentinel=False)
                uniques.append(u)
                codes = code.astype(np.int64) if codes is None else codes * len(u) + code
            values = chunk["_v"].to_numpy()
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            cuts = np.flatnonzero(np.diff(codes)) + 1
            for a, z in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(codes)]))):
                code, key = int(codes[a]), []
                for u in reversed(uniques):
                    code, i = divmod(code, len(u))
                    key.append(None if pd.isna(u[i]) else u[i])
                s = held.setdefault(tuple(reversed(key)), Summary(k, b))
                s.add(values[a:z])

        parts, size = [], 0
        for pdf in batches:
            if len(pdf):
                parts.append(pdf)
                size += len(pdf)
            if size >= CHUNK:
                take(parts)
                parts, size = [], 0
                if len(held) > MOST_GROUPS:  # bounded memory; the merge puts the pieces together
                    yield out()
        if parts:
            take(parts)
        if held:
            yield out()

    return rows.mapInPandas(build, _fields(df, keys, kind))


def merge_summaries(parts: DataFrame, keys: list[str], k: int = K, b: int = B, fan: int = FAN) -> DataFrame:
    """One summary per group from any number of them, by two rounds of streaming merges."""
    schema = parts.schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s = None, None
        cols = [*keys, "n", "rank_error", "levels", "weights", "points"]
        for pdf in batches:
            data = []
            for *key, n, e, lv, w, v in zip(*(pdf[c] for c in cols)):
                key = tuple(None if pd.isna(x) else x for x in key)
                x = Summary.of(n, e, lv, w, v, k, b)
                if s is not None and key == now:
                    s.merge(x)
                else:
                    if s is not None:
                        data.append((*now, *s.row()))
                    now, s = key, x
            yield pd.DataFrame(data, columns=cols)
        if s is not None:
            yield pd.DataFrame([(*now, *s.row())], columns=cols)

    cols = parts.columns
    order = [*keys, "n", "levels", "weights", "points", "rank_error"]
    one = parts.withColumn("_part", F.pmod(F.xxhash64("n", "weights", "points"), F.lit(fan)))
    one = one.repartition(*keys, "_part").sortWithinPartitions("_part", *order).select(*cols).mapInPandas(fold, schema)
    return one.repartition(*keys).sortWithinPartitions(*order).mapInPandas(fold, schema)


def percentiles(merged: DataFrame, keys: list[str], qs: dict[str, float], k: int = K, b: int = B) -> DataFrame:
    """keys, n, rank_error and one column per entry of ``qs`` from summaries (one row per group)."""
    types = dict(merged.dtypes)
    kind = types["points"][6:-1]
    schema = ", ".join(f"`{x}` {types[x]}" for x in keys) + ", n bigint, rank_error bigint, " + ", ".join(f"`{q}` {kind}" for q in qs)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [Summary.of(*x, k, b).quantiles(list(qs.values())) for x in zip(pdf["n"], pdf["rank_error"], pdf["levels"], pdf["weights"], pdf["points"])]
            out = pdf[[*keys, "n", "rank_error"]].reset_index(drop=True)
            for i, q in enumerate(qs):
                out[q] = pd.array([g[i] for g in got], dtype="Int64" if kind == "bigint" else "Float64")
            yield out

    return merged.mapInPandas(ask, schema)


def within_bound(df: DataFrame, keys: list[str], value: str, answers: DataFrame, qs: dict[str, float]) -> DataFrame:
    """keys, n and for each of ``qs`` whether the answer's true ranks, counted over all values, come within its rank_error of ceil(q n)."""
    kind = dict(answers.dtypes)[next(iter(qs))]
    rows = df.select(*keys, F.col(value).cast(kind).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    named = answers.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("n").alias("_n"), "rank_error", *qs)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # The values are counted before they meet the answers, so that a group of any size is a partial sum.
    each = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = [F.sum(F.when(F.col("_v") < F.col(q), F.col("_c")).otherwise(0)).alias(f"_lt_{q}") for q in qs] + [F.sum(F.when(F.col("_v") <= F.col(q), F.col("_c")).otherwise(0)).alias(f"_le_{q}") for q in qs]
    seen = each.join(named, cond).groupBy(*keys).agg(F.sum("_c").alias("n"), F.first("_n").alias("_n"), F.first("rank_error").alias("_e"), *counts)
    want = {q: F.greatest(F.ceil(F.lit(x) * F.col("n")), F.lit(1)) for q, x in qs.items()}
    return seen.select(*keys, "n", *[((F.col("n") == F.col("_n")) & (F.col(f"_lt_{q}") + 1 - F.col("_e") <= want[q]) & (want[q] <= F.col(f"_le_{q}") + F.col("_e"))).alias(q) for q in qs])
