"""Irregular readings onto a regular grid, gaps filled by iterative singular-spectrum imputation.

Readings are averaged per source and slot before any shuffle by source, so a group holds slots, not readings. A
source is then cut into blocks of ``core`` slots, each with ``margin`` slots of context on either side; a block is
the unit of work, bounded whatever a source's share of the rows. In a block the series is embedded in its Hankel
matrix, the leading singular vectors are kept, and the missing entries are replaced by the reconstruction until they
no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.operators.spikes import residuals
from teleloom.plans.storage import Workspace

SLOT_NS = 60 * 10**9
#: Slots in a row of the Hankel matrix, and scatters from the running median that a reading counts for at most.
WINDOW, CLIP = 24, 4.0


def ssa_impute(x: np.ndarray, window: int = WINDOW, energy: float = 0.7, most: int = 3, settle: int = 20, rounds: int = 500, tol: float = 1e-3, depth: int = 10) -> tuple[np.ndarray, str]:
    """``x`` with its NaN entries imputed, and how: ``spectrum``, ``lines`` (too short, too sparse or constant a series:
    straight lines) or ``unsettled`` (no rank came to rest).

    The Hankel matrix is never formed in full precision beyond its window x window Gram matrix; the diagonal
    averages of a rank-one term are a convolution. The rank follows ``energy`` for ``settle`` rounds and is then kept,
    so that the iteration has a point of rest; from there Anderson's extrapolation over ``depth`` rounds leads to it,
    dropped wherever it would raise the part left out. At rest, a round and the extrapolation move no entry by ``tol``
    standard deviations. Readings further than ``CLIP`` scatters from their running median count as if they lay there:
    a spike has more energy than all the rest and would take the leading vectors for itself. A rank that has no rest within ``rounds`` is too high for the gaps (they run away): the next
    lower one is taken, from straight lines again.
    """
    x = np.asarray(x, float)
    seen = ~np.isnan(x)
    n, k = len(x), int(seen.sum())
    if k == n or k == 0:
        return x, "spectrum"
    at, gap = np.arange(n), ~seen
    r = residuals(x[seen])
    s = CLIP * 1.4826 * np.median(np.abs(r))
    z = x[seen] - r + np.clip(r, -s, s) if s > 0 else x[seen]
    mid, scale = z.mean(), z.std()
    y = np.interp(at, at[seen], z) - mid
    w = min(window, n // 2)
    if k < 8 or w < 3 or scale == 0:
        return np.where(seen, x, y + mid), "lines"
    line, times = y[gap], np.minimum(np.minimum(at + 1, n - at), w).astype(float)

    def once(v: np.ndarray, r: int | None) -> tuple[np.ndarray, float, int]:
        """One round from the entries ``v``: the new ones, the energy left out, the rank."""
        y[gap] = v
        h = np.lib.stride_tricks.sliding_window_view(y, w)
        vals, vecs = np.linalg.eigh(h.T @ h)
        vals, vecs = np.maximum(vals[::-1], 0), vecs[:, ::-1]
        if r is None:
            r = min(most, 1 + int(np.searchsorted(np.cumsum(vals) / max(vals.sum(), 1e-300), energy)), w)
        part = h @ vecs[:, :r]
        return (sum(np.convolve(part[:, i], vecs[:, i]) for i in range(r)) / times)[gap], vals[r:].sum(), r

    def filled(v: np.ndarray, how: str) -> tuple[np.ndarray, str]:
        y[gap] = v
        return np.where(seen, x, y + mid), how

    start = line
    for _ in range(settle):
        z, _, rank = once(start, None)
        moved, start = np.abs(z - start).max(), z
        if moved < tol * scale:
            return filled(z, "spectrum")
    first = start
    for r in range(rank, 0, -1):
        v, ins, outs, least, plain = (start if r == rank else line), [], [], np.inf, None
        for _ in range(rounds):
            z, left, _ = once(v, r)
            if plain is not None and left > least * (1 + 1e-12):
                v, plain, ins, outs = plain, None, [], []
                continue
            least, ins, outs = left, [*ins, v][-depth - 1 :], [*outs, z][-depth - 1 :]
            ahead, plain = z, None
            if len(ins) > 1:
                off, q = np.array(outs) - np.array(ins), np.array(outs)
                ahead, plain = z - np.linalg.lstsq(np.diff(off, axis=0).T, off[-1], rcond=1e-10)[0] @ np.diff(q, axis=0), z
                if max(np.abs(z - v).max(), np.abs(ahead - v).max()) < tol * scale:
                    return filled(z, "spectrum")
            v = ahead
    return filled(first, "unsettled")


def ssa_fill(x: np.ndarray, window: int = WINDOW, **how: float) -> np.ndarray:
    """``x`` with its NaN entries imputed; too short or too sparse a series is filled by straight lines."""
    return ssa_impute(x, window, **how)[0]


def slots(points: DataFrame, keys: list[str], slot_ns: int = SLOT_NS, ts: str = "ts_ns", value: str = "value", extra: Column | None = None) -> DataFrame:
    """Readings averaged per source and slot: keys, slot (number of the slot), value, readings.

    A reading has a finite value, a time other than 0 and null, and no null among the keys.
    """
    v, t = F.col(value).cast("double"), F.col(ts)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & t.isNotNull() & (t != 0)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    rows = points.filter(ok if extra is None else ok & extra).select(*keys, F.floor(t / F.lit(1)).cast("bigint").alias("t"), v.alias("v"))
    slot = ((F.col("t") - F.pmod("t", F.lit(slot_ns))) / slot_ns).cast("bigint")
    return rows.withColumn("slot", slot).groupBy(*keys, "slot").agg(F.avg("v").alias("value"), F.count("v").alias("readings"))


def regular_grid(points: DataFrame, keys: list[str], slot_ns: int = SLOT_NS, core: int = 720, margin: int = 120, window: int = WINDOW, ts: str = "ts_ns", value: str = "value", extra: Column | None = None) -> DataFrame:
    """One row per source and slot between its first and last reading: keys, slot_ns (start), value, readings, state, fill.

    ``state`` is ``observed``, ``imputed`` or ``missing`` (no reading in the block and its margins: marked, value null).
    ``fill`` tells how an imputed value came about: ``spectrum`` (iterated to rest), ``lines`` (the block is too short,
    too sparse or constant) or ``unsettled`` (no rest at any rank). Slots with several readings hold their mean. An
    empty table gives no rows; rows with a null key, an unset time or a value that is null or not finite are no readings.
    """
    by_slot = slots(points, keys, slot_ns, ts, value, extra)
    spark = points.sparkSession
    by_slot = Workspace(spark, "grid").put("slots", by_slot)  # read twice: by range and by block
    lo, hi = F.col("slot") - margin, F.col("slot") + margin
    block = lambda c: F.floor(c / F.lit(core)).cast("bigint")
    placed = by_slot.withColumn("block", F.explode(F.sequence(block(lo), block(hi)))).select(*keys, "block", "slot", "value", "readings")
    span = by_slot.groupBy(*keys).agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    frame = span.withColumn("block", F.explode(F.sequence(block(F.col("a")), block(F.col("b")))))
    ends = frame.select(*keys, "block", F.greatest(F.col("a"), F.col("block") * core).alias("slot"), F.lit(None).cast("double").alias("value"), F.lit(-1).cast("bigint").alias("readings")).unionByName(
        frame.select(*keys, "block", F.least(F.col("b"), (F.col("block") + 1) * core - 1).alias("slot"), F.lit(None).cast("double").alias("value"), F.lit(-1).cast("bigint").alias("readings")))
    fields = ", ".join(f"`{k}` {dict(points.dtypes)[k]}" for k in keys)
    schema = f"{fields}, slot_ns bigint, value double, readings bigint, state string, fill string"

    def fill(group: Iterator[pd.DataFrame]) -> pd.DataFrame:
        df = group
        mark = df["readings"].to_numpy() < 0
        if not mark.any():  # a margin beyond the source's ends
            return pd.DataFrame(columns=[*keys, "slot_ns", "value", "readings", "state", "fill"])
        slot, value_, count = (df[c].to_numpy() for c in ("slot", "value", "readings"))
        first, last = slot[mark].min(), slot[mark].max()
        seen = ~mark
        a = min(first, slot[seen].min()) if seen.any() else first
        b = max(last, slot[seen].max()) if seen.any() else last
        x, n = np.full(b - a + 1, np.nan), np.zeros(b - a + 1, np.int64)
        x[slot[seen] - a], n[slot[seen] - a] = value_[seen], count[seen]
        y, how = ssa_impute(x, window) if seen.any() else (x, "")
        part = slice(first - a, last - a + 1)
        n, y = n[part], y[part]
        state = np.where(n > 0, "observed", np.where(np.isnan(y), "missing", "imputed"))
        out = {k: df[k].iloc[0] for k in keys} | {"slot_ns": np.arange(first, last + 1) * slot_ns, "value": y, "readings": n, "state": state, "fill": np.where(state == "imputed", how, None)}
        return pd.DataFrame(out)

    return placed.unionByName(ends).groupBy(*keys, "block").applyInPandas(fill, schema)
