"""Implausible readings: spikes, stuck stretches and impossible figures, relative to each source's normal behaviour.

Spikes are peaks over a threshold. The local level (a running median, which follows seasons and lasting changes of
level) is taken off each figure; of cumulative figures, the usual rate is taken off the rate of each step. The
residuals are scaled by their robust scatter, a generalised Pareto tail is fitted to what exceeds their 90th
percentile, and the cut-off lies where that tail leaves a fixed risk. What is fitted are all readings but confirmed
spikes: those that stand out from a first tail, drawn from the median and the 90th percentile alone, which no spikes
of less than a tenth of the readings can move. At most three readings in a row beyond the cut-off whose neighbours
on both sides agree are a spike.

Copies of a reading are folded before anything is grouped. A source of more than ``block`` readings is numbered in
order of time and worked on in blocks with context on both sides, so one source may hold any share of the rows. What
is usual is a matter of the whole source: a source of several blocks is first summed up by counts of its residuals,
rates and equal neighbours (in buckets half a percent wide, which add up over blocks), once for the first tail and
once without the confirmed spikes; its blocks then only apply the limits drawn from them.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.plans.ordered import rank_by_key
from teleloom.plans.skew import lookup_join
from teleloom.plans.storage import Workspace

FIGURES = ["value", "count", "sum", "min", "max"]
SOURCE = ["service_name", "metric_name", "instance_id"]
#: Share of normal readings that may lie beyond a cut-off; scatters that are far off where a source has too few
#: readings beyond its usual ones to fit a tail; readings in a stuck stretch; readings in a spike.
RISK, UNFITTED, STUCK, LONGEST, HALF, CONTEXT = 1e-4, 12.0, 8, 3, 9, 32
WIDTH, SHIFT = np.log(1.005), 200_000
#: Most rows of a table that is broadcast (24 bytes each).
FEW = 500_000


def quantile(v: np.ndarray, n: np.ndarray, q: float) -> float:
    """As ``np.quantile`` of ascending values ``v`` that occur ``n`` times each."""
    upto = np.cumsum(n)
    at = (upto[-1] - 1) * q
    low, high = v[np.searchsorted(upto, [np.floor(at), np.ceil(at)], "right")]
    return float(low + (high - low) * (at - np.floor(at)))


def ascending(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(v, kind="stable")
    return v[order], n[order]


def buckets(v: np.ndarray) -> np.ndarray:
    """Number of the bucket of each value; zero has its own."""
    size = np.where(v == 0, 1.0, np.abs(v))
    return np.where(v == 0, 0, np.sign(v) * (np.round(np.log(size) / WIDTH) + SHIFT)).astype(np.int64)


def centres(k: np.ndarray) -> np.ndarray:
    return np.where(k == 0, 0.0, np.sign(k) * np.exp((np.abs(k) - SHIFT) * WIDTH))


def first_cut(z: np.ndarray, n: np.ndarray, risk: float = RISK) -> float:
    """The score that an exponential tail through the median and the 90th percentile exceeds with probability ``risk``; ``z`` occur ``n`` times each."""
    z, n = ascending(z, n)
    low, high = quantile(z, n, 0.5), quantile(z, n, 0.9)
    return high + (high - low) / np.log(5) * np.log(0.1 / risk)


def tail_cut(z: np.ndarray, n: np.ndarray, risk: float = RISK) -> float:
    """The score that normal behaviour exceeds with probability ``risk``, by a generalised Pareto tail beyond the 90th
    percentile; ``z`` occur ``n`` times each. The shape is taken half a standard error up, for what few readings hide."""
    z, n = ascending(z, n)
    u = quantile(z, n, 0.9)
    e, n, total = z[z > u] - u, n[z > u], n.sum()
    if (k := n.sum()) < 5:
        return UNFITTED
    m = np.average(e, weights=n)
    v = max(np.average((e - m) ** 2, weights=n), 1e-300)
    xi = max(0.5 * (1 - m * m / v), -0.5)
    sigma, xi = m * (1 - xi), float(np.clip(xi + 0.5 / np.sqrt(k), 0.0, 0.5))
    far = (k / total) / risk
    return u + (sigma * np.log(far) if xi < 1e-6 else sigma / xi * (far**xi - 1))


def cut_of(z: np.ndarray, n: np.ndarray, first: bool, risk: float) -> float:
    """The first or the fitted cut-off; scores of zero are left out where they are nine in ten."""
    if n[z > 0].sum() <= 0.1 * n.sum():
        z, n = z[z > 0], n[z > 0]
    if n.sum() < 20:
        return UNFITTED
    return first_cut(z, n, risk) if first else tail_cut(z, n, risk)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2], edge[1::2]))


def residuals(x: np.ndarray) -> np.ndarray:
    """A series of levels less its running median."""
    half = min(HALF, (len(x) - 1) // 2)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="reflect"), 2 * half + 1) if half else x[:, None]
    return x - np.median(near, axis=1)


def level_limit(r: np.ndarray, rn: np.ndarray, x: np.ndarray, xn: np.ndarray, first: bool = False, risk: float = RISK) -> float:
    """How far from its level a reading of a source may be, from its residuals ``r`` and readings ``x`` with their numbers."""
    (r, rn), (size, sn) = ascending(r, rn), ascending(np.abs(r), rn)
    s = max(1.4826 * quantile(size, sn, 0.5), (quantile(r, rn, 0.75) - quantile(r, rn, 0.25)) / 1.349)
    off = r != 0
    if s <= 0 and rn[off].sum() > 0.1 * rn.sum():  # mostly at rest, but busy now and then
        s = 1.4826 * quantile(size[size > 0], sn[size > 0], 0.5)
    elif s <= 0:  # readings that hardly ever change
        return UNFITTED * (0.05 * abs(quantile(*ascending(x, xn), 0.5)) or 0.05 * np.average(np.abs(x), weights=xn) or 1.0)
    return cut_of(size / s, sn, first, risk) * s


def level_spikes(x: np.ndarray, cut: float) -> np.ndarray:
    """Mask of spikes in a series of levels (finite values in order of time)."""
    out, r = np.zeros(len(x), bool), residuals(x)
    far = np.abs(r) > cut
    for a, b in _runs(far):
        if b - a > LONGEST:
            continue
        before, after = x[max(0, a - 5) : a][~far[max(0, a - 5) : a]], x[b : b + 5][~far[b : b + 5]]
        if not len(before) or not len(after):
            continue
        p, q = np.median(before), np.median(after)
        dev = x[a:b] - (p + q) / 2
        if np.abs(dev).min() > cut and abs(p - q) <= 0.5 * np.abs(dev).min() and (dev > 0).all() | (dev < 0).all():
            out[a:b] = True
    return out


def rates(x: np.ndarray, ts: np.ndarray) -> tuple[np.ndarray, float]:
    """The step to each reading but the first, a usual interval's worth of it where more time has passed; and that interval."""
    dt = np.diff(ts).astype(float)
    usual = float(np.median(dt[dt > 0])) if (dt > 0).any() else 1.0
    return np.diff(x) / np.maximum(dt / usual, 1.0), usual


def ramp_limit(up: np.ndarray, un: np.ndarray, x: np.ndarray, first: bool = False, risk: float = RISK) -> float:
    """How far a source may go in a usual interval, from its rates ``up`` (none below zero) with their numbers."""
    least = 1e-9 * np.abs(x).max()
    if not un[up > 0].sum():
        return least
    usual = quantile(*ascending(up, un), 0.5)
    if usual <= 0:  # mostly idle
        up, un = up[up > 0], un[up > 0]
        usual = quantile(*ascending(up, un), 0.5)
    off, n = ascending(np.abs(up - usual), un)
    s = 1.4826 * quantile(off, n, 0.5) or 0.05 * usual
    return max(least, usual + cut_of(off / s, n, first, risk) * s)


def ramp_spikes(x: np.ndarray, ts: np.ndarray, cut: float) -> np.ndarray:
    """Mask of spikes in a cumulative series: readings off the ramp after which the same ramp goes on.

    Off the ramp is what the source could not reach while the longest spike lasts. A restart doesn't come back to its
    ramp, an idle stretch doesn't leave it.
    """
    n, off = len(x), (LONGEST + 1) * cut
    out = np.zeros(n, bool)
    usual = rates(x, ts)[1] if n > 1 else 1.0
    i = 1
    while i < n - 1:
        for k in range(1, LONGEST + 1):
            if i + k >= n:
                break
            p, q, run = x[i - 1], x[i + k], x[i : i + k]
            room = max(k + 1, (ts[i + k] - ts[i - 1]) / usual) * cut
            if 0 <= q - p <= room and ((run - q > off).all() or (p - run > off).all()):
                out[i : i + k] = True
                i += k
                break
        i += 1
    return out


def equal_rows(rows: np.ndarray, least: int = STUCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of neighbouring rows: whether they are equal, whether they lie in ``least`` or more equal rows; mask of rows in
    such stretches, but for those at zero (idle, not stuck)."""
    full = np.where(np.isnan(rows), -1.0, rows)
    same = (full[1:] == full[:-1]).all(axis=1)
    inside, out = np.zeros(len(same), bool), np.zeros(len(full), bool)
    for a, b in _runs(same):
        if b - a + 1 >= least:
            inside[a:b] = True
            out[a : b + 1] = (full[a] > 0).any()
    return same, inside, out


def changing(pairs: int, inside: int, equal: int) -> bool:
    """Whether a source otherwise keeps changing: ``inside`` of its pairs of neighbours in equal stretches, ``equal`` elsewhere."""
    return inside <= 0.6 * pairs and equal <= 0.5 * (pairs - inside)


def impossible() -> Column:
    """(c): below zero, a share above one, or a histogram whose figures contradict each other. Non-finite figures are none."""

    def num(c: str) -> Column:
        x = F.col(c)
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)

    below = F.lit(False)
    for c in FIGURES:
        below = below | F.coalesce(num(c) < 0, F.lit(False))
    share = (F.col("unit") == "1") & (num("value") > 1)
    count, total = num("count"), num("sum")
    slack = F.lit(1 + 1e-9)
    hist = (F.col("metric_type") == "Histogram") & (
        F.coalesce(num("min") > num("max"), F.lit(False)) | F.coalesce(total > count * num("max") * slack, F.lit(False)) | ((total > 0) & (F.coalesce(count, F.lit(0.0)) == 0)))
    return below | F.coalesce(share, F.lit(False)) | F.coalesce(hist, F.lit(False))


#: Whether a metric type has one figure (and may be stuck), one figure, four (and may be stuck), four.
KINDS = {"Gauge": 0, "Sum": 1, "Histogram": 2}


class Block:
    """The readings of a source or of one block of it in order of time: lines of (figure, places, values, times, whether on a ramp), rows and places for the stuck test."""

    def __init__(self, df: pd.DataFrame):
        ts, fig = df["ts_ns"].to_numpy(np.int64), df[FIGURES].to_numpy(float)
        fig[~np.isfinite(fig)] = np.nan
        order = np.lexsort((*fig.T[::-1], ts))
        ts, fig, kind, cumulative = ts[order], fig[order], int(df["kind"].iloc[0]), bool(df["cumulative"].iloc[0])
        self.reading, self.own = df["reading"].to_numpy()[order], df["own"].to_numpy(bool)[order]
        cols = [0] if kind < 2 else [1, 2, 3, 4]
        self.lines = []
        for c in cols:
            at = np.flatnonzero(fig[:, c] >= 0)
            self.lines.append((c, at, fig[at, c], ts[at], cumulative and c in (0, 1, 2)))
        self.at = np.flatnonzero(~np.isnan(fig[:, cols[0]]))
        self.rows = fig[np.ix_(self.at, cols)] if kind in (0, 2) and len(self.at) else None

    def spikes(self, limit: dict[str, float]) -> np.ndarray:
        out = np.zeros(len(self.own), bool)
        for c, at, x, ts, ramp in self.lines:
            if str(c) in limit and len(x):
                out[at[ramp_spikes(x, ts, limit[str(c)]) if ramp else level_spikes(x, limit[str(c)])]] = True
        return out

    def stuck(self) -> np.ndarray:
        out = np.zeros(len(self.own), bool)
        if self.rows is not None:
            out[self.at[equal_rows(self.rows)[2]]] = True
        return out

    def measure(self, spikes: np.ndarray | None = None) -> dict[tuple[int, str], np.ndarray]:
        """What the own readings add to the summary of their source, ``spikes`` left out: residuals ``r`` and readings
        ``x`` of levels, rates ``up`` and readings of ramps by figure; at figure -1 a one for each of the ``pairs``,
        those ``inside`` and ``equal``."""
        out = {}
        for c, at, x, ts, ramp in self.lines:
            mine = self.own[at] if spikes is None else self.own[at] & ~spikes[at]
            if not mine.any():
                continue
            out[c, "x"] = x[mine]
            if ramp:
                up = rates(x, ts)[0]
                out[c, "up"] = up[(up >= 0) & mine[1:]]
            else:
                out[c, "r"] = residuals(x)[mine]
        if self.rows is not None:
            same, inside, _ = equal_rows(self.rows)
            mine = self.own[self.at][1:]
            for name, mask in (("pairs", mine), ("inside", mine & inside), ("equal", mine & same & ~inside)):
                out[-1, name] = np.ones(int(mask.sum()))
        return out


def limits(found: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], first: bool = False, risk: float = RISK) -> dict[str, float]:
    """From the summary of a whole source, values and their numbers: the limit of each figure, and at -1 whether it keeps changing."""
    none, out = (np.zeros(0), np.zeros(0, np.int64)), {}
    for (c, name), (x, n) in found.items():
        if name == "x" and n.sum() >= 8:
            out[str(c)] = level_limit(*found[c, "r"], x, n, first, risk) if (c, "r") in found else ramp_limit(*found.get((c, "up"), none), x, first, risk)
    out["-1"] = float(changing(*(int(found.get((-1, name), none)[1].sum()) for name in ("pairs", "inside", "equal"))))
    return out


def _counted(found: dict) -> dict:
    return {k: (v, np.ones(len(v), np.int64)) for k, v in found.items()}


def judge(df: pd.DataFrame, risk: float = RISK) -> pd.DataFrame:
    """Readings of one block of a source: those that are spikes or stuck, with the reason. ``limits`` are those of the
    whole source, null if the block holds all of it."""
    block, known = Block(df), df["limits"].iloc[0]
    if known:
        limit = json.loads(known)
    else:
        first = limits(_counted(block.measure()), True, risk)
        limit = limits(_counted(block.measure(block.spikes(first))), False, risk) | {"-1": first["-1"]}
    spike = block.spikes(limit)
    hit = (spike | block.stuck() if limit["-1"] else spike) & block.own
    return pd.DataFrame({"reading": block.reading[hit], "reason": np.where(spike[hit], "spike", "stuck")})


def sum_up(df: pd.DataFrame) -> pd.DataFrame:
    """The summary of one block: source, figure, name, bucket, n; without the spikes beyond its ``limits`` if it has any."""
    block, known = Block(df), df["limits"].iloc[0]
    out = {"figure": [], "name": [], "bucket": [], "n": []}
    for (c, name), v in block.measure(block.spikes(json.loads(known)) if known else None).items():
        k, n = np.unique(buckets(v), return_counts=True)
        for column, values in zip(out.values(), ([c] * len(k), [name] * len(k), k.tolist(), n.tolist())):
            column.extend(values)
    return pd.DataFrame({"source": [df["source"].iloc[0]] * len(out["n"]), **out}, columns=["source", *out], dtype=object)


def flag(points: DataFrame, block: int = 4096, risk: float = RISK) -> DataFrame:
    """(arrival_seq, reason) of each implausible row; reason is ``impossible``, ``spike`` or ``stuck`` (the first that holds).

    Rows without a source or a time can only be impossible. An empty table gives no rows; sources of fewer than
    eight readings have no spikes or stuck stretches. Copies share their reading's verdict.
    """
    ws = Workspace(points.sparkSession, "spikes")
    known = F.col("ts_ns").isNotNull() & (F.col("ts_ns") != 0)
    for k in SOURCE:
        known = known & F.col(k).isNotNull()
    figures = [F.col(c).cast("double").alias(c) for c in FIGURES]
    kind = F.lit(3)
    for name, code in KINDS.items():
        kind = F.when(F.col("metric_type") == name, code).otherwise(kind)
    source = F.unhex(F.md5(F.concat_ws("\x1f", *SOURCE)))
    rows = points.select("arrival_seq", impossible().alias("impossible"), known.alias("known"), source.alias("source"), kind.cast("int").alias("kind"), F.coalesce(F.col("temporality") == "Cumulative", F.lit(False)).alias("cumulative"), F.col("ts_ns").cast("bigint").alias("ts_ns"), *figures)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("kind", "cumulative", "ts_ns", *FIGURES)]
    rows = ws.put("rows", rows.withColumn("reading", F.unhex(F.md5(F.concat(F.hex("source"), F.concat_ws("\x1f", *text))))))
    cols = ["source", "kind", "cumulative", "ts_ns", *FIGURES]
    readings = ws.put("readings", rows.filter("known").groupBy("reading").agg(*[F.first(c).alias(c) for c in cols]))
    long = ws.put("long", readings.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("source"))
    whole = {"own": F.lit(True), "limits": F.lit(None).cast("string")}
    of = lambda fn: lambda df: fn(df, risk)
    reason = "reading binary, reason string"
    if long.isEmpty():
        hits = readings.withColumns(whole).groupBy("source").applyInPandas(of(judge), reason)
    else:
        each = ws.put("each", lookup_join(readings, long.withColumn("long", F.lit(True)), "source", "left"))
        hits = each.filter("long is null").withColumns(whole).groupBy("source").applyInPandas(of(judge), reason)
        hits = hits.unionByName(_in_blocks(each.filter("long"), block, risk, ws).groupBy("source", "block").applyInPandas(of(judge), reason))
    hits = ws.put("hits", hits)
    wrong = rows.filter("impossible").select("arrival_seq", F.lit("impossible").alias("reason"))
    rest = rows.filter("known and not impossible").select("arrival_seq", "reading")
    if hits.count() <= FEW:
        found = rest.join(F.broadcast(hits), "reading")
    else:
        found = lookup_join(ws.put("rest", rest), hits, "reading")
    return wrong.unionByName(found.select("arrival_seq", "reason"))


def _in_blocks(readings: DataFrame, block: int, risk: float, ws: Workspace) -> DataFrame:
    """Readings of long sources in blocks of ``block`` readings in order of time, with context and the limits of their source."""
    cols = ["reading", "source", "kind", "cumulative", "ts_ns", *FIGURES]
    ranked = rank_by_key(readings.select(*cols), ["source"], [F.col("ts_ns"), F.col("reading")])
    home = lambda c: F.floor((c - 1) / F.lit(block)).cast("bigint")
    at = F.col("rank")
    placed = ranked.withColumn("block", F.explode(F.sequence(home(F.greatest(at - CONTEXT, F.lit(1))), home(at + CONTEXT)))).withColumn("own", home(at) == F.col("block")).drop("rank")
    placed = ws.put("placed", placed)

    def drawn(blocks: DataFrame, first: bool) -> DataFrame:
        def draw(df: pd.DataFrame) -> pd.DataFrame:
            found = {k: (centres(g["bucket"].to_numpy(np.int64)), g["n"].to_numpy(np.int64)) for k, g in df.groupby(["figure", "name"])}
            return pd.DataFrame({"source": [df["source"].iloc[0]], "limits": [json.dumps(limits(found, first, risk))]}, dtype=object)

        found = blocks.groupBy("source", "block").applyInPandas(sum_up, "source binary, figure int, name string, bucket bigint, n bigint")
        found = found.groupBy("source", "figure", "name", "bucket").agg(F.sum("n").alias("n"))
        return ws.put("first" if first else "limits", found.groupBy("source").applyInPandas(draw, "source binary, limits string"))

    first = drawn(placed.withColumn("limits", F.lit(None).cast("string")), True)
    return lookup_join(placed, drawn(lookup_join(placed, first, "source"), False), "source")
