import numpy as np
import pytest
from pyspark.sql import functions as F

from teleloom.llm.quantiles import Summary, buffer_size, merge_summaries, percentiles, summaries, within_bound

QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def ranks(values, x):
    s = np.sort(values)
    return np.searchsorted(s, x, "left") + 1, np.searchsorted(s, x, "right")


def check(s, values):
    assert s.n == len(values) and sum(len(v) * w for _, w, v in s.buffers) + s.loose == len(values)
    for q, x in zip(QS, s.quantiles(QS)):
        lo, hi = ranks(values, x)
        want = max(1, int(np.ceil(q * len(values))))
        assert lo - s.error <= want <= hi + s.error


@pytest.mark.parametrize("kind", ["uniform", "sorted", "ties", "heavy"])
def test_bound_holds(kind):
    rng = np.random.default_rng(1)
    v = {"uniform": rng.uniform(0, 1, 50_000), "sorted": np.arange(50_000.0), "ties": rng.integers(0, 5, 50_000).astype(float), "heavy": rng.pareto(1, 50_000)}[kind]
    s = Summary(64, 6)
    for part in np.array_split(v, 37):
        s.add(part)
    check(s, v)
    assert s.error < len(v) * 0.1 and len(s.buffers) <= 6


def test_merging_in_any_shape_keeps_the_bound():
    rng = np.random.default_rng(2)
    v = rng.normal(size=30_000)
    parts = []
    for p in np.split(v, np.sort(rng.integers(0, 30_000, 20))):
        s = Summary(64, 6)
        s.add(p)
        parts.append(Summary.of(*s.row(), 64, 6))  # as stored and read
    while len(parts) > 1:
        a, b = parts.pop(0), parts.pop(0)
        a.merge(b)
        parts.append(a)
    check(parts[0], v)


def test_small_groups_are_exact_and_empty_ones_null():
    s = Summary(64, 6)
    s.add(np.array([5, 1, 3]))
    assert s.quantiles([0.5, 0.9, 0.0]) == [3, 5, 1] and s.error == 0
    assert Summary().quantiles([0.5]) == [None]


def test_groups_in_spark(spark):
    rng = np.random.default_rng(3)
    data = [("hot", None, int(x)) for x in rng.integers(0, 10**15, 12_000)] + [(None, "b", 4), (None, "b", None), ("", "b", 6), ("", "b", 8)]
    df = spark.createDataFrame(data, "s string, name string, v bigint").repartition(6).withColumn("n", F.lit("clash")).withColumn("_v", F.lit(1))
    m = merge_summaries(summaries(df, ["s", "name"], "v", k=256), ["s", "name"], k=256)
    got = {(r["s"], r["name"]): r for r in percentiles(m, ["s", "name"], {"p50": 0.5, "p99": 0.99}, k=256).collect()}
    assert (got[None, "b"]["n"], got[None, "b"]["p50"], got["", "b"]["p50"], got["", "b"]["p99"]) == (1, 4, 6, 8)
    h = got["hot", None]
    hot = np.array([x for s, _, x in data if s == "hot"])
    for q, c in ((0.5, "p50"), (0.99, "p99")):
        lo, hi = ranks(hot, h[c])
        assert lo - h["rank_error"] <= q * len(hot) <= hi + h["rank_error"] and h["rank_error"] < 0.05 * len(hot)


def test_doubles_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", float("nan")), ("a", None), ("a", float("inf"))], "s string, v double")
    r = percentiles(merge_summaries(summaries(df, ["s"], "v"), ["s"]), ["s"], {"p50": 0.5}).collect()
    assert [(x["n"], x["p50"]) for x in r] == [(2, 1.5)]
    assert percentiles(merge_summaries(summaries(df.limit(0), ["s"], "v"), ["s"]), ["s"], {"p50": 0.5}).count() == 0


@pytest.mark.parametrize("shape", ["stream", "pairs", "one by one", "uneven"])
def test_error_known_beforehand(shape):
    rng, n, k = np.random.default_rng(4), 60_000, 64
    v = rng.permutation(n).astype(float)
    cuts = {"stream": [], "pairs": np.arange(1000, n, 1000), "one by one": np.arange(64, n, 64), "uneven": np.sort(rng.integers(0, n, 60))}[shape]
    total = Summary(k, 4)
    for p in np.split(v, cuts):
        s = Summary(k, 4)
        s.add(p)
        total.merge(s)
    check(total, v)
    assert total.error <= (np.log2(n / k) + 2) * n / (2 * k) and len(total.buffers) <= max(4, np.log2(n / k) + 1)


def test_buffer_size():
    for error, most in ((0.01, 10**6), (0.001, 10**12), (0.5, 10)):
        k = buffer_size(error, most)
        assert k >= most or (np.log2(most / k) + 2) / (2 * k) <= error
        assert k == 1 or (np.log2(most / (k // 2)) + 2) / k > error


def test_one_set_of_summaries_gives_one_result(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("a", int(x)) for x in rng.integers(0, 10**9, 20_000)], "s string, v bigint").repartition(16)
    from teleloom.plans.storage import Workspace

    parts = Workspace(spark, "test").put("parts", summaries(df, ["s"], "v", k=64, b=4))
    got = set()
    for n in (1, 5, 16):
        for seed in (1, 2):
            m = merge_summaries(parts.repartition(n, F.rand(seed)), ["s"], k=64, b=4)
            got |= {tuple(r) for r in percentiles(m, ["s"], {"p50": 0.5, "p99": 0.99}, k=64, b=4).collect()}
    assert len(got) == 1 and next(iter(got))[2] > 0


def test_within_bound_counts_ranks(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 101)] + [(None, 5)], "s string, v bigint")
    right = spark.createDataFrame([("a", 100, 2, 52, 99), (None, 1, 0, 5, 5)], "s string, n bigint, rank_error bigint, p50 bigint, p99 bigint")
    qs = {"p50": 0.5, "p99": 0.99}
    assert {r["s"]: (r["n"], r["p50"], r["p99"]) for r in within_bound(df, ["s"], "v", right, qs).collect()} == {"a": (100, True, True), None: (1, True, True)}
    assert within_bound(df, ["s"], "v", right.withColumn("p50", F.lit(53).cast("bigint")), qs).filter("s = 'a'").first()["p50"] is False
