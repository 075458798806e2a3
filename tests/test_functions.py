import pytest
from pyspark.sql import functions as F

from teleloom.functions import format as Z
from teleloom.functions.ids import normal_id, pack_ids, packed_span, packed_trace


def apply(spark, f, values, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize("digits,pairs", [(2, {1.005: "1.00", 1.255: "1.25", 0.125: "0.13", 2.675: "2.67", 0.0: "0.00", 12.0: "12.00"}), (1, {0.35: "0.3", 0.25: "0.3", 1.15: "1.1", -1.25: "-1.3", 10.25: "10.3"}), (0, {0.5: "1", 1.5: "2", 2.5: "3", 99.49: "99"})])
def test_fixed_follows_the_binary_value(spark, digits, pairs):
    assert apply(spark, lambda c: Z.to_fixed(c, digits), pairs) == list(pairs.values())


def test_durations(spark):
    pairs = {0: "0ns", 999: "999ns", -5: "-5ns", 1500: "1.5µs", 1_250: "1.3µs", 2_000_000: "2.0ms", 999_999_999: "1000.0ms", 1_500_000_000: "1.50s"}
    assert apply(spark, Z.format_duration, pairs, "bigint") == list(pairs.values())
    assert apply(spark, lambda c: Z.format_duration_as(c, F.lit(5_000_000)), [1000, 2_500_000], "bigint") == ["0.0ms", "2.5ms"]
    assert apply(spark, Z.format_duration, [None], "bigint") == [None]


@pytest.mark.parametrize("unit,pairs", [
    ("By", {0.0: "0.00 B", 2048.0: "2.00 KiB", -2048.0: "-2.00 KiB", 1023.0: "1023 B", 1024.0**5 * 3000: "3000 PiB"}), ("By/s", {2048.0: "2.00 KiB/s"}), ("s", {0.5: "500 ms", 125.0: "2m 5s", 0.0: "0 s", 5e-7: "0.50 μs", 59.0: "59.0 s", -61.0: "-1m 1s"}),
    ("ms", {1500.0: "1.50 s", 5.0: "5.00 ms", 0.25: "250 μs"}), ("%", {42.0: "42%"}), ("", {1234.0: "1.2K", 999.0: "999", 999950.0: "1M", 0.05: "0.1", -1500000.0: "-1.5M"}), ("1", {2e12: "2T"}), ("{request}", {12.0: "12 request"}), ("widgets", {7.0: "7 widgets"}),
])
def test_metric_values(spark, unit, pairs):
    assert apply(spark, lambda c: Z.format_metric_value(c, F.lit(unit)), pairs) == list(pairs.values())


def test_metric_values_that_are_not_finite(spark):
    assert apply(spark, lambda c: Z.format_metric_value(c, F.lit("By")), [float("nan"), float("inf"), float("-inf"), None]) == ["NaN", "Infinity", "-Infinity", None]


def test_tones_and_times(spark):
    assert apply(spark, Z.severity_tone, ["INFO", "WARN", "ERROR", "FATAL", "info", None], "string") == ["primary", "warning", "destructive", "destructive", "muted", "muted"]
    assert apply(spark, Z.status_tone, ["Ok", "Error", "Unset"], "string") == ["success", "destructive", "muted"]
    assert apply(spark, lambda c: Z.format_relative(c, 10**9), [10**9, 10**9 - 5_500, 10**9 - 120_000, 10**9 - 7_200_000, 0], "bigint") == ["now", "5s ago", "2m ago", "2h ago", "11d ago"]
    assert apply(spark, Z.format_clock, [1_500_000_000 * 10**9 + 123_456_789], "bigint") == ["02:40:00.123"]
    assert apply(spark, lambda c: Z.truncate(c, 3), ["abc", "abcd"], "string") == ["abc", "abc…"]
    assert [Z.uptime(12), Z.uptime(184), Z.uptime(7500)] == ["12s", "3m4s", "2h5m"]


def test_ids(spark):
    full = "AB" * 16
    assert apply(spark, normal_id, [full, "", None, "0" * 32, "0", " Ab "], "string") == [full.lower(), "", "", "", "", "ab"]
    df = spark.createDataFrame([("a" * 32, "b" * 16), ("zz", "y"), ("g" * 32, "b" * 16)], "t string, s string").withColumn("k", pack_ids(F.col("t"), F.col("s")))
    assert all((r["t"], r["s"]) == (r["a"], r["b"]) for r in df.select("t", "s", packed_trace("k").alias("a"), packed_span("k").alias("b")).collect())
