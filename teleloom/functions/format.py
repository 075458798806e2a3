"""Values as text (F1-F11, F17-F22), JVM-side and exact.

Fixed-point text follows the exact binary value of a double, ties away from zero, as browsers do: 1.005 with two
digits is 1.00. The product with a power of ten is taken with its rounding error (Dekker), so no tie is misjudged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1


def _halves(x: Column) -> tuple[Column, Column]:
    c = x * F.lit(_SPLIT)
    high = c - (c - x)
    return high, x - high


def to_fixed(x: Column, digits: int | Column) -> Column:
    """``x`` with ``digits`` (0, 1 or 2; may be a column) decimals; for magnitudes below 1e12."""
    d = digits if isinstance(digits, Column) else F.lit(digits)
    scale = F.when(d == 0, 1.0).when(d == 1, 10.0).otherwise(100.0)  # short enough that its low half is 0
    s = F.struct(F.abs(x.cast("double")).alias("a"), scale.alias("s"), d.alias("d"), (x < 0).alias("neg"))

    def text(v: Column) -> Column:
        high, low = _halves(v["a"])
        p = v["a"] * v["s"]
        err = (high * v["s"] - p) + low * v["s"]
        whole = F.floor(p)
        # the error only matters at a tie
        n = whole.cast("bigint") + F.when((p - whole > 0.5) | ((p - whole == 0.5) & (err >= 0)), 1).otherwise(0)
        return F.concat(F.when(v["neg"], "-").otherwise(""), _point(n, v["d"]))

    return _once(s, text)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, as the only element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _point(n: Column, d: Column) -> Column:
    s = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), d + 1), F.lit("0"))
    return F.when(d == 0, n.cast("string")).otherwise(F.concat(F.substring(s, F.lit(1), F.length(s) - d), F.lit("."), F.substring(s, F.length(s) - d + 1, d)))


def _digits(x: Column) -> Column:
    a = F.abs(x)
    return F.when(a >= 100, 0).when(a >= 10, 1).otherwise(2)


def fixed(x: Column) -> Column:
    """no decimals from 100 on, one from 10 on, else two."""
    return to_fixed(x, _digits(x))


def _duration(ns: Column, by: Column) -> Column:
    x = ns.cast("double")
    scaled = F.when(by < 10**6, x / 1e3).when(by < 10**9, x / 1e6).otherwise(x / 1e9)
    unit = F.when(by < 10**6, "µs").when(by < 10**9, "ms").otherwise("s")
    return F.concat(to_fixed(scaled, F.when(by < 10**9, 1).otherwise(2)), unit)


def format_duration(ns: Column) -> Column:
    """ns, µs, ms or s; negative values stay in ns; null stays null."""
    return F.when(ns < 1000, F.concat(ns.cast("string"), F.lit("ns"))).otherwise(_duration(ns, ns))


def format_duration_as(ns: Column, total: Column) -> Column:
    """as F1, in the unit that ``total`` asks for."""
    return F.when(total < 1000, F.concat(F.floor(ns.cast("double") + 0.5).cast("bigint").cast("string"), F.lit("ns"))).otherwise(_duration(ns, total))


def format_relative(then_ms: Column, now_ms: Column | int) -> Column:
    """now, or whole seconds, minutes, hours or days ago; the present is an argument."""
    d = (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)) - then_ms
    ago = lambda k, u: F.concat(F.floor(d / F.lit(k)).cast("bigint").cast("string"), F.lit(u))
    return F.when(d < 1000, F.lit("now")).when(d < 60_000, ago(1000, "s ago")).when(d < 3_600_000, ago(60_000, "m ago")).when(d < 86_400_000, ago(3_600_000, "h ago")).otherwise(ago(86_400_000, "d ago"))


def format_clock(ns: Column) -> Column:
    """HH:mm:ss.SSS, 24 hours, in the session's time zone."""
    return F.date_format(F.timestamp_micros(F.floor(ns / F.lit(1000)).cast("bigint")), "HH:mm:ss.SSS")


def short_id(c: Column, n: int = 16) -> Column:
    """F5."""
    return F.substring(c, 1, n)


def _scaled_bytes(x: Column) -> tuple[Column, Column]:
    a, value, unit = F.abs(x), x / float(1024**5), F.lit(" PiB")
    for i, u in reversed(list(enumerate(["B", "KiB", "MiB", "GiB", "TiB"]))):
        value, unit = F.when(a < float(1024 ** (i + 1)), x / float(1024**i)).otherwise(value), F.when(a < float(1024 ** (i + 1)), F.lit(f" {u}")).otherwise(unit)
    return value, unit


def _scaled_seconds(x: Column) -> tuple[Column, Column]:
    a = F.abs(x)
    return F.when(a >= 1, x).when(a >= 1e-3, x * 1e3).otherwise(x * 1e6), F.when(a >= 1, " s").when(a >= 1e-3, " ms").otherwise(" μs")


def _scaled_millis(x: Column) -> tuple[Column, Column]:
    a = F.abs(x)
    return F.when(a >= 1000, x / 1000).when(a >= 1, x).otherwise(x * 1000), F.when(a >= 1000, " s").when(a >= 1, " ms").otherwise(" μs")


def _minutes(x: Column) -> Column:
    a = F.abs(x)
    m = F.floor(a / 60)
    return F.concat(F.when(x < 0, "-").otherwise(""), m.cast("bigint").cast("string"), F.lit("m "), to_fixed(a - m * 60, 0), F.lit("s"))


def format_bytes(x: Column) -> Column:
    """steps of 1024 up to PiB."""
    value, unit = _scaled_bytes(x)
    return F.concat(fixed(value), unit)


def format_seconds(x: Column) -> Column:
    """F8."""
    value, unit = _scaled_seconds(x)
    return F.when(x == 0, F.lit("0 s")).when(F.abs(x) >= 60, _minutes(x)).otherwise(F.concat(fixed(value), unit))


def format_millis(x: Column) -> Column:
    """F9."""
    value, unit = _scaled_millis(x)
    return F.concat(fixed(value), unit)


def compact(x: Column) -> Column:
    """at most one decimal, with K, M, B or T from a thousand on; half away from zero on the decimal value."""

    def text(v: Column) -> Column:
        a = v["a"]
        # a step up where rounding to one decimal would reach a thousand
        k = F.when(a < 999.95, 0).when(a < 999950, 1).when(a < 999950000, 2).when(a < 999950000000, 3).otherwise(4)
        n = F.round(a / F.pow(F.lit(1000.0), k).cast("decimal(20,0)"), 1).cast("decimal(30,1)")
        return F.concat(F.when(v["neg"], "-").otherwise(""), F.regexp_replace(n.cast("string"), r"\.0$", ""), F.element_at(F.array(*map(F.lit, ["", "K", "M", "B", "T"])), k + 1))

    return _once(F.struct(F.abs(x).cast("decimal(38,10)").alias("a"), (x < 0).alias("neg")), text)


def format_metric_value(x: Column, unit: Column) -> Column:
    """by unit; non-finite values as their names, a unit in braces without them."""
    odd = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
    size, seconds, millis = _scaled_bytes(x), _scaled_seconds(x), _scaled_millis(x)
    of_bytes = unit.isin("By", "By/s")
    value = F.when(of_bytes, size[0]).when(unit == "s", seconds[0]).otherwise(millis[0])
    name = F.when(of_bytes, size[1]).when(unit == "s", seconds[1]).otherwise(millis[1])
    scaled = F.concat(fixed(value), name, F.when(unit == "By/s", "/s").otherwise(""))
    braces = unit.startswith("{") & unit.endswith("}")
    tail = F.when(unit == "%", "%").when(unit.isin("", "1"), "").when(braces, F.concat(F.lit(" "), F.substring(unit, F.lit(2), F.length(unit) - 2))).otherwise(F.concat(F.lit(" "), unit))
    usual = F.when((unit == "s") & (x == 0), F.lit("0 s")).when((unit == "s") & (F.abs(x) >= 60), _minutes(x)).when(unit.isin("By", "By/s", "s", "ms"), scaled).otherwise(F.concat(compact(x), tail))
    return F.when(odd.isNotNull(), odd).otherwise(usual)


def status_tone(c: Column) -> Column:
    """F17."""
    return F.when(c == "Ok", "success").when(c == "Error", "destructive").when(c == "Unset", "muted")


def severity_tone(c: Column) -> Column:
    """case counts; anything else is muted."""
    return F.when(c == "INFO", "primary").when(c == "WARN", "warning").when(c.isin("ERROR", "FATAL"), "destructive").otherwise("muted")


def truncate(c: Column, n: int) -> Column:
    """F22."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def uptime(seconds: float) -> str:
    """F20."""
    s = int(seconds)
    return f"{s}s" if s < 60 else f"{s // 60}m{s % 60}s" if s < 3600 else f"{s // 3600}h{s % 3600 // 60}m"
