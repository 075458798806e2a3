"""Trace and span identifiers: normal form and compact keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_id(c: Column | str) -> Column:
    """Lower-case hex; ``''`` for null, empty and all-zero ids. Never null."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(F.ltrim(x, F.lit("0")) == "", F.lit("")).otherwise(x)


def is_zero_id(c: Column | str) -> Column:
    """True for ``''``, sixteen or thirty-two zeros."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isin("", "0" * 16, "0" * 32)


def pack_ids(trace: Column, span: Column) -> Column:
    """A binary key of a trace and span id in normal form: 24 bytes for ids of full length, else their text."""
    text = F.encode(F.concat_ws("/", trace, span), "UTF-8")
    return F.when((F.length(trace) == 32) & (F.length(span) == 16), F.coalesce(F.unhex(F.concat(trace, span)), text)).otherwise(text)


def packed_trace(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.when(F.length(key) == 24, F.lower(F.substring(F.hex(key), 1, 32))).otherwise(F.substring_index(F.decode(key, "UTF-8"), "/", 1))


def packed_span(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.when(F.length(key) == 24, F.lower(F.substring(F.hex(key), 33, 16))).otherwise(F.substring_index(F.decode(key, "UTF-8"), "/", -1))
