"""OTLP protobuf export requests into the JSON shape of the same requests.

Only the wire format is read: a message is a sequence of (field number, wire type, value). Which fields there are, and
what they are called in JSON, is a table; unknown fields are skipped.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

#: The protocol's messages. Field number: (JSON name, kind); ``*`` marks a repeated field, an upper-case
#: kind is a message.
FIELDS = {
    "Traces": {1: ("resourceSpans", "*ResourceSpans")},
    "ResourceSpans": {1: ("resource", "Resource"), 2: ("scopeSpans", "*ScopeSpans")},
    "ScopeSpans": {2: ("spans", "*Span")},
    "Span": {1: ("traceId", "hex"), 2: ("spanId", "hex"), 4: ("parentSpanId", "hex"), 5: ("name", "text"), 6: ("kind", "int"), 7: ("startTimeUnixNano", "fixed"), 8: ("endTimeUnixNano", "fixed"), 9: ("attributes", "*KeyValue"), 11: ("events", "*Event"), 15: ("status", "Status")},
    "Event": {1: ("timeUnixNano", "fixed"), 2: ("name", "text"), 3: ("attributes", "*KeyValue")},
    "Status": {2: ("message", "text"), 3: ("code", "int")},
    "Resource": {1: ("attributes", "*KeyValue")},
    "KeyValue": {1: ("key", "text"), 2: ("value", "AnyValue")},
    "AnyValue": {1: ("stringValue", "text"), 2: ("boolValue", "bool"), 3: ("intValue", "int64"), 4: ("doubleValue", "double"), 5: ("arrayValue", "ArrayValue"), 6: ("kvlistValue", "KeyValueList"), 7: ("bytesValue", "base64")},
    "ArrayValue": {1: ("values", "*AnyValue")},
    "KeyValueList": {1: ("values", "*KeyValue")},
    "Metrics": {1: ("resourceMetrics", "*ResourceMetrics")},
    "ResourceMetrics": {1: ("resource", "Resource"), 2: ("scopeMetrics", "*ScopeMetrics")},
    "ScopeMetrics": {2: ("metrics", "*Metric")},
    "Metric": {1: ("name", "text"), 2: ("description", "text"), 3: ("unit", "text"), 5: ("gauge", "Numbers"), 7: ("sum", "Numbers"), 9: ("histogram", "Histogram"), 10: ("exponentialHistogram", "ExponentialHistogram"), 11: ("summary", "Summary")},
    "Numbers": {1: ("dataPoints", "*Number"), 2: ("aggregationTemporality", "int"), 3: ("isMonotonic", "bool")},
    "Histogram": {1: ("dataPoints", "*HistogramPoint"), 2: ("aggregationTemporality", "int")},
    "ExponentialHistogram": {1: ("dataPoints", "*ExponentialPoint"), 2: ("aggregationTemporality", "int")},
    "Summary": {1: ("dataPoints", "*SummaryPoint")},
    "Number": {3: ("timeUnixNano", "fixed"), 4: ("asDouble", "double"), 6: ("asInt", "sfixed"), 7: ("attributes", "*KeyValue")},
    "HistogramPoint": {3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double"), 9: ("attributes", "*KeyValue"), 11: ("min", "double"), 12: ("max", "double")},
    "ExponentialPoint": {1: ("attributes", "*KeyValue"), 3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double"), 12: ("min", "double"), 13: ("max", "double")},
    "SummaryPoint": {3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double"), 7: ("attributes", "*KeyValue")},
    "Logs": {1: ("resourceLogs", "*ResourceLogs")},
    "ResourceLogs": {1: ("resource", "Resource"), 2: ("scopeLogs", "*ScopeLogs")},
    "ScopeLogs": {2: ("logRecords", "*LogRecord")},
    "LogRecord": {1: ("timeUnixNano", "fixed"), 2: ("severityNumber", "int"), 3: ("severityText", "text"), 5: ("body", "AnyValue"), 6: ("attributes", "*KeyValue"), 9: ("traceId", "hex"), 10: ("spanId", "hex"), 11: ("observedTimeUnixNano", "fixed")},
}


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut off")
        byte = data[at]
        out |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return out & (2**64 - 1), at


def _raw(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, number or bytes) of each field of a message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 2, 5):
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field is cut off")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _value(kind: str, x):
    """A scalar in the form that JSON has it: 64-bit integers as text, identifiers in hex."""
    if isinstance(x, int):
        if kind == "bool":
            return bool(x)
        signed = x - 2**64 if x >= 2**63 else x
        return str(signed) if kind == "int64" else signed
    b = bytes(x)
    if kind == "double":
        v = struct.unpack("<d", b)[0]
        return v if v - v == 0 else "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    if kind in ("fixed", "sfixed"):
        return str(int.from_bytes(b, "little", signed=kind == "sfixed"))
    return b.hex() if kind == "hex" else base64.b64encode(b).decode() if kind == "base64" else b.decode("utf-8", "replace")


def decode(data: bytes, message: str) -> dict:
    """The JSON shape of a message (``Traces``, ``Metrics`` or ``Logs``); ValueError if it can't be read. Messages may nest to any depth."""
    top: dict = {}
    todo: list[tuple[dict, str, memoryview]] = [(top, message, memoryview(data))]
    while todo:
        out, name, body = todo.pop()
        fields = FIELDS[name]
        for number, x in _raw(body):
            if number not in fields:
                continue
            key, kind = fields[number]
            many, kind = kind.startswith("*"), kind.lstrip("*")
            if kind in FIELDS:
                if isinstance(x, int):
                    raise ValueError(f"{key} is no message")
                made: dict = {}
                todo.append((made, kind, x))
            else:
                try:
                    made = _value(kind, x)
                except struct.error as e:
                    raise ValueError(f"{key}: {e}") from None
            if many:
                out.setdefault(key, []).append(made)
            else:
                out[key] = made
    return top
