"""Deeply nested JSON records into flat tables with parent-child links, by Merkle identities of subtrees.

Every object and every array of attributes is brought into a canonical form (key order, number form, plain or
OTLP-typed values and JSON held in strings all read as the same thing) and named, bottom-up, by the hash of its own
scalars and of the names of the objects in it. What is identical is stored once in ``objects`` (and the leaves of an
attribute set once in ``leaves``); every occurrence, at any depth, is kept by ``bridge`` rows (parent, role, key,
ordinal, child), and ``roots`` ties a payload to its top object. Payloads that hold no object are in ``rejected``,
with the reason. The flat tables are joins along these names.

Nothing here recurses, so depth is bounded by memory alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from json.encoder import c_make_encoder, encode_basestring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.plans.skew import lookup_join
from teleloom.plans.storage import Workspace

#: The names of the typed wrappers of an OTLP attribute value.
SCALARS = ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue")
_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_NAMES = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _no_constant(name: str):
    raise ValueError(name)


def _whole(text: str):
    return int(text) if len(text) < 4000 else float(text)


def loads(text: str):
    """Strict JSON of any depth: NaN and infinities aren't valid."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return deep_loads(text)
    except ValueError as e:
        if "digits" not in str(e):
            raise
        return json.loads(text, parse_constant=_no_constant, parse_int=_whole)  # a number of thousands of digits


def deep_loads(text: str):
    """As ``loads``, on a stack of its own."""
    top: list = []
    stack: list = [(top, None)]
    at, want = 0, "value"

    def put(x) -> None:
        holder, key = stack[-1]
        holder.append(x) if isinstance(holder, list) else holder.__setitem__(key, x)

    while (at := _BLANK.match(text, at).end()) < len(text):
        c, holder = text[at], stack[-1][0]
        if want == "colon" or (want == "next" and c == "," and len(stack) > 1):
            if want == "colon" and c != ":":
                raise ValueError(f"no colon at {at}")
            want, at = "value" if want == "colon" or isinstance(holder, list) else "key", at + 1
        elif c in "}]" and want in ("next", "first") and len(stack) > 1 and isinstance(holder, dict) == (c == "}"):
            stack.pop()
            want, at = "next", at + 1
        elif c == '"' and (want == "key" or (want == "first" and isinstance(holder, dict))):
            key, at = scanstring(text, at + 1, True)
            stack[-1], want = (holder, key), "colon"
        elif want == "value" or (want == "first" and isinstance(holder, list)):
            if c in "{[":
                new: dict | list = {} if c == "{" else []
                put(new)
                stack.append((new, None))
                want, at = "first", at + 1
                continue
            if c == '"':
                x, at = scanstring(text, at + 1, True)
            elif c in _NAMES and text.startswith(_NAMES[c][0], at):
                x, at = _NAMES[c][1], at + len(_NAMES[c][0])
            elif m := _NUMBER.match(text, at):
                x, at = float(m.group()) if m.group(1) or m.group(2) else _whole(m.group()), m.end()
            else:
                raise ValueError(f"no value at {at}")
            put(x)
            want = "next"
        else:
            raise ValueError(f"unexpected {c!r} at {at}")
    if len(stack) > 1 or len(top) != 1:
        raise ValueError("cut off")
    return top[0]


def unpacked(x):
    """``x``, or what it holds if it is a string with JSON, in however many layers; None if that can't be read."""
    while isinstance(x, str):
        try:
            x = loads(x)
        except ValueError:
            return None
    return x


def as_list(x) -> list:
    """An array as it is (null elements keep their positions), one object as its only element, else nothing."""
    x = unpacked(x)
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def pairs(items: list) -> dict:
    """The typed values of a list of key and value; of a repeated key the last counts."""
    return {str(e["key"]): e.get("value") for e in items if isinstance(e, dict) and "key" in e}


def shape(x, typed: bool):
    """One level of a value: (its members, whether these are typed), members being a dict or a list, or (scalar, None).

    A typed value is what its wrapper holds; a bare scalar is itself, an array without its wrapper or an unknown
    wrapper null.
    """
    if not typed:
        return (x, False) if isinstance(x, (dict, list)) else (x, None)
    if not isinstance(x, dict):
        return (x if isinstance(x, (str, int, float)) else None), None
    for k in SCALARS:
        if k in x:
            v = x[k]
            if k == "intValue" and isinstance(v, str):
                try:
                    return _whole(v), None
                except ValueError:
                    return v, None
            return (v, False) if isinstance(v, (dict, list)) else (v, None)
    for k in ("arrayValue", "kvlistValue"):
        if k in x:
            items = as_list(x[k].get("values")) if isinstance(x[k], dict) else []
            return (items, True) if k == "arrayValue" else (pairs(items), True)
    return None, None


def attribute_set(x) -> tuple[dict, bool]:
    """The members of attributes or of a resource: plain objects as they are, OTLP lists of key and value as typed values."""
    x = unpacked(x)
    return (pairs(x), True) if isinstance(x, list) else (x, False) if isinstance(x, dict) else ({}, False)


def leaves(x, typed: bool = False) -> Iterator[tuple[str, str, str]]:
    """(path, type, JSON of the value) of each string, number or boolean below ``x``, the members of an attribute set."""
    stack = [("", x, typed)]
    while stack:
        path, v, below = stack.pop()
        for k, e in v.items() if isinstance(v, dict) else enumerate(v):
            p = f"{path}/{k}" if path else str(k)
            e, kind = shape(e, below)
            if kind is not None:
                stack.append((p, e, kind))
            elif e is not None:
                yield p, kind_of(e), canonical(e)


def kind_of(x) -> str:
    return "string" if isinstance(x, str) else "boolean" if isinstance(x, bool) else "number"


_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)
_PIECES = c_make_encoder and c_make_encoder(None, _ENCODER.default, encode_basestring, None, ":", ",", True, False, True)


def canonical(x) -> str:
    if isinstance(x, str):
        return encode_basestring(x)
    return "".join(_PIECES(x, 0)) if _PIECES else _ENCODER.encode(x)


def name_of(kind: str, content: str) -> bytes:
    return hashlib.blake2b(f"{kind}\0{content}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def readable(x):
    """Strings without halves of surrogate pairs, which no table can hold."""
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) else x


#: The columns that all tables are written in.
COLUMNS = "what string, h binary, a string, k string, n bigint, b binary, c string"
_ARROW = [(c.split()[0], {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}[c.split()[1]]) for c in COLUMNS.split(", ")]


class Merkle:
    """The distinct objects of some payloads and the links between them."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.known: set[bytes] = set()
        self.texts: dict[str, bytes | None] = {}  # attribute sets that were read from a string

    def add(self, kind: str, own, children: list[tuple[str, str | None, int, bytes]]) -> tuple[bytes, bool]:
        """Names an object by its own scalars and its children (role, key, ordinal, name); stores it, and says so, unless it is known here."""
        body = canonical(own)
        h = name_of(kind, body + "".join(f"\0{r}\0{k}\0{i}\0{c.hex()}" for r, k, i, c in children) if children else body)
        if h in self.known:
            return h, False
        self.known.add(h)
        self.rows.append(("object", h, kind, None, None, None, body))
        self.rows.extend(("bridge", h, role, key, i, c, None) for role, key, i, c in children)
        return h, True

    def attributes(self, x) -> bytes | None:
        """The name of an attribute set with all that is nested in it; None if it is empty."""
        if isinstance(x, str):
            if x not in self.texts:
                self.texts[x] = self.attributes(unpacked(x))
            return self.texts[x]
        top, typed = attribute_set(x)
        if not top:
            return None
        flat = {}
        for k, v in top.items():
            flat[k], deeper = shape(v, typed)
            if deeper is not None:
                break
        else:  # most are flat
            h, new = self.add("attributes", flat, [])
            if new:
                self.rows.extend(("leaf", h, k, kind_of(v), None, None, canonical(v)) for k, v in flat.items() if v is not None)
            return h
        # A frame is [kind, members still to come, whether they are typed, scalars, links, place in the frame above].
        frames = [["attributes", iter(top.items()), typed, {}, [], None]]
        while True:
            kind, members, below, own, links, place = frames[-1]
            for k, v in members:
                v, deeper = shape(v, below)
                if deeper is None:
                    own.append(v) if isinstance(own, list) else own.__setitem__(k, v)
                else:
                    if isinstance(own, list):
                        own.append(None)
                    frames.append(["object", iter(v.items()), deeper, {}, [], k] if isinstance(v, dict) else ["array", iter(enumerate(v)), deeper, [], [], k])
                    break
            else:
                if not isinstance(own, list):
                    links.sort(key=lambda x: x[1])
                h, new = self.add(kind, own, links)
                frames.pop()
                if not frames:
                    if new:
                        self.rows.extend(("leaf", h, path, t, None, None, v) for path, t, v in leaves(top, typed))
                    return h
                frames[-1][4].append(("element", None, place, h) if isinstance(frames[-1][3], list) else ("member", str(place), 0, h))

    def span(self, s: dict) -> bytes:
        links = [(role, None, 0, h) for role in ("attributes", "resource") if (h := self.attributes(s.get(role)))]
        for i, e in enumerate(as_list(s.get("events"))):
            if isinstance(e, dict):
                h = self.attributes(e.get("attributes"))
                below = [("attributes", None, 0, h)] if h else []
                links.append(("event", None, i, self.record("event", e, ("attributes",), below)))
        return self.record("span", s, ("attributes", "resource", "events"), links)

    def record(self, kind: str, x: dict, apart: tuple, links: list) -> bytes:
        """An object of a known kind: its fields that are not ``apart``, of which nested ones are objects of their own."""
        own, more = {}, []
        for k, v in x.items():
            if k not in apart:
                if isinstance(v, (dict, list)) and v:
                    more.append(("field", str(k), 0, self.attributes({"": v})))
                else:
                    own[k] = v
        return self.add(kind, own, links + sorted(more))[0]

    def payload(self, text) -> tuple[bytes | None, str]:
        """The name of a payload's object, or None and why it has none."""
        if not isinstance(text, str):
            return None, "null"
        if not text.strip():
            return None, "blank"
        try:
            top = loads(text)
        except ValueError:
            return None, "not JSON"
        top = unpacked(top)
        if not isinstance(top, dict):
            return None, "no object"
        spans = as_list(top.get("spans"))
        links = [("span", None, i, self.span(s)) for i, s in enumerate(spans) if isinstance(s, dict)]
        for root in as_list(top.get("rootSpan"))[:1]:
            if isinstance(root, dict):
                same = next((h for _, _, i, h in links if spans[i] == root), None)
                links.append(("root", None, 0, same or self.span(root)))
        return self.record("payload", top, ("spans", "rootSpan"), links), ""


class NestedTables:
    """roots, rejected, objects, bridge and leaves of a table of payloads, and the flat tables made from them.

    Null, blank and damaged payloads are in ``rejected`` (payload_id, reason, payload) and have no rows elsewhere.
    ``payload_id`` must be unique. ``rootSpan`` repeats one of the spans: it is kept as a bridge row of role ``root``
    (where it is the same object, that is all), and is none of the flat spans.
    """

    def __init__(self, payloads: DataFrame, id_col: str = "payload_id", text_col: str = "payload", keep: int = 200_000):
        spark = payloads.sparkSession

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Merkle()
            for batch in batches:
                odd = False
                for pid, text in zip(*(c.to_pylist() for c in batch.columns)):
                    h, why = m.payload(text)
                    m.rows.append(("reject", None, why, None, pid, None, text) if h is None else ("root", h, None, None, pid, None, None))
                    odd = odd or (isinstance(text, str) and "\\ud" in text.lower())
                rows, m.rows = [tuple(map(readable, r)) for r in m.rows] if odd else m.rows, []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _ARROW)], names=[c for c, _ in _ARROW])
                if len(m.known) > keep:  # bounded memory; what comes again is dropped by the distinct below
                    m.known.clear()
                    m.texts.clear()

        raw = payloads.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
        self.ws = Workspace(spark, "nested")
        rows = self.ws.put("parsed", raw.mapInArrow(parse, COLUMNS), by="what")
        self.roots = rows.filter("what = 'root'").select(F.col("n").alias("payload_id"), F.col("h").alias("root"))
        self.rejected = rows.filter("what = 'reject'").select(F.col("n").alias("payload_id"), F.col("a").alias("reason"), F.col("c").alias("payload"))
        self.objects = rows.filter("what = 'object'").select("h", F.col("a").alias("kind"), F.col("c").alias("content")).dropDuplicates(["h"])
        self.bridge = rows.filter("what = 'bridge'").select(F.col("h").alias("parent"), F.col("a").alias("role"), F.col("k").alias("key"), F.col("n").alias("ordinal"), F.col("b").alias("child")).distinct()
        self.leaves = rows.filter("what = 'leaf'").select("h", F.col("a").alias("attr_path"), F.col("k").alias("type"), F.col("c").alias("value")).distinct()
        self._stored: dict[str, DataFrame] = {}

    def _put(self, name: str, make) -> DataFrame:
        """A table that several joins read, stored at its first use."""
        if name not in self._stored:
            self._stored[name] = self.ws.put(name, make())
        return self._stored[name]

    def _spans(self) -> DataFrame:
        b = self.bridge.filter("role = 'span'").select(F.col("parent").alias("root"), F.col("ordinal").cast("int").alias("span_index"), F.col("child").alias("span"))
        return self._put("spans", lambda: lookup_join(self.roots, b, "root").select("payload_id", "span_index", "span"))

    def _events(self) -> DataFrame:
        b = self.bridge.filter("role = 'event'").select(F.col("parent").alias("span"), F.col("ordinal").cast("int").alias("event_index"), F.col("child").alias("event"))
        return self._put("events", lambda: lookup_join(self._spans(), b, "span").select("payload_id", "span_index", "event_index", "event"))

    def _content(self, kind: str) -> DataFrame:
        return self.objects.filter(F.col("kind") == kind).select(F.col("h").alias(kind), "content")

    def spans(self) -> DataFrame:
        """(payload_id, span_index, span, content): the fields of each span as canonical JSON."""
        return lookup_join(self._spans(), self._content("span"), "span").select("payload_id", "span_index", F.lower(F.hex("span")).alias("span"), "content")

    def events(self) -> DataFrame:
        """(payload_id, span_index, event_index, event, content)."""
        return lookup_join(self._events(), self._content("event"), "event").select("payload_id", "span_index", "event_index", F.lower(F.hex("event")).alias("event"), "content")

    def attributes(self) -> DataFrame:
        """(payload_id, span_index, event_index, attr_path, type, value): each leaf with all its parents.

        event_index is -1 for a span's attributes and -2 for its resource. Objects that occur in a large share of the
        payloads have their few partner rows broadcast, in each of the joins; the rest meet in a shuffle.
        """
        at = self.bridge.filter("role in ('attributes', 'resource')").select(F.col("parent"), "role", F.col("child").alias("h"))
        own = lookup_join(self._spans().withColumnRenamed("span", "parent"), at, "parent").select("payload_id", "span_index", F.when(F.col("role") == "resource", -2).otherwise(-1).cast("int").alias("event_index"), "h")
        of_events = lookup_join(self._events().withColumnRenamed("event", "parent"), at, "parent").select("payload_id", "span_index", "event_index", "h")
        uses = self._put("uses", lambda: own.unionByName(of_events))
        return lookup_join(uses, self.leaves, "h").select("payload_id", "span_index", "event_index", "attr_path", "type", "value")
