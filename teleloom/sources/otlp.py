"""OTLP/JSON export requests to flat signals, JVM-side.

A request is one JSON object with resourceSpans, resourceMetrics or resourceLogs. Attribute values are read as their
JSON text and converted by built-in expressions, nested values down to ``DEPTH`` levels; requests with deeper ones,
which are rare, first have these values converted in Python (``settled``), whatever their depth. Scope attributes, span links, exemplars and buckets are not kept. Records are numbered in their order within a
request: arrival_seq is batch_seq times 2^24 plus that number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 2
_POINT = "array<struct<timeUnixNano:string,asInt:string,asDouble:string,count:string,sum:string,min:string,max:string,attributes:string>>"
_KIND = f"struct<dataPoints:{_POINT},aggregationTemporality:string,isMonotonic:boolean>"
_RES = "resource:struct<attributes:string>"
_SPAN = "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:string,events:array<struct<name:string,timeUnixNano:string,attributes:string>>,status:struct<code:string,message:string>>"
_METRIC = f"struct<name:string,description:string,unit:string,gauge:{_KIND},sum:{_KIND},histogram:{_KIND},exponentialHistogram:{_KIND},summary:{_KIND}>"
_LOG = "struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:string,attributes:string,traceId:string,spanId:string>"
REQUEST = f"resourceSpans array<struct<{_RES},scopeSpans:array<struct<spans:array<{_SPAN}>>>>>, resourceMetrics array<struct<{_RES},scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>, resourceLogs array<struct<{_RES},scopeLogs:array<struct<logRecords:array<{_LOG}>>>>>"

#: Enumerations of the protocol, by number.
KINDS = ["Unspecified", "Internal", "Server", "Client", "Producer", "Consumer"]
STATUS = ["Unset", "Ok", "Error"]
TEMPORALITY = ["Unspecified", "Delta", "Cumulative"]


def _enum(c: Column, names: list[str], prefix: str) -> Column:
    """A number or a constant's name; anything else is the first of ``names``."""
    out = F.lit(names[0])
    for i, n in enumerate(names):
        out = F.when((c == str(i)) | (F.upper(c) == f"{prefix}_{n.upper()}"), n).otherwise(out)
    return out


_ANY = "jsonValue string, stringValue string, boolValue string, intValue string, doubleValue string, bytesValue string, arrayValue struct<values:array<string>>, kvlistValue struct<values:array<struct<key:string,value:string>>>"
_PAIRS = "array<struct<key:string,value:string>>"


def _with(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _quoted(c: str) -> str:
    return _with("q", f"to_json(array({c}))", "substr(q, 2, length(q) - 2)")


def any_value(raw: str, depth: int = DEPTH) -> str:
    """P5, as SQL: the JSON of an attribute value: strings quoted, numbers and booleans bare, non-finite numbers as quoted names, an absent value as an empty string."""
    v, x = f"v{depth}", f"x{depth}"
    number = f"""CASE WHEN lower({v}.doubleValue) = 'nan' THEN '"NaN"' WHEN lower({v}.doubleValue) IN ('infinity', '+infinity', 'inf', '+inf') THEN '"+Inf"' WHEN lower({v}.doubleValue) IN ('-infinity', '-inf') THEN '"-Inf"' ELSE {v}.doubleValue END"""
    body = f"""CASE WHEN {v}.jsonValue IS NOT NULL THEN {v}.jsonValue WHEN {v}.stringValue IS NOT NULL THEN {_quoted(f'{v}.stringValue')} WHEN {v}.intValue IS NOT NULL THEN {v}.intValue
  WHEN {v}.boolValue IS NOT NULL THEN lower({v}.boolValue) WHEN {v}.doubleValue IS NOT NULL THEN {number} WHEN {v}.bytesValue IS NOT NULL THEN {_quoted(f'{v}.bytesValue')}"""
    if depth:
        items = f"transform({v}.arrayValue.values, {x} -> {any_value(x, depth - 1)})"
        pairs = f"array_sort(transform(filter({v}.kvlistValue.values, {x} -> {x}.key IS NOT NULL), {x} -> concat({_quoted(f'{x}.key')}, ':', {any_value(f'{x}.value', depth - 1)})))"
        body += f" WHEN {v}.arrayValue IS NOT NULL THEN concat('[', coalesce(array_join({items}, ','), ''), ']') WHEN {v}.kvlistValue IS NOT NULL THEN concat('{{', coalesce(array_join({pairs}, ','), ''), '}}')"
    return _with(v, f"from_json({raw}, '{_ANY}')", body + """ ELSE '""' END""")


def value_text(v) -> tuple[str, int]:
    """What ``any_value`` gives for a parsed value of any depth, and how many levels it has."""
    done: list[tuple[str, int]] = []
    todo: list[tuple] = [("value", v)]
    while todo:
        step, x = todo.pop()
        if step == "value":
            x = x if isinstance(x, dict) else {}
            for k in ("arrayValue", "kvlistValue"):
                if x.get(k) is not None:
                    items = x[k].get("values") if isinstance(x[k], dict) else None
                    items = [e for e in items or [] if k == "arrayValue" or (isinstance(e, dict) and e.get("key") is not None)] if isinstance(items, list) else []
                    todo.append((k, [e["key"] for e in items] if k == "kvlistValue" else len(items)))
                    todo.extend(("value", e if k == "arrayValue" else e.get("value")) for e in reversed(items))
                    break
            else:
                done.append((_scalar_text(x), 0))
            continue
        n = x if step == "arrayValue" else len(x)
        parts, done[len(done) - n :] = done[len(done) - n :], []
        texts = [t for t, _ in parts]
        text = f"[{','.join(texts)}]" if step == "arrayValue" else "{" + ",".join(sorted(f"{json.dumps(str(k), ensure_ascii=False)}:{t}" for k, t in zip(x, texts))) + "}"
        done.append((text, 1 + max((d for _, d in parts), default=0)))
    return done[0]


def _scalar_text(x: dict) -> str:
    if x.get("stringValue") is not None:
        return json.dumps(x["stringValue"], ensure_ascii=False)
    if x.get("intValue") is not None:
        return str(x["intValue"])
    if x.get("boolValue") is not None:
        return str(x["boolValue"]).lower()
    d = x.get("doubleValue")
    if d is not None:
        name = {"nan": "NaN", "infinity": "+Inf", "+infinity": "+Inf", "inf": "+Inf", "+inf": "+Inf", "-infinity": "-Inf", "-inf": "-Inf"}.get(str(d).lower())
        return f'"{name}"' if name else str(d)
    return json.dumps(x["bytesValue"]) if x.get("bytesValue") is not None else '""'


def settle(line: str) -> str:
    """A request line in which values of more than ``DEPTH`` levels are replaced by their text."""
    from teleloom.operators.nested import loads

    try:
        top = loads(line)
    except ValueError:
        return line
    todo = [top]
    while todo:
        x = todo.pop()
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            if k in ("value", "body") and isinstance(v, dict):
                text, levels = value_text(v)
                if levels > DEPTH:
                    x[k] = {"jsonValue": text}
            elif isinstance(v, (dict, list)):
                todo.append(v)
    return json.dumps(top)


def settled(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with deep values settled; only lines with more nested values than ``DEPTH`` pass through Python."""
    deep = F.coalesce(F.size(F.regexp_extract_all(column, F.lit('"(arrayValue|kvlistValue)"'))) > DEPTH, F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{column: [settle(t) for t in pdf[column]]})

    return lines.filter(~deep).unionByName(lines.filter(deep).mapInPandas(run, lines.schema))


def parsed(lines: DataFrame) -> DataFrame:
    """Requests (batch_seq, received_at and the fields of a request) from numbered lines in ``value``."""
    return settled(lines).select("batch_seq", "received_at", F.from_json("value", REQUEST).alias("r")).select("batch_seq", "received_at", "r.*")


def is_request(line: str) -> Column:
    """Whether a line can be read as a request: a JSON object."""
    r = F.from_json(line, REQUEST + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.coalesce(r.isNotNull() & r["_bad"].isNull() & F.trim(F.col(line)).startswith("{"), F.lit(False))


def attributes(raw: str) -> str:
    """As SQL: a list of key and value as map<string,string>; of a repeated key the last counts; null or unreadable lists are empty."""
    items = f"filter(coalesce(from_json({raw}, '{_PAIRS}'), CAST(array() AS {_PAIRS})), e -> e.key IS NOT NULL)"
    last = "filter(l, (e, i) -> i = cardinality(l) - array_position(reverse(transform(l, k -> k.key)), e.key))"
    return _with("l", items, f"map_from_entries(transform({last}, e -> struct(e.key, {any_value('e.value')})))")


def text_of(json: Column) -> Column:
    """The text of a JSON scalar: a string without quotes, anything else as it is."""
    return F.when(json.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")).otherwise(json)


def service_of(resource: Column) -> Column:
    """Service.name as text, '' if there is none."""
    return F.coalesce(text_of(F.try_element_at(resource, F.lit("service.name"))), F.lit(""))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON files, one to a line, numbered by ``batch_seq`` in the order of files and lines; damaged lines are dropped."""
    lines = numbered(spark.read.text(path)).withColumn("received_at", F.current_timestamp())
    return parsed(lines.filter(is_request("value")))


def numbered(requests: DataFrame) -> DataFrame:
    """``requests`` with batch_seq from their place: split number times 2^24 plus row number (room for 2^15 splits)."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return requests.withColumn("batch_seq", F.shiftleft(F.spark_partition_id().cast("bigint"), 24) + row + 1)


def _records(requests: DataFrame, field: str, scopes: str, inner: str, split=None) -> DataFrame:
    """(batch_seq, received_at, arrival_seq, resource, x) of each record of a signal, x the record; ``split`` makes an array of records of each."""
    received = F.col("received_at") if "received_at" in requests.columns else F.current_timestamp().alias("received_at")
    types = dict(_types())

    def of_scope(r: Column):
        def one(s: Column) -> Column:
            records = F.coalesce(s[inner], F.array().cast(types[inner]))
            if split is not None:
                records = F.flatten(F.transform(records, split))
            return F.transform(records, lambda x: F.struct(r["resource"]["attributes"].alias("res"), x.alias("x")))

        return one

    rows = F.flatten(F.transform(F.col(field), lambda r: F.flatten(F.transform(F.coalesce(r[scopes], F.array().cast(types[scopes])), of_scope(r)))))
    e = requests.filter(F.col(field).isNotNull()).select("batch_seq", received, F.posexplode(rows).alias("at", "e"))
    return e.select("batch_seq", "received_at", (F.shiftleft("batch_seq", 24) + F.col("at")).alias("arrival_seq"), F.expr(attributes("e.res")).alias("resource"), F.col("e.x").alias("x"))


def _types() -> list[tuple[str, str]]:
    return [("scopeSpans", f"array<struct<spans:array<{_SPAN}>>>"), ("spans", f"array<{_SPAN}>"), ("scopeMetrics", f"array<struct<metrics:array<{_METRIC}>>>"), ("metrics", f"array<{_METRIC}>"),
        ("scopeLogs", f"array<struct<logRecords:array<{_LOG}>>>"), ("logRecords", f"array<{_LOG}>")]


def _ns(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))


def spans(requests: DataFrame) -> DataFrame:
    """P1."""
    r = _records(requests, "resourceSpans", "scopeSpans", "spans")
    event = f"named_struct('name', coalesce(v.name, ''), 'ts_ns', coalesce(try_cast(v.timeUnixNano AS bigint), 0L), 'attributes', {attributes('v.attributes')})"
    events = F.expr(f"transform(coalesce(x.events, CAST(array() AS array<struct<name:string,timeUnixNano:string,attributes:string>>)), v -> {event})")
    return r.select("arrival_seq", "batch_seq", "received_at", F.lower(F.coalesce("x.traceId", F.lit(""))).alias("trace_id"), F.lower(F.coalesce("x.spanId", F.lit(""))).alias("span_id"), F.lower(F.coalesce("x.parentSpanId", F.lit(""))).alias("parent_span_id"),
        F.coalesce("x.name", F.lit("")).alias("name"), _enum(F.col("x.kind"), KINDS, "SPAN_KIND").alias("kind"), service_of(F.col("resource")).alias("service_name"), _ns("x.startTimeUnixNano").alias("start_ns"), _ns("x.endTimeUnixNano").alias("end_ns"),
        (_ns("x.endTimeUnixNano") - _ns("x.startTimeUnixNano")).alias("duration_ns"), _enum(F.col("x.status.code"), STATUS, "STATUS_CODE").alias("status_code"), F.coalesce("x.status.message", F.lit("")).alias("status_message"), F.expr(attributes("x.attributes")).alias("attributes"), events.alias("events"), "resource")


#: A metric's field by type.
TYPES = {"gauge": "Gauge", "sum": "Sum", "histogram": "Histogram", "exponentialHistogram": "ExponentialHistogram", "summary": "Summary"}


def _points_of(m: Column) -> Column:
    def of_type(k: str):
        head = [F.lit(TYPES[k]).alias("type"), m[k]["aggregationTemporality"].alias("t"), m[k]["isMonotonic"].alias("m"), m["name"].alias("name"), m["description"].alias("description"), m["unit"].alias("unit")]
        return F.coalesce(F.transform(m[k]["dataPoints"], lambda p: F.struct(*head, p.alias("p"))), F.array())

    return F.concat(*[of_type(k) for k in TYPES])


def points(requests: DataFrame) -> DataFrame:
    """One row per data point, in the layout of raw points."""
    e = _records(requests, "resourceMetrics", "scopeMetrics", "metrics", _points_of).withColumnRenamed("x", "e")
    number = F.coalesce(F.col("e.p.asInt").try_cast("double"), F.col("e.p.asDouble").try_cast("double"), F.lit(0.0))
    plain = F.col("e.type").isin("Gauge", "Sum")
    d = lambda c: F.when(~plain, F.col(f"e.p.{c}").try_cast("double")).alias(c)
    return e.select("arrival_seq", "batch_seq", "received_at", service_of(F.col("resource")).alias("service_name"), F.coalesce("e.name", F.lit("")).alias("metric_name"), F.coalesce("e.description", F.lit("")).alias("description"), F.coalesce("e.unit", F.lit("")).alias("unit"),
        F.col("e.type").alias("metric_type"), _enum(F.col("e.t"), TEMPORALITY, "AGGREGATION_TEMPORALITY").alias("temporality"), F.coalesce("e.m", F.lit(False)).alias("is_monotonic"), _ns("e.p.timeUnixNano").alias("ts_ns"), F.when(plain, number).alias("value"), d("count"), d("sum"), d("min"), d("max"),
        F.expr(attributes("e.p.attributes")).alias("attributes"), "resource")


def logs(requests: DataFrame) -> DataFrame:
    """The body of any kind as text."""
    r = _records(requests, "resourceLogs", "scopeLogs", "logRecords")
    return r.select("arrival_seq", "batch_seq", "received_at", _ns("x.timeUnixNano").alias("ts_ns"), _ns("x.observedTimeUnixNano").alias("observed_ts_ns"), F.lower(F.coalesce("x.traceId", F.lit(""))).alias("trace_id"), F.lower(F.coalesce("x.spanId", F.lit(""))).alias("span_id"),
        F.coalesce(F.col("x.severityNumber").try_cast("int"), F.lit(0)).alias("severity_number"), F.coalesce("x.severityText", F.lit("")).alias("severity_text"), F.coalesce(text_of(F.expr(any_value("x.body"))), F.lit("")).alias("body"), service_of(F.col("resource")).alias("service_name"), F.expr(attributes("x.attributes")).alias("attributes"), "resource")
