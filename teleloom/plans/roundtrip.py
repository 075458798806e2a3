"""The telemetry tables sent through the streaming ingest as export requests, and read back: whole tables, equal to the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.plans import queries_sql
from teleloom.plans.storage import Workspace, _filesystem
from teleloom.sources import canonical, otlp
from teleloom.sources.tables import table
from teleloom.streaming.ingest import Ingest, SignalStore, start


def any_value(json: Column) -> Column:
    """A JSON scalar as a typed value."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")
    return F.struct(F.when(json.startswith('"'), text).alias("stringValue"), F.when(json.isin("true", "false"), json == "true").alias("boolValue"), F.when(json.rlike(r"^-?\d+$"), json).alias("intValue"), F.when(json.rlike(r"^-?\d+[.eE]"), json).alias("doubleValue"))


def attributes(c: Column) -> Column:
    return F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("key"), any_value(e["value"]).alias("value")))


def _code(c: str, names: list[str]) -> Column:
    return F.array_position(F.lit(names), F.coalesce(c, F.lit(names[0]))) - 1


def span_requests(spans: DataFrame) -> DataFrame:
    """(at, value): an export request for each batch_seq, its spans in order of arrival."""
    events = F.transform("events", lambda e: F.struct(e["name"].alias("name"), e["ts_ns"].cast("string").alias("timeUnixNano"), attributes(e["attributes"]).alias("attributes")))
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", _code("kind", otlp.KINDS).alias("kind"), F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"),
        attributes(F.col("attributes")).alias("attributes"), events.alias("events"), F.struct(_code("status_code", otlp.STATUS).alias("code"), F.col("status_message").alias("message")).alias("status"))
    return _requests(spans, F.col("batch_seq"), span, "resourceSpans", "scopeSpans", "spans")


def point_requests(points: DataFrame) -> DataFrame:
    sums = F.col("metric_type") == "Sum"
    point = F.struct(F.col("ts_ns").cast("string").alias("timeUnixNano"), F.col("value").cast("string").alias("asDouble"), *[F.col(c).cast("string").alias(c) for c in ("count", "sum", "min", "max")], attributes(F.col("attributes")).alias("attributes"))
    kind = F.struct(F.array(point).alias("dataPoints"), _code("temporality", otlp.TEMPORALITY).alias("aggregationTemporality"), F.when(sums, F.col("is_monotonic")).alias("isMonotonic"))
    metric = F.struct(F.col("metric_name").alias("name"), "description", "unit", *[F.when(F.col("metric_type") == t, kind).alias(k) for k, t in otlp.TYPES.items()])
    return _requests(points, F.col("batch_seq"), metric, "resourceMetrics", "scopeMetrics", "metrics")


def log_requests(logs: DataFrame) -> DataFrame:
    body = F.when(F.col("body").isNotNull(), F.struct(F.col("body").alias("stringValue")))
    log = F.struct(F.col("ts_ns").cast("string").alias("timeUnixNano"), F.col("observed_ts_ns").cast("string").alias("observedTimeUnixNano"), F.col("severity_number").alias("severityNumber"), F.col("severity_text").alias("severityText"), body.alias("body"), attributes(F.col("attributes")).alias("attributes"), F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"))
    return _requests(logs, F.floor(F.col("arrival_seq") / F.lit(100)), log, "resourceLogs", "scopeLogs", "logRecords")


def _requests(rows: DataFrame, at: Column, record: Column, field: str, scopes: str, inner: str) -> DataFrame:
    one = F.struct(F.struct(attributes(F.col("resource")).alias("attributes")).alias("resource"), F.array(F.struct(F.array(record).alias(inner))).alias(scopes))
    items = F.transform(F.array_sort(F.collect_list(F.struct("arrival_seq", one.alias("r")))), lambda x: x["r"])  # an export request is small
    return rows.groupBy(at.alias("at")).agg(items.alias("items")).select("at", F.to_json(F.struct(F.col("items").alias(field))).alias("value"))


def ingested(spark: SparkSession, requests: DataFrame, files: int = 3) -> SignalStore:
    """A store that took in ``requests`` by the stream, dropped into its landing folder as one file after the other, in order."""
    ws = Workspace(spark, "ingest")
    stored = ws.put("all", requests)
    store = SignalStore(spark, ws.path("store"))
    job, landing = Ingest(store), ws.path("landing")
    fs, p = _filesystem(spark, landing)
    fs.mkdirs(p)
    lo, hi = stored.agg(F.min("at"), F.max("at")).first()
    cuts = [] if lo is None else [lo + (hi - lo + 1) * i // files for i in range(files + 1)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = stored.filter((F.col("at") >= a) & (F.col("at") < b)).repartition(1).sortWithinPartitions("at").select("value")  # one file keeps one order
        part.write.text(ws.path(f"file-{i}"))
        name = next((s.getPath() for s in fs.listStatus(_filesystem(spark, ws.path(f"file-{i}"))[1]) if s.getPath().getName().startswith("part-")), None)
        if name is not None:
            fs.rename(name, _filesystem(spark, f"{landing}/{i}.json")[1])
        start(spark, landing, job, ws.path("checkpoint")).awaitTermination()
    return store


def ingest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated spans as ingested. What has no end ends at 0."""
    s = ingested(spark, span_requests(table(spark, sf_dir, "spans"))).spans()
    return s.select("trace_id", "span_id", "parent_span_id", "name", "kind", "service_name", "start_ns", "end_ns", "status_code", "status_message", canonical.attr_key("attributes").alias("attributes"), F.size("events").alias("events"))


def ingest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as shown, deltas taken batch by batch from the state."""
    p = ingested(spark, point_requests(table(spark, sf_dir, "metric_points"))).points()
    return p.select("service_name", "metric_name", "attr_key", "ts_ns", "value", "count", "sum", "min", "max")


def ingest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, T4."""
    logs = ingested(spark, log_requests(table(spark, sf_dir, "logs"))).logs()
    return logs.select("ts_ns", "observed_ts_ns", "trace_id", "span_id", "severity_number", "severity_text", "body", "service_name", canonical.attr_key("attributes").alias("attributes"))


QUERIES = {f.__name__: f for f in (ingest_spans, ingest_points, ingest_logs)}

_SERVICE = "coalesce(json_extract_string('{\"v\":' || resource['service.name'] || '}', '$.v'), '')"

SQL = {
    "ingest_spans": f"""WITH c AS (SELECT *, {queries_sql._id('trace_id')} AS t, {queries_sql._id('span_id')} AS s, {queries_sql._id('parent_span_id')} AS p FROM spans),
d AS (SELECT *, row_number() OVER (PARTITION BY t, s ORDER BY arrival_seq) AS rn FROM c)
SELECT t AS trace_id, s AS span_id, p AS parent_span_id, coalesce(name, '') AS name, coalesce(kind, 'Unspecified') AS kind, {_SERVICE} AS service_name, coalesce(start_ns, 0) AS start_ns, coalesce(end_ns, 0) AS end_ns,
  coalesce(status_code, 'Unset') AS status_code, coalesce(status_message, '') AS status_message, {queries_sql._KEY} AS attributes, coalesce(len(events), 0) AS events FROM d WHERE rn = 1 OR s = ''""",
    "ingest_points": f"WITH {queries_sql._P} SELECT {queries_sql._SK}, ts_ns, value, n AS count, s AS sum, lo AS min, hi AS max FROM pts",
    "ingest_logs": f"""SELECT coalesce(ts_ns, 0) AS ts_ns, coalesce(observed_ts_ns, 0) AS observed_ts_ns, {queries_sql._id('trace_id')} AS trace_id, {queries_sql._id('span_id')} AS span_id, coalesce(severity_number, 0) AS severity_number,
  coalesce(severity_text, '') AS severity_text, coalesce(body, '') AS body, {_SERVICE} AS service_name, {queries_sql._KEY} AS attributes FROM logs""",
}
