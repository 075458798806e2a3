"""The engine: signals, their operators and the query front door in one place.

A root field is one plan; a nested edge is one more plan for all rows of its level, joined by keys, never a query
per row.
"""

from __future__ import annotations

import json
import math
import time
from collections import defaultdict
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom import __version__
from teleloom.config import Config
from teleloom.operators import metrics, retention, traces
from teleloom.plans import graphql
from teleloom.plans.graphql import QueryError, Selection
from teleloom.sources import canonical

TRACE = ["trace_id", "service_name", "span_count", "start_ns", "duration_ns", "has_error", "first_seq", "root.span_id as root_span_id"]


class Engine:
    """Signals held by any object with ``spans()`` (deduplicated), ``points()``, ``metrics()`` and ``logs()``: a ``SignalStore`` or ``Tables``.

    With ``bounded`` the configured capacities apply (traces, metrics, logs and points of a metric).
    """

    def __init__(self, spark: SparkSession, source, config: Config | None = None, bounded: bool = False, started: float | None = None):
        self.spark, self.source, self.cfg, self.bounded = spark, source, (config or Config()).check(), bounded
        self.started = time.time() if started is None else started
        self.streams: list = []

    # signals

    def all_spans(self) -> DataFrame:
        s = self.source.spans()
        return retention.fifo(s, ["trace_id"], self.cfg.trace_cap) if self.bounded else s

    def all_traces(self) -> DataFrame:
        return traces.rollup(self.all_spans())

    def all_metrics(self) -> DataFrame:
        m = self.source.metrics()
        return retention.fifo(m, metrics.METRIC, self.cfg.metric_cap, "first_seq") if self.bounded else m

    def all_points(self) -> DataFrame:
        p = self.source.points()
        return metrics.last_points(p, self.cfg.points) if self.bounded else p

    def all_logs(self) -> DataFrame:
        logs = self.source.logs()
        return retention.page(logs, self.cfg.log_cap) if self.bounded else logs

    # pages

    def traces(self, limit: int = 50, offset: int = 0) -> retention.Page:
        return retention.connection(self.all_traces(), limit, offset, "first_seq")

    def trace(self, trace_id: str) -> DataFrame:
        return traces.by_id(self.all_traces(), trace_id)

    def metrics(self, limit: int = 50, offset: int = 0) -> retention.Page:
        return retention.connection(self.all_metrics(), limit, offset, "first_seq")

    def logs(self, limit: int = 50, offset: int = 0, trace_id: str | None = None) -> retention.Page:
        rows = self.all_logs()
        return retention.connection(rows.filter(F.col("trace_id") == trace_id.lower()) if trace_id else rows, limit, offset)

    def config(self) -> dict:
        n = retention.signal_counts(self.all_traces(), self.all_metrics(), self.all_logs()).first()
        return {"traceCap": self.cfg.trace_cap, "metricCap": self.cfg.metric_cap, "logCap": self.cfg.log_cap, "maxDataPoints": self.cfg.points, "traceCount": n[0], "metricCount": n[1], "logCount": n[2]}

    def status(self, now: float | None = None) -> dict:
        now = time.time() if now is None else now
        c = self.cfg
        return {"version": __version__, "startedAt": _time(int(self.started * 1e9)), "uptimeMs": (now - self.started) * 1000, "httpAddr": c.http, "otlpGrpcAddr": c.otlp_grpc, "otlpHttpAddr": c.otlp_http, "proxyUrl": c.proxy.url, "proxyProtocol": c.proxy.protocol, "debug": c.debug}

    def self_metrics(self) -> DataFrame:
        """Gauges of the engine itself, in the layout (metric_name, value)."""
        n = retention.signal_counts(self.all_traces(), self.all_metrics(), self.all_logs())
        return n.select(F.explode(F.map_from_arrays(F.array(F.lit("store.traces"), F.lit("store.metrics"), F.lit("store.logs")), F.array("trace_count", "metric_count", "log_count"))).alias("metric_name", "value")).select("metric_name", F.col("value").cast("double").alias("value"))

    def clear_signals(self) -> bool:
        self.source.clear()
        return True

    def start_streams(self, *queries) -> None:
        self.streams += queries

    def stop(self) -> None:
        for q in self.streams:
            q.stop()
        self.streams.clear()

    # front door

    def execute(self, query: str, variables: dict | None = None, operation_name: str | None = None) -> dict:
        """{"data": ...} or {"errors": [{"message": ...}]}."""
        try:
            kind, selections = graphql.compile_query(query, variables, operation_name)
            data = {}
            for s in selections:
                data[s.alias] = self._root(kind, s)
            return {"data": data}
        except (QueryError, RecursionError) as e:
            return {"errors": [{"message": str(e)}]}
        except Exception as e:  # a failed plan is an error of the answer
            return {"data": None, "errors": [{"message": f"{type(e).__name__}: {str(e)[:500]}"}]}

    def tool_query(self, query: str, variables: dict | None = None, operation_name: str | None = None) -> tuple[str, bool]:
        """The same as a tool: (JSON text, is_error)."""
        out = self.execute(query, variables, operation_name)
        return json.dumps(out), bool(out.get("errors"))

    def _root(self, kind: str, s: Selection):
        if s.name == "__typename":
            return s.args["type"]
        if s.name in ("__schema", "__type"):
            return graphql.introspect(s)
        if kind == "mutation":
            return self.clear_signals()
        read = _Reader(self)
        if s.name == "config":
            return _pick(self.config(), s.fields, "Config")
        if s.name == "status":
            out = self.status()
            if any(f.name == "config" for f in s.fields):
                out["config"] = self.config()
            return {f.alias: (_pick(out["config"], f.fields, "Config") if f.name == "config" else f.args["type"] if f.name == "__typename" else out[f.name]) for f in s.fields}
        if s.name == "trace":
            rows = read.traces(read.all_traces.filter(F.col("trace_id") == s.args["traceId"].lower()), s.fields)
            return rows[0] if rows else None
        item = next((f for f in s.fields if f.name == "items"), None)
        rows, one, order = {"traces": (read.all_traces, read.traces, "first_seq"), "metrics": (read.all_metrics, read.metrics, "first_seq"), "logs": (read.all_logs, read.logs, "arrival_seq")}[s.name]
        if s.name == "logs" and s.args["traceId"]:
            rows = rows.filter(F.col("trace_id") == s.args["traceId"].lower())
        out = {}
        for f in s.fields:
            if f.name == "items":
                out[f.alias] = one(retention.page(rows, s.args["limit"], s.args["offset"], order), item.fields if f is item else f.fields)
            else:
                out[f.alias] = rows.count() if f.name == "total" else f.args["type"] if f.name == "__typename" else s.args[f.name]
        return out


class Tables:
    """Signals read from a folder of tables spans, logs and metric_points."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spans(self) -> DataFrame:
        return traces.dedup_spans(canonical.spans(self._read("spans")))

    def points(self) -> DataFrame:
        return metrics.metric_points(canonical.raw_points(self._read("metric_points")))

    def metrics(self) -> DataFrame:
        raw = canonical.raw_points(self._read("metric_points"))
        return metrics.merge(raw, metrics.metric_points(raw, carry=metrics.HEAD))

    def logs(self) -> DataFrame:
        return canonical.logs(self._read("logs"))

    def clear(self) -> None:
        raise QueryError("these tables are read-only")


def _time(ns: int | None) -> str | None:
    """RFC 3339 with as many digits of the second as are needed."""
    ns = ns or 0
    s = datetime.fromtimestamp(ns // 10**9, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    frac = f"{ns % 10**9:09d}".rstrip("0")
    return f"{s}.{frac}Z" if frac else f"{s}Z"


def _json_map(m: dict | None) -> dict:
    out = {}
    for k, v in sorted((m or {}).items()):
        try:
            out[k] = json.loads(v) if v is not None else None
        except ValueError:
            out[k] = v
    return out


def _number(x):
    return None if x is None or isinstance(x, float) and not math.isfinite(x) else x


def _pick(row: dict, fields: list[Selection], kind: str) -> dict:
    return {f.alias: (kind if f.name == "__typename" else row[f.name]) for f in fields}


#: The columns a field of a span is made of, beside its keys.
_SPAN_COLUMNS = {"name": ["name"], "kind": ["kind"], "serviceName": ["service_name"], "statusCode": ["status_code"], "statusMessage": ["status_message"], "events": ["events"], "attributes": ["attributes"], "resource": ["resource"],
                 "startTime": ["start_ns"], "endTime": ["start_ns", "end_ns"], "durationMs": ["duration_ns"]}


def _span_columns(fields: list[Selection]) -> list[str]:
    """P10: the columns that the asked fields of spans need; the plan reads no others."""
    return list(dict.fromkeys(["trace_id", "span_id", "parent_span_id", "arrival_seq", *[c for f in fields for c in _SPAN_COLUMNS.get(f.name, [])]]))


class _Reader:
    """Runs the plans of one root field. Rows that reach the driver are those of the page that was asked for."""

    def __init__(self, engine: Engine):
        self.e = engine

    @cached_property
    def all_spans(self) -> DataFrame:
        return self.e.all_spans()

    @cached_property
    def all_traces(self) -> DataFrame:
        return traces.rollup(self.all_spans)

    @cached_property
    def all_metrics(self) -> DataFrame:
        return self.e.all_metrics()

    @cached_property
    def all_logs(self) -> DataFrame:
        return self.e.all_logs()

    def _of(self, df: DataFrame, column: str, keys: set) -> DataFrame:
        """Rows whose key is one of a page's; the page's keys are a small table."""
        k = self.e.spark.createDataFrame([(x,) for x in sorted(keys)], f"{column} string")
        return df.join(F.broadcast(k), column, "left_semi") if len(keys) <= 100_000 else df.join(k, column, "left_semi")

    def traces(self, df: DataFrame, fields: list[Selection]) -> list[dict]:
        rows = [r.asDict() for r in df.selectExpr(*TRACE).collect()]
        return self._traces(rows, fields)

    def _traces(self, rows: list[dict], fields: list[Selection]) -> list[dict]:
        ids = {r["trace_id"] for r in rows}
        spans: dict[str, list[dict]] = defaultdict(list)
        logs: dict[str, list] = defaultdict(list)
        edges = [f for f in fields if f.name in ("spans", "rootSpan")]
        if edges and ids:
            found = self.all_spans.select(*_span_columns([g for f in edges for g in f.fields]))
            if any(f.name == "spans" for f in edges):
                found = self._of(found, "trace_id", ids)
            else:  # the roots are known: one span a trace
                roots = self.e.spark.createDataFrame(sorted((r["trace_id"], r["root_span_id"]) for r in rows if r["root_span_id"] is not None), "trace_id string, span_id string")
                found = found.filter("parent_span_id = ''").join(F.broadcast(roots), ["trace_id", "span_id"], "left_semi")
            for r in found.orderBy("arrival_seq").collect():
                spans[r["trace_id"]].append(r.asDict(recursive=True))
        made: dict[str, dict[str, list[dict]]] = {}
        for f in edges:
            flat = [s for r in rows for s in (spans[r["trace_id"]] if f.name == "spans" else [x for x in spans[r["trace_id"]] if x["span_id"] == r["root_span_id"] and x["parent_span_id"] == ""][:1])]
            by: dict[str, list[dict]] = defaultdict(list)
            for s, out in zip(flat, self._spans(flat, f.fields, {r["trace_id"]: r for r in rows})):
                by[s["trace_id"]].append(out)
            made[f.alias] = by
        for f in fields:
            if f.name == "logs" and ids:
                found = self._of(self.all_logs, "trace_id", ids - {""}).orderBy(F.desc("arrival_seq")).collect() if ids - {""} else []
                flat = [r.asDict() for r in found]
                by = defaultdict(list)
                for x, out in zip(flat, self._logs(flat, f.fields)):
                    by[x["trace_id"]].append(out)
                logs[f.alias] = by
        plain = {"traceId": lambda r: r["trace_id"], "serviceName": lambda r: r["service_name"], "spanCount": lambda r: r["span_count"], "startTime": lambda r: _time(r["start_ns"]), "durationMs": lambda r: (r["duration_ns"] or 0) / 1e6, "hasError": lambda r: r["has_error"], "__typename": lambda r: "Trace"}
        return [{f.alias: made[f.alias][r["trace_id"]] if f.name == "spans" else next(iter(made[f.alias][r["trace_id"]]), None) if f.name == "rootSpan" else logs[f.alias][r["trace_id"]] if f.name == "logs" else plain[f.name](r) for f in fields} for r in rows]

    def _spans(self, rows: list[dict], fields: list[Selection], known: dict[str, dict] | None = None) -> list[dict]:
        ids = {r["trace_id"] for r in rows}
        extra: dict[str, dict] = {}
        for f in fields:
            if f.name == "trace":
                have = [r.asDict() for r in self._of(self.all_traces, "trace_id", ids).selectExpr(*TRACE).collect()] if ids else []
                extra[f.alias] = dict(zip((r["trace_id"] for r in have), self._traces(have, f.fields)))
            elif f.name == "parent":
                want = {(r["trace_id"], r["parent_span_id"]) for r in rows if r["parent_span_id"]}
                k = self.e.spark.createDataFrame(sorted(want), "trace_id string, span_id string")
                have = [r.asDict(recursive=True) for r in self.all_spans.select(*_span_columns(f.fields)).join(k, ["trace_id", "span_id"], "left_semi").collect()] if want else []
                extra[f.alias] = dict(zip(((r["trace_id"], r["span_id"]) for r in have), self._spans(have, f.fields)))
        plain = {"traceId": "trace_id", "spanId": "span_id", "parentSpanId": "parent_span_id", "name": "name", "kind": "kind", "serviceName": "service_name", "statusCode": "status_code", "statusMessage": "status_message"}

        def one(r: dict, f: Selection):
            if f.name in plain:
                return r[plain[f.name]]
            if f.name == "trace":
                return extra[f.alias].get(r["trace_id"])
            if f.name == "parent":
                return extra[f.alias].get((r["trace_id"], r["parent_span_id"])) if r["parent_span_id"] else None
            if f.name == "events":
                made = [{"name": e["name"] or "", "timestamp": _time(e["ts_ns"]), "attributes": _json_map(e["attributes"])} for e in r["events"] or []]
                return [_pick(e, f.fields, "SpanEvent") for e in made]
            if f.name in ("attributes", "resource"):
                return _json_map(r[f.name])
            return {"startTime": lambda: _time(r["start_ns"]), "endTime": lambda: _time(r["end_ns"] if r["end_ns"] is not None else r["start_ns"]), "durationMs": lambda: (r["duration_ns"] or 0) / 1e6, "__typename": lambda: "Span"}[f.name]()

        return [{f.alias: one(r, f) for f in fields} for r in rows]

    def metrics(self, df: DataFrame, fields: list[Selection]) -> list[dict]:
        rows = [r.asDict(recursive=True) for r in df.collect()]
        points: dict[tuple, list[dict]] = defaultdict(list)
        if any(f.name in ("dataPoints", "pointCount") for f in fields) and rows:
            keys = self.e.spark.createDataFrame([(r["service_name"], r["metric_name"]) for r in rows], "service_name string, metric_name string")
            wanted = self.e.all_points().join(keys, metrics.METRIC, "left_semi")
            if any(f.name == "dataPoints" for f in fields):
                for p in wanted.orderBy("arrival_seq").collect():
                    points[p["service_name"], p["metric_name"]].append(p.asDict(recursive=True))
                counts = {k: len(v) for k, v in points.items()}
            else:
                counts = {(p[0], p[1]): p[2] for p in wanted.groupBy(*metrics.METRIC).count().collect()}
        plain = {"name": "metric_name", "description": "description", "unit": "unit", "type": "metric_type", "serviceName": "service_name"}

        def point(p: dict) -> dict:
            return {"timestamp": _time(p["ts_ns"]), "value": _number(p["value"]) or 0.0, "count": p["count"], "sum": _number(p["sum"]), "min": _number(p["min"]), "max": _number(p["max"]), "attributes": _json_map(p["attributes"])}

        def one(r: dict, f: Selection):
            key = r["service_name"], r["metric_name"]
            if f.name in plain:
                return r[plain[f.name]]
            if f.name == "dataPoints":
                return [_pick(point(p), f.fields, "DataPoint") for p in points[key]]
            return {"pointCount": lambda: counts.get(key, 0), "resource": lambda: _json_map(r["resource"]), "receivedAt": lambda: _time(int(r["received_at"].replace(tzinfo=timezone.utc).timestamp() * 10**6) * 1000 if r["received_at"] else 0), "__typename": lambda: "Metric"}[f.name]()

        return [{f.alias: one(r, f) for f in fields} for r in rows]

    def logs(self, df: DataFrame, fields: list[Selection]) -> list[dict]:
        asked = {f.name for f in fields}
        unused = [c for c in ("attributes", "resource", "body") if c not in asked]
        return self._logs([r.asDict(recursive=True) for r in df.drop(*unused).collect()], fields)

    def _logs(self, rows: list[dict], fields: list[Selection]) -> list[dict]:
        ids = {r["trace_id"] for r in rows} - {""}
        extra: dict[str, dict] = {}
        for f in fields:
            if f.name == "trace":
                have = [r.asDict() for r in self._of(self.all_traces, "trace_id", ids).selectExpr(*TRACE).collect()] if ids else []
                extra[f.alias] = dict(zip((r["trace_id"] for r in have), self._traces(have, f.fields)))
            elif f.name == "span":
                want = {(r["trace_id"], r["span_id"]) for r in rows if r["trace_id"] and r["span_id"]}
                k = self.e.spark.createDataFrame(sorted(want), "trace_id string, span_id string")
                have = [r.asDict(recursive=True) for r in self.all_spans.select(*_span_columns(f.fields)).join(k, ["trace_id", "span_id"], "left_semi").collect()] if want else []
                extra[f.alias] = dict(zip(((r["trace_id"], r["span_id"]) for r in have), self._spans(have, f.fields)))
        plain = {"traceId": "trace_id", "spanId": "span_id", "severityNumber": "severity_number", "severityText": "severity_text", "body": "body", "serviceName": "service_name"}

        def one(r: dict, f: Selection):
            if f.name in plain:
                return r[plain[f.name]]
            if f.name in ("attributes", "resource"):
                return _json_map(r[f.name])
            if f.name == "trace":
                return extra[f.alias].get(r["trace_id"]) if r["trace_id"] else None
            if f.name == "span":
                return extra[f.alias].get((r["trace_id"], r["span_id"])) if r["trace_id"] and r["span_id"] else None
            return {"timestamp": lambda: _time(r["ts_ns"]), "observedTimestamp": lambda: _time(r["observed_ts_ns"]), "__typename": lambda: "Log"}[f.name]()

        return [{f.alias: one(r, f) for f in fields} for r in rows]
