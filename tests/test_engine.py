"""The front door on the reference seed: two traces, a gauge, two logs."""

import json
import urllib.request
from datetime import datetime
from threading import Thread

import pytest
from helpers import LOG, MS, POINT, SPAN, frame, span

from teleloom.config import Config
from teleloom.engine import Engine
from teleloom.operators import correlate, metrics, traces
from teleloom.plans import graphql
from teleloom.server import make_server
from teleloom.sources import canonical

T1, T2 = "01".ljust(32, "0"), "02".ljust(32, "0")
BASE = 1775908800000  # 2026-04-11T12:00:00Z in ms


class Seed:
    def __init__(self, spark):
        self.spark, self.rows = spark, None
        self.clear()
        self.rows = {
            "spans": [span(T1, "0a", "", BASE, BASE + 5, name="root-1", status_code="Ok", service_name="svc-a"), span(T2, "0b", "", BASE, BASE + 10, name="root-2", status_code="Ok", service_name="svc-a", attributes={"k": '"v"', "n": "1"}, events=[{"name": "e", "ts_ns": 5, "attributes": {"x": "true"}}]),
                      span(T2, "0c", "0b", BASE + 1, BASE + 4, name="db", status_code="Error", status_message="db down", service_name="svc-a")],
            "points": [{"service_name": "svc-a", "metric_name": "cpu.usage", "unit": "1", "metric_type": "Gauge", "value": v, "ts_ns": BASE * MS + i, "received_at": datetime(2026, 4, 11, 12)} for i, v in enumerate((0.5, 1.5, 2.5))],
            "logs": [{"ts_ns": BASE * MS, "trace_id": T2, "body": "db timeout", "severity_text": "ERROR", "severity_number": 17, "service_name": "svc-a"}, {"ts_ns": BASE * MS, "trace_id": "ff", "body": "dangling"}, {"body": "unrelated"}],
        }

    def clear(self):
        self.rows = {"spans": [], "points": [], "logs": []}

    def spans(self):
        return traces.dedup_spans(canonical.spans(frame(self.spark, SPAN, self.rows["spans"])))

    def _raw(self):
        return canonical.raw_points(frame(self.spark, POINT, self.rows["points"]))

    def points(self):
        return metrics.metric_points(self._raw())

    def metrics(self):
        return metrics.merge(self._raw(), self.points())

    def logs(self):
        return canonical.logs(frame(self.spark, LOG, self.rows["logs"]))


@pytest.fixture()
def engine(spark):
    return Engine(spark, Seed(spark), Config(trace_cap=10), started=0.0)


def data(engine, q, **kw):
    out = engine.execute(q, **kw)
    assert "errors" not in out, out
    return out["data"]


def test_config_and_status(engine):
    assert data(engine, "{ config { traceCap traceCount metricCount logCount maxDataPoints } }")["config"] == {"traceCap": 10, "traceCount": 2, "metricCount": 1, "logCount": 3, "maxDataPoints": 1000}
    s = data(engine, "{ status { version startedAt debug otlpGrpcAddr config { logCount } } }")["status"]
    assert s["startedAt"] == "1970-01-01T00:00:00Z" and s["debug"] is False and s["config"] == {"logCount": 3}


def test_traces_with_nested_edges(engine):
    t = data(engine, "query Q($n: Int = 10) { traces(limit: $n) { total limit items { traceId hasError spanCount durationMs startTime rootSpan { name attributes events { name attributes } } spans { name parent { name } trace { traceId } } logs { body } } } }")["traces"]
    assert t["total"] == 2 and t["limit"] == 10
    new, old = t["items"]
    assert (new["traceId"], new["hasError"], new["durationMs"], new["startTime"]) == (T2, True, 10.0, "2026-04-11T12:00:00Z") and old["hasError"] is False
    assert new["rootSpan"] == {"name": "root-2", "attributes": {"k": "v", "n": 1}, "events": [{"name": "e", "attributes": {"x": True}}]}
    assert new["spans"] == [{"name": "root-2", "parent": None, "trace": {"traceId": T2}}, {"name": "db", "parent": {"name": "root-2"}, "trace": {"traceId": T2}}] and new["logs"] == [{"body": "db timeout"}] and old["logs"] == []


def test_point_lookup(engine):
    assert data(engine, f'{{ trace(traceId: "{T2.upper()}") {{ logs {{ body }} }} }}') == {"trace": {"logs": [{"body": "db timeout"}]}}
    assert data(engine, '{ trace(traceId: "deadbeef") { traceId } }') == {"trace": None}


def test_logs(engine):
    got = data(engine, f'query A {{ logs(traceId: "{T2}") {{ total items {{ body trace {{ traceId }} span {{ name }} }} }} }} query B {{ config {{ logCap }} }}', operation_name="A")["logs"]
    assert got == {"total": 1, "items": [{"body": "db timeout", "trace": {"traceId": T2}, "span": None}]}
    assert [x["trace"] for x in data(engine, "{ logs(limit: 0) { items { trace { traceId } } } }")["logs"]["items"]] == [None, None, {"traceId": T2}]


def test_metrics(engine):
    m = data(engine, "{ metrics { items { ...M dataPoints { value count } } } } fragment M on Metric { name pointCount receivedAt __typename }")["metrics"]["items"]
    assert m == [{"name": "cpu.usage", "pointCount": 3, "receivedAt": "2026-04-11T12:00:00Z", "__typename": "Metric", "dataPoints": [{"value": v, "count": None} for v in (0.5, 1.5, 2.5)]}]


def test_aliases_directives_paging(engine):
    got = data(engine, "query ($no: Boolean = false) { a: traces(limit: 1) { items { traceId } offset } b: traces(offset: 1, limit: -1) { items { id: traceId ... on Trace @include(if: $no) { hasError } } } }")
    assert got == {"a": {"items": [{"traceId": T2}], "offset": 0}, "b": {"items": [{"id": T1}]}}


def test_clear(engine):
    assert data(engine, "mutation { clearSignals }") == {"clearSignals": True}
    assert data(engine, "{ config { traceCount metricCount logCount } }")["config"] == {"traceCount": 0, "metricCount": 0, "logCount": 0}


@pytest.mark.parametrize("q", ["{ nonexistentField }", "{ traces }", "{ config { traceCap { x } } }", "{", "{ traces(limit: \"x\") { total } }", "{ trace { traceId } }", "{ ...F } fragment F on Query { ...F }", "query A { config { logCap } } query B { config { logCap } }", "{ traces(first: 1) { total } }", "", "{ a: config { logCap } a: status { debug } }", "{ config { logCap } } }", "{ config @x { logCap } }"])
def test_errors(engine, q):
    out = engine.execute(q)
    assert out["errors"][0]["message"]
    assert engine.tool_query(q)[1] is True


def test_introspection(engine):
    s = data(engine, "{ __schema { queryType { name } types { name fields { name } } } __type(name: \"Trace\") { kind } }")
    assert s["__schema"]["queryType"] == {"name": "Query"} and {t["name"] for t in s["__schema"]["types"]} >= set(graphql.SCHEMA) and s["__type"] == {"kind": "OBJECT"}
    assert engine.tool_query("{ __typename }") == ('{"data": {"__typename": "Query"}}', False)


def test_capacities(spark):
    e = Engine(spark, Seed(spark), Config(trace_cap=1, log_cap=2, max_data_points=2), bounded=True)
    assert e.config()["traceCount"] == 1 and e.config()["logCount"] == 2 and e.all_points().count() == 2
    assert [r["trace_id"] for r in e.all_traces().collect()] == [T2]
    assert {r["metric_name"]: r["value"] for r in e.self_metrics().collect()} == {"store.traces": 1.0, "store.metrics": 1.0, "store.logs": 2.0}


def test_correlation(spark):
    s = Seed(spark)
    t = traces.rollup(s.spans())
    assert {r["trace_id"]: r["log_count"] for r in correlate.trace_log_counts(t, s.logs()).collect()} == {T1: 0, T2: 1}
    assert [r["body"] for r in correlate.trace_logs(t, s.logs()).collect()] == ["db timeout"]
    assert sorted((r["arrival_seq"], r["trace_service"]) for r in correlate.log_trace(s.logs(), t).collect()) == [(1, "svc-a"), (2, None), (3, None)]
    assert correlate.by_trace(s.logs(), "").count() == 3 and correlate.by_trace(s.logs(), T2).count() == 1


def test_http(engine, tmp_path):
    srv = make_server(("127.0.0.1", 0), str(tmp_path), engine)
    Thread(target=srv.serve_forever, daemon=True).start()

    def post(path, body):
        r = urllib.request.Request(f"http://127.0.0.1:{srv.server_address[1]}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(r) as f:
                return f.status, json.loads(f.read()), f.headers["Access-Control-Allow-Origin"]
        except urllib.error.HTTPError as e:
            return e.code, None, None

    assert post("/graphql", {"query": "{ config { traceCap } }"}) == (200, {"data": {"config": {"traceCap": 10, }}}, "*")
    assert post("/v1/logs", {"resourceLogs": []})[0] == 200 and post("/v1/logs", {"x": 1})[0] == 400 and post("/none", {})[0] == 404
    assert [json.loads(p.read_text()) for p in tmp_path.glob("*.json")] == [{"resourceLogs": []}]
    srv.shutdown()
