import json

from helpers import rows
from pyspark.sql import functions as F

from teleloom.sources import canonical, otlp
from teleloom.streaming import ingest


def attrs(**kw):
    return [{"key": k.replace("_", "."), "value": v} for k, v in kw.items()]


def trace_request(*spans, service="svc-a"):
    return {"resourceSpans": [{"resource": {"attributes": attrs(service_name={"stringValue": service}, pid={"intValue": "42"})}, "scopeSpans": [{"scope": {"name": "dropped"}, "spans": list(spans)}]}]}


def sum_request(value, name="c"):
    return {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": name, "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [{"timeUnixNano": "1", "asInt": str(value)}]}}]}]}]}


def log_request(body, trace=""):
    return {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "5", "body": body, "traceId": trace, "severityNumber": 17}]}]}]}


def write(path, *requests):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in requests))


def test_values(spark, tmp_path):
    v = [{"stringValue": 'a"b'}, {"intValue": "7"}, {"intValue": 8}, {"doubleValue": 1.5}, {"doubleValue": "NaN"}, {"doubleValue": "Infinity"}, {"doubleValue": "-Infinity"}, {"boolValue": True}, {"bytesValue": "AQI="}, {}, {"arrayValue": {}}, {"arrayValue": {"values": [{"intValue": "1"}, {"kvlistValue": {"values": attrs(k={"stringValue": "v"})}}]}}, {"kvlistValue": {"values": attrs(z={"boolValue": False}, a={})}}]
    write(tmp_path / "a.json", trace_request({"traceId": "AB", "spanId": "C", "attributes": [{"key": f"k{i:02}", "value": x} for i, x in enumerate(v)]}))
    got = otlp.spans(otlp.read_requests(spark, str(tmp_path))).first()
    assert [got["attributes"][k] for k in sorted(got["attributes"])] == ['"a\\"b"', "7", "8", "1.5", '"NaN"', '"+Inf"', '"-Inf"', "true", '"AQI="', '""', "[]", '[1,{"k":"v"}]', '{"a":"","z":false}']
    assert got["service_name"] == "svc-a" and got["resource"]["pid"] == "42" and got["trace_id"] == "ab"


def test_missing_and_damaged(spark, tmp_path):
    write(tmp_path / "a.json", "{bad", {}, {"resourceSpans": None}, {"resourceSpans": [{}]}, {"resourceSpans": [{"scopeSpans": [{"spans": [{}, {"kind": "SPAN_KIND_CLIENT", "status": {"code": "STATUS_CODE_ERROR"}, "startTimeUnixNano": "9", "endTimeUnixNano": "4"}]}]}]}, {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "none"}, {"name": "g", "gauge": {"dataPoints": [{}]}}]}]}]})
    r = otlp.read_requests(spark, str(tmp_path))
    assert rows(otlp.spans(r), "kind", "status_code", "duration_ns", "service_name") == [("Client", "Error", -5, ""), ("Unspecified", "Unset", 0, "")]
    assert rows(otlp.points(r), "metric_name", "value") == [("g", 0.0)]
    assert otlp.logs(r).count() == 0


def test_order_within_a_request(spark, tmp_path):
    write(tmp_path / "a.json", trace_request(*[{"spanId": f"{i:x}"} for i in range(20)]), trace_request({"spanId": "last"}))
    s = otlp.spans(otlp.read_requests(spark, str(tmp_path))).orderBy("arrival_seq").collect()
    assert [x["span_id"] for x in s] == [f"{i:x}" for i in range(20)] + ["last"] and s[0]["batch_seq"] < s[-1]["batch_seq"]


def test_stream_equals_batch_and_clears(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    store, told, sent = ingest.SignalStore(spark, f"file://{tmp_path}/store"), [], []
    assert store.traces().count() == 0 and store.metrics().count() == 0 and store.logs().count() == 0
    job = ingest.Ingest(store, [lambda s, df, b: told.append((s, b, df.count()))], [ingest.folder_sink(f"file://{tmp_path}/fwd"), lambda df, b: sent.append(df.count())])
    root = {"traceId": "01" * 16, "spanId": "0a" * 8, "name": "root", "startTimeUnixNano": "0", "endTimeUnixNano": "9"}
    child = root | {"spanId": "0b" * 8, "parentSpanId": "0a" * 8, "name": "child", "endTimeUnixNano": "20"}

    def run(n, *requests):
        write(landing / f"{n}.json", *requests)
        q = ingest.start(spark, str(landing), job, f"file://{tmp_path}/cp")
        assert q.awaitTermination(60)
        assert q.exception() is None

    run(1, trace_request(root), sum_request(100), log_request({"stringValue": "hello"}, "01" * 16), "{broken")
    assert store.metrics().count() == 0
    run(2, trace_request(root, child), sum_request(150))
    t = store.traces().first()
    assert (t["span_count"], t["duration_ns"], t["root"]["name"]) == (2, 20, "root")
    assert rows(store.points(), "value") == [(50.0,)] and rows(store.logs(), "body") == [("hello",)]
    assert told[0][0] == "spans" and (told[0][2], told[1][2]) == (1, 0) and sent == [4, 2] or sent == [3, 2]
    # a batch that is run again changes nothing
    job(spark.read.text(str(landing / "2.json")), 1)
    assert store.traces().first()["span_count"] == 2 and rows(store.points(), "value") == [(50.0,)]
    store.clear()
    assert store.traces().count() == 0
    job(spark.createDataFrame([(json.dumps(sum_request(170)),)], "value string"), 2)
    assert store.points().count() == 0  # the first observation is a baseline again
    assert ingest.progress_points(type("Q", (), {"lastProgress": {"batchId": 3, "numInputRows": 4}})())[2]["value"] == 4.0


def test_stateful_deltas_equal_the_batch_operator(spark, tmp_path):
    from datetime import datetime

    from helpers import POINT, frame

    from teleloom.operators import metrics

    data = [{"service_name": "s", "metric_name": f"m{i % 2}", "metric_type": "Sum", "temporality": "Cumulative", "is_monotonic": True, "value": float(v), "received_at": datetime(2026, 1, 1)} for i, v in enumerate([10, 5, 15, 4, 18, 9, 20, 9])]
    raw = canonical.raw_points(frame(spark, POINT, data))
    schema = raw.schema
    for k in range(2):  # the second run goes on from the state of the first
        raw.filter((F.col("arrival_seq") > 4) == bool(k)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = ingest.delta_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start()
        assert q.awaitTermination(60), q.status
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "arrival_seq", "value") == rows(metrics.number_deltas(raw), "arrival_seq", "value")


def test_deep_values_are_converted_at_any_depth(spark, tmp_path):
    def nest(n, leaf):
        for i in range(n):
            leaf = {"arrayValue": {"values": [leaf]}} if i % 2 else {"kvlistValue": {"values": [{"key": "z", "value": {}}, {"key": 'k"', "value": leaf}, {"value": {"intValue": "1"}}]}}
        return leaf

    def want(n, text):
        for i in range(n):
            text = f"[{text}]" if i % 2 else '{"k\\"":' + text + ',"z":""}'
        return text

    depths = [0, 1, 2, 3, 4, 7, 150]
    write(tmp_path / "a.json", *[trace_request({"spanId": "c", "attributes": attrs(a=nest(n, {"doubleValue": "NaN"})), "events": [{"name": "e", "attributes": attrs(a=nest(n, {"stringValue": "é/"}))}]}) for n in depths], log_request(nest(5, {"boolValue": True})))
    r = otlp.read_requests(spark, str(tmp_path))
    got = otlp.spans(r).orderBy("arrival_seq").collect()
    assert [x["attributes"]["a"] for x in got] == [want(n, '"NaN"') for n in depths]
    assert [x["events"][0]["attributes"]["a"] for x in got] == [want(n, '"é/"') for n in depths]
    assert [x["body"] for x in otlp.logs(r).collect()] == [want(5, "true")]


def test_requests_of_many_splits_get_numbers_of_their_own(spark, tmp_path):
    store = ingest.SignalStore(spark, f"file://{tmp_path}/store")
    job = ingest.Ingest(store)
    lines = lambda a, b: spark.range(a, b, 1, 2).select(F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"severityText":"'), "id", F.lit('"}]}]}]}')).alias("value"))
    job(lines(0, 20_000), 0)
    job(lines(20_000, 20_010).union(spark.createDataFrame([("{broken",), ("",), ("[1]",), ("3",)], "value string")), 1)
    job(lines(20_000, 20_010), 1)  # tried again
    logs = store.logs().select("arrival_seq", F.col("severity_text").cast("bigint").alias("n"))
    assert logs.count() == 20_010 and logs.select("arrival_seq").distinct().count() == 20_010
    assert logs.filter(F.col("arrival_seq") != (F.col("n") + 1) * 2**24).count() == 0  # in order, without gaps
    assert store.rejected().count() == 0
    job(spark.createDataFrame([("{broken",), ("",), ("[1]",), ("{}",)], "value string"), 2)
    assert rows(store.rejected(), "value") == [("[1]",), ("{broken",)]


def hist_request(count, total, name="h"):
    point = {"timeUnixNano": "1", "count": str(count), "sum": total}
    return {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": name, "histogram": {"aggregationTemporality": 2, "dataPoints": [point]}}]}]}]}


def take(spark, job, batch, *requests):
    job(spark.createDataFrame([(json.dumps(r),) for r in requests], "value string").coalesce(1), batch)


def test_delta_state_of_numbers_and_distributions(spark, tmp_path):
    store = ingest.SignalStore(spark, f"file://{tmp_path}/store")
    job = ingest.Ingest(store, series_cap=2)
    take(spark, job, 0, sum_request(10), hist_request(4, 8.0))
    take(spark, job, 1, sum_request(15), sum_request(3), hist_request(6, 9.0))
    assert rows(store.points(), "metric_name", "value", "count", "sum") == [("c", 5.0, None, None), ("h", 0.5, 2.0, 1.0)]
    take(spark, job, 1, sum_request(15), sum_request(3), hist_request(6, 9.0))  # tried again
    take(spark, job, 2, sum_request(4), sum_request(1, "d"))  # three series, room for two: h is forgotten
    take(spark, job, 3, hist_request(9, 10.0), sum_request(9), sum_request(2, "d"))
    assert rows(store.points(), "metric_name", "value") == [("c", 1.0), ("c", 5.0), ("c", 5.0), ("d", 1.0), ("h", 0.5)]
    assert rows(store.metrics(), "metric_name", "metric_type", "point_count") == [("c", "Sum", 3), ("d", "Sum", 1), ("h", "Histogram", 1)]
    store.clear()  # while the job goes on
    take(spark, job, 4, sum_request(50))
    take(spark, job, 5, sum_request(51))
    assert rows(store.points(), "value") == [(1.0,)]


def test_kept_traces_with_readmission(spark, tmp_path):
    store = ingest.SignalStore(spark, f"file://{tmp_path}/store")
    job = ingest.Ingest(store, trace_cap=2)
    one = lambda t, s: trace_request({"traceId": f"{t:032x}", "spanId": f"{s:016x}", "name": f"{t}.{s}"})
    take(spark, job, 0, one(1, 1), one(2, 1))
    take(spark, job, 1, one(1, 2))  # an update keeps its place
    assert rows(store.kept_spans(), "name") == [("1.1",), ("1.2",), ("2.1",)]
    take(spark, job, 2, one(3, 1))
    assert rows(store.kept_spans(), "name") == [("2.1",), ("3.1",)]
    take(spark, job, 3, one(1, 3))  # back again, without what it had
    assert rows(store.kept_spans(), "name") == [("1.3",), ("3.1",)]


def test_forwarding_over_http_and_the_live_feed(spark, tmp_path):
    import threading
    import urllib.request
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from teleloom import server
    from teleloom.engine import Engine
    from teleloom.streaming.state import Hub

    got, fail = [], [1]

    class Upstream(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if fail:
                fail.pop()
                self.send_response(503)
            else:
                got.append((self.path, self.headers["Authorization"], sorted(json.loads(body))))
                self.send_response(200)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *a):
            pass

    up = HTTPServer(("127.0.0.1", 0), Upstream)
    threading.Thread(target=up.serve_forever, daemon=True).start()
    hub, store = Hub(), ingest.SignalStore(spark, f"file://{tmp_path}/store")
    engine = Engine(spark, store)
    web = server.make_server(("127.0.0.1", 0), str(tmp_path / "landing"), engine, hub)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    get = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{web.server_address[1]}{path}").read())
    job = ingest.Ingest(store, [ingest.live(hub)], [ingest.http_sink(f"http://127.0.0.1:{up.server_address[1]}", {"Authorization": "Bearer x"}, wait=0.01)])
    take(spark, job, 0, log_request({"stringValue": "first"}))
    hello = get("/feed")
    assert [x["body"] for x in hello["snapshot"]["logs"]] == ["first"]
    take(spark, job, 1, log_request({"stringValue": "second"}), trace_request({"traceId": "0a" * 16, "spanId": "0b" * 8}))
    messages = get(f"/feed?client={hello['client']}")["messages"]
    assert sorted((m["type"], m["data"].get("body") or m["data"].get("trace_id")) for m in messages) == [("logs", "second"), ("traces", "0a" * 16)]
    assert sorted(p for p, _, _ in got) == ["/v1/logs", "/v1/logs", "/v1/traces"] and {a for _, a, _ in got} == {"Bearer x"}
    path = ingest.report_self(engine, hub, [], f"file://{tmp_path}/landing", 7)
    job(spark.read.text(path), 2)
    assert {r["metric_name"]: r["value"] for r in store.points().collect()} == {"store.traces": 1.0, "store.metrics": 0.0, "store.logs": 2.0, "feed.clients": 1.0}
    web.shutdown()
    up.shutdown()


def field(number, kind, data):
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(data, int):
        return varint(number << 3 | kind) + (varint(data % 2**64) if kind == 0 else struct.pack("<q", data))
    if isinstance(data, float):
        return varint(number << 3 | 1) + struct.pack("<d", data)
    return varint(number << 3 | 2) + varint(len(data)) + data


def test_protobuf_and_compressed_requests():
    import gzip

    import pytest

    from teleloom import server
    from teleloom.sources import protobuf

    text = lambda k, s: field(k, 2, s.encode())
    value = field(5, 2, field(1, 2, field(3, 0, -7)) + field(1, 2, text(1, "x")))
    span = field(1, 2, bytes(range(16))) + field(2, 2, b"\x01" * 8) + text(5, "né") + field(6, 0, 2) + field(7, 1, 5) + field(9, 2, text(1, "k") + field(2, 2, value)) + field(99, 0, 1) + field(15, 2, field(3, 0, 2))
    body = field(1, 2, field(1, 2, field(1, 2, text(1, "service.name") + field(2, 2, text(1, "svc")))) + field(2, 2, field(2, 2, span)))
    want = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"spans": [{"traceId": bytes(range(16)).hex(), "spanId": "01" * 8, "name": "né", "kind": 2, "startTimeUnixNano": "5",
            "attributes": [{"key": "k", "value": {"arrayValue": {"values": [{"intValue": "-7"}, {"stringValue": "x"}]}}}], "status": {"code": 2}}]}]}]}
    assert protobuf.decode(body, "Traces") == want
    assert json.loads(server.request_line("/v1/traces", gzip.compress(body), server.PROTOBUF, "gzip")) == want
    assert json.loads(server.request_line("/v1/traces", gzip.compress(json.dumps(want, indent=1).encode()), encoding="gzip")) == want
    assert json.loads(server.request_line("/v1/logs", b"", server.PROTOBUF)) == {"resourceLogs": []}
    number = field(5, 2, field(1, 2, field(4, 1, 1.5) + field(3, 1, 9) + field(7, 2, text(1, "a") + field(2, 2, field(2, 0, 1)))))
    metric = protobuf.decode(field(1, 2, field(2, 2, field(2, 2, text(1, "m") + number))), "Metrics")["resourceMetrics"][0]["scopeMetrics"][0]["metrics"][0]
    assert metric == {"name": "m", "gauge": {"dataPoints": [{"timeUnixNano": "9", "asDouble": 1.5, "attributes": [{"key": "a", "value": {"boolValue": True}}]}]}}
    deep = text(1, "end")
    for _ in range(3000):
        deep = field(5, 2, field(1, 2, deep))
    assert "end" not in protobuf.decode(field(1, 2, field(2, 2, field(2, 2, field(5, 2, deep)))), "Logs")["resourceLogs"][0]
    for bad, kind, encoding in ((body[:-3], server.PROTOBUF, ""), (b"\x0b", server.PROTOBUF, ""), (body, server.PROTOBUF, "gzip"), (b"{", "application/json", ""), (b"{}", "application/json", ""), (b"\xff", "application/json", ""), (b"{}", "application/json", "br")):
        with pytest.raises(ValueError):
            server.request_line("/v1/traces", bad, kind, encoding)
