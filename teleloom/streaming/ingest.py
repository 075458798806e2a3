"""Structured Streaming ingest: landing folder -> flat signals -> state tables -> listeners.

A micro-batch stores its request lines, numbered without gaps after those of the batches before, and from there each
signal under ``generation/signal/batch=<id>``. Writing a batch again after a failure overwrites its own folders only
and starts from the state that the batch before left, so a retried batch changes nothing: exactly once. Listeners are
told after all signals of a batch are written. Lines that are no request are kept apart in ``rejected``.

State that later batches need is a table written with each batch: the last point of each delta series (within its
idle time and at most ``series_cap``), and the traces that are kept (at most ``trace_cap``; one that was evicted and
comes back is inserted anew). A batch costs what it and that state hold, not what the store holds. Clearing starts a
new generation, empty in all of this; what older generations hold is no longer read.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from teleloom.operators import metrics, traces
from teleloom.plans.storage import _filesystem, delete, exists, subfolders
from teleloom.sources import canonical, otlp
from teleloom.streaming.state import Hub, backoff

SIGNALS = {"spans": otlp.spans, "points": otlp.points, "logs": otlp.logs}
FIELDS = {"spans": "resourceSpans", "points": "resourceMetrics", "logs": "resourceLogs"}
REQUESTS = "batch_seq bigint, received_at timestamp, value string"


class SignalStore:
    """The state tables of the three signals in a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        fs, p = _filesystem(spark, self.root)
        fs.mkdirs(p)

    @property
    def generation(self) -> int:
        return max([int(n[4:]) for n in subfolders(self.spark, self.root) if n.startswith("gen=")], default=0)

    def clear(self) -> None:
        """An atomic step to the next, empty generation."""
        fs, p = _filesystem(self.spark, f"{self.root}/gen={self.generation + 1}")
        fs.mkdirs(p)

    def folder(self, signal: str) -> str:
        return f"{self.root}/gen={self.generation}/{signal}"

    def append(self, signal: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder(signal)}/batch={batch}")

    def batches(self, signal: str) -> list[int]:
        return sorted(int(n[6:]) for n in subfolders(self.spark, self.folder(signal)) if n.startswith("batch="))

    def of_batch(self, signal: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(signal)}/batch={batch}")

    def before(self, signal: str, batch: int) -> DataFrame | None:
        """The table that the last batch before ``batch`` wrote, if there is one."""
        past = [b for b in self.batches(signal) if b < batch]
        return self.of_batch(signal, past[-1]) if past else None

    def read(self, signal: str) -> DataFrame:
        """All rows of a signal; an empty table of its schema if nothing has come."""
        path = self.folder(signal)
        if exists(self.spark, path):
            return self.spark.read.option("recursiveFileLookup", "false").parquet(path).drop("batch")
        return SIGNALS[signal](otlp.parsed(self.spark.createDataFrame([], REQUESTS)))

    def spans(self) -> DataFrame:
        return traces.dedup_spans(canonical.spans(self.read("spans")))

    def traces(self) -> DataFrame:
        return traces.rollup(self.spans())

    def kept_spans(self) -> DataFrame:
        """The spans of the traces that are kept, since these were last inserted."""
        last = self.batches("kept")
        spans = canonical.spans(self.read("spans"))
        kept = self.of_batch("kept", last[-1]) if last else self.spark.createDataFrame([], "trace_id string, inserted_seq bigint")
        held = F.broadcast(kept.withColumnRenamed("trace_id", "_t"))  # trace_cap rows at most
        return traces.dedup_spans(spans.join(held, (F.col("trace_id") == F.col("_t")) & (F.col("arrival_seq") >= F.col("inserted_seq"))).select(*spans.columns))

    def points(self) -> DataFrame:
        """Points as they are shown, with the head of their metric; deltas were taken as they came in."""
        if self.batches("shown"):
            return self.spark.read.parquet(self.folder("shown")).drop("batch")
        return metrics.metric_points(canonical.raw_points(self.read("points")), carry=metrics.HEAD)

    def metrics(self) -> DataFrame:
        return metrics.merge(None, self.points())

    def logs(self) -> DataFrame:
        return canonical.logs(self.read("logs"))

    def rejected(self) -> DataFrame:
        """(value): lines that were no request."""
        path = self.folder("rejected")
        return self.spark.read.parquet(path).select("value") if exists(self.spark, path) else self.spark.createDataFrame([], "value string")


class Ingest:
    """Takes batches of requests into a store, forwards them and tells listeners."""

    def __init__(self, store: SignalStore, listeners: list[Callable[[str, DataFrame, int], None]] | None = None, forward: list[Callable[[DataFrame, int], None]] | None = None,
                 ttl_ns: int | None = metrics.TTL_NS, series_cap: int = 50_000, trace_cap: int = 1000):
        if min(series_cap, trace_cap) < 1:
            raise ValueError("a capacity must be at least 1")
        self.store, self.listeners, self.forward = store, list(listeners or []), list(forward or [])
        self.ttl_ns, self.series_cap, self.trace_cap = ttl_ns, series_cap, trace_cap

    def __call__(self, requests: DataFrame, batch: int) -> None:
        """foreachBatch function. A row is a request with its text in ``value`` or parsed columns."""
        if "resourceSpans" in requests.columns:
            requests = requests.select(F.to_json(F.struct(*[c for c in requests.columns if c.startswith("resource")])).alias("value"))
        lines = self._number(requests.select("value"), batch)
        named = lines.agg(*[F.max(F.col("value").contains(f'"{field}"')).alias(signal) for signal, field in FIELDS.items()]).first()
        came = [signal for signal in SIGNALS if named[signal]]  # most requests are of one signal
        for signal in came:
            self.store.append(signal, SIGNALS[signal](otlp.parsed(lines)), batch)
        if "points" in came:
            self._deltas(batch)
        if "spans" in came:
            self._keep(batch)
        for send in self.forward:  # every exporter gets every request
            send(lines.select("value"), batch)
        for tell in self.listeners:
            for signal in came:
                tell(signal, self.changed(signal, batch), batch)

    def _number(self, lines: DataFrame, batch: int) -> DataFrame:
        """The requests of a batch, stored, with batch_seq: 1, 2, ... over all batches, in order of split and line.

        A line's number is its row in its split plus the rows of the splits before (one count a split) and the
        requests of all batches before.
        """
        store, row = self.store, F.monotonically_increasing_id()
        good = otlp.is_request("value")
        lines.withColumns({"_split": F.spark_partition_id(), "_row": row, "received_at": F.current_timestamp(), "_good": good}).write.mode("overwrite").parquet(f"{store.folder('lines')}/batch={batch}")
        stored = store.of_batch("lines", batch)
        store.append("rejected", stored.filter("not _good and trim(value) <> ''").select("value"), batch)
        stored = stored.filter("_good")
        inside = Window.partitionBy("_split").orderBy("_row")  # a split is what one task read
        sizes = stored.groupBy("_split").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        past = store.before("seen", batch)
        seen = past.first()[0] if past is not None else 0
        numbered = stored.join(sizes, "_split").select((F.lit(seen) + F.col("_start") + F.row_number().over(inside)).cast("bigint").alias("batch_seq"), "received_at", "value")
        store.append("requests", numbered, batch)
        requests = store.of_batch("requests", batch)
        store.append("seen", requests.agg((F.count(F.lit(1)) + F.lit(seen)).alias("n")).coalesce(1), batch)
        delete(store.spark, f"{store.folder('lines')}/batch={batch}")
        return requests

    def _deltas(self, batch: int) -> None:
        """The batch's points as they are shown, and what the next batch takes its deltas from."""
        store = self.store
        new = canonical.raw_points(store.of_batch("points", batch))
        past, base = store.before("series", batch), store.before("seen", batch)
        start = (base.first()[0] if base is not None else 0) + 1
        both = new if past is None else past.unionByName(new)
        shown = metrics.metric_points(both, self.ttl_ns, metrics.HEAD)
        store.append("shown", shown.filter(F.col("arrival_seq") >= F.shiftleft(F.lit(start).cast("bigint"), 24)), batch)
        store.append("series", metrics.last_observed(both, self.ttl_ns, self.series_cap), batch)
        self._forget("series", batch)

    def _keep(self, batch: int) -> None:
        """The traces kept after a batch: those of before and, after them, new ones by first arrival; the last ``trace_cap``.

        A batch is inserted as a whole; only keys and their place are state.
        """
        store = self.store
        came = canonical.spans(store.of_batch("spans", batch)).groupBy("trace_id").agg(F.min("arrival_seq").alias("inserted_seq"))
        past = store.before("kept", batch)
        kept = came if past is None else past.unionByName(came.join(F.broadcast(past), "trace_id", "left_anti"))
        store.append("kept", kept.orderBy(F.desc("inserted_seq")).limit(self.trace_cap), batch)
        self._forget("kept", batch)

    def _forget(self, state: str, batch: int) -> None:
        """Deletes state that not even a retry of this batch reads."""
        past = [b for b in self.store.batches(state) if b < batch]
        for b in past[:-1]:
            delete(self.store.spark, f"{self.store.folder(state)}/batch={b}")

    def changed(self, signal: str, batch: int) -> DataFrame:
        """The whole updated traces and metrics that a batch touched, and its logs.

        Stored rows are reduced to the touched keys before anything is computed from them.
        """
        s, new = self.store, self.store.of_batch(signal, batch)
        if signal == "spans":
            ids = canonical.spans(new).select("trace_id").distinct()
            return traces.rollup(traces.dedup_spans(canonical.spans(s.read("spans")).join(ids, "trace_id", "left_semi")))
        if signal == "points":
            names = canonical.raw_points(new).select(*metrics.METRIC).distinct()
            return metrics.merge(None, s.points().join(names, metrics.METRIC, "left_semi"))
        return canonical.logs(new)


def start(spark: SparkSession, landing: str, ingest: Ingest, checkpoint: str, available_now: bool = True):
    """Request files dropped into ``landing`` (one JSON request to a line) as a stream."""
    lines = spark.readStream.schema("value string").text(landing)
    w = lines.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A tee that writes each batch of requests as JSON lines."""

    def send(requests: DataFrame, batch: int) -> None:
        requests.write.mode("overwrite").text(f"{path}/batch={batch}")

    return send


def http_sink(url: str, headers: dict[str, str] | None = None, tries: int = 5, timeout: float = 10.0, wait: float = 1.0) -> Callable[[DataFrame, int], None]:
    """Forwards each request to the OTLP/HTTP endpoint ``url``, from the executors, with ``headers`` (see ``proxy.headers``).

    A request that fails is sent again after a wait that doubles; one that is refused as wrong (4xx but 429) is not.
    When tries run out the batch fails and is run again, so an upstream may get a request more than once.
    """
    from teleloom.server import PATHS

    def post(rows) -> None:
        for row in rows:
            body = json.loads(row["value"])
            for path, field in PATHS.items():
                if not body.get(field):
                    continue
                data, left = json.dumps({field: body[field]}).encode(), tries
                for pause in backoff(wait):
                    request = urllib.request.Request(url.rstrip("/") + path, data, {"Content-Type": "application/json", **(headers or {})})
                    try:
                        urllib.request.urlopen(request, timeout=timeout).close()
                        break
                    except urllib.error.HTTPError as e:
                        if e.code < 500 and e.code != 429:
                            break
                        error: Exception = e
                    except OSError as e:
                        error = e
                    left -= 1
                    if left <= 0:
                        raise error
                    time.sleep(pause)

    return lambda requests, batch: requests.foreachPartition(post)


#: The kind of message that a signal's change is.
MESSAGES = {"spans": "traces", "points": "metrics", "logs": "logs"}


def live(hub: Hub) -> Callable[[str, DataFrame, int], None]:
    """A listener that broadcasts what a batch changed. Nothing is computed while nobody listens, and no more rows
    reach the driver than the hub's queue holds: the rest would be dropped there."""

    def tell(signal: str, df: DataFrame, batch: int) -> None:
        if hub.clients:
            for row in df.limit(hub.queue).toJSON().collect():
                hub.broadcast(MESSAGES[signal], json.loads(row))
            hub.dispatch()

    return tell


def telemetry_request(points: list[dict], now_ns: int, service: str = "teleloom") -> str:
    """Gauge points (metric_name, value, attributes) as a request line, to be dropped into the landing folder."""
    made = [{"name": p["metric_name"], "gauge": {"dataPoints": [{"timeUnixNano": str(now_ns), "asDouble": p["value"], "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in (p.get("attributes") or {}).items()]}]}} for p in points]
    return json.dumps({"resourceMetrics": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]}, "scopeMetrics": [{"metrics": made}]}]})


def report_self(engine, hub: Hub, queries: list, landing: str, now_ns: int) -> str:
    """The engine's own gauges (stores, clients, progress of streams) enter the signals like any other: a file in ``landing``."""
    own = [{"metric_name": r["metric_name"], "value": r["value"]} for r in engine.self_metrics().collect()]
    own.append({"metric_name": "feed.clients", "value": float(len(hub.clients))})
    own += [p for q in queries for p in progress_points(q)]
    fs, p = _filesystem(engine.spark, f"{landing.rstrip('/')}/.self-{now_ns}.tmp")
    out = fs.create(p, True)
    out.write(bytearray(telemetry_request(own, now_ns).encode() + b"\n"))
    out.close()
    final = f"{landing.rstrip('/')}/self-{now_ns}.json"
    fs.rename(p, _filesystem(engine.spark, final)[1])  # a stream never sees half a file
    return final


DELTA = "service_name string, metric_name string, attr_key string, arrival_seq bigint, value double"


def delta_stream(points: DataFrame, ttl_ms: int = 600_000, generation: int = 0) -> DataFrame:
    """T5: a stream of raw points (columns as in ``canonical.raw_points``) to deltas of cumulative monotonic sums.

    One state row per series: generation and last value. A series idle for ``ttl_ms`` of processing time starts
    anew. No watermark: late points are taken in order of arrival, never dropped. Idle times are checked in every
    trigger, so run it on a processing-time trigger (or once), not until no data is left.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = None
        if state.exists:
            g, v = state.get
            last = v if g == generation else None
        df = pd.concat(list(frames)).sort_values("arrival_seq")
        raw = df["value"].to_numpy()
        prev = [last, *raw[:-1]]
        keep = [p is not None and x >= p for x, p in zip(raw, prev)]
        state.update((generation, float(raw[-1])))
        state.setTimeoutDuration(ttl_ms)
        out = pd.DataFrame({"service_name": key[0], "metric_name": key[1], "attr_key": key[2], "arrival_seq": df["arrival_seq"].to_numpy(), "value": [x - (p or 0.0) for x, p in zip(raw, prev)]})
        yield out[keep]

    c = metrics.numbers(points).filter("metric_type = 'Sum' and temporality = 'Cumulative' and is_monotonic")
    return c.select(*metrics.SERIES, "arrival_seq", "value").groupBy(*metrics.SERIES).applyInPandasWithState(step, DELTA, "generation int, value double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, one file or a folder of files, as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    fs, p = _filesystem(spark, path)
    stream = spark.readStream.schema(schema)
    return stream.parquet(path) if fs.getFileStatus(p).isDirectory() else stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def late_stream(logs: DataFrame, store, checkpoint: str):
    """Problem 4 as a stream: each batch of logs adds its partial aggregates to a ``late.LateStore``."""
    return logs.writeStream.foreachBatch(lambda df, batch: store.add(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_points(query, service: str = "teleloom") -> list[dict]:
    """The last progress of a streaming query as gauge points."""
    p = query.lastProgress
    if not p:
        return []
    p = json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else dict(p)
    names = {"inputRowsPerSecond": "stream.input.rate", "processedRowsPerSecond": "stream.process.rate", "numInputRows": "stream.input.rows"}
    return [{"service_name": service, "metric_name": n, "metric_type": "Gauge", "value": float(p.get(k) or 0.0), "attributes": {"batch": str(p.get("batchId", ""))}} for k, n in names.items()]
