"""HTTP: a receiver that spools requests into the landing folder, and the query endpoint."""

from __future__ import annotations

import gzip
import json
import os
import threading
import uuid
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from teleloom.operators.nested import loads
from teleloom.sources import protobuf

#: Paths of the protocol, the field a request on them has, and their message.
PATHS = {"/v1/traces": "resourceSpans", "/v1/metrics": "resourceMetrics", "/v1/logs": "resourceLogs"}
MESSAGES = {"/v1/traces": "Traces", "/v1/metrics": "Metrics", "/v1/logs": "Logs"}
PROTOBUF = "application/x-protobuf"


def request_line(path: str, data: bytes, content_type: str = "application/json", encoding: str = "") -> str:
    """A request as sent by an exporter (JSON or protobuf, plain, gzip or deflate) as one JSON line; ValueError if it is none."""
    try:
        data = gzip.decompress(data) if encoding == "gzip" else zlib.decompress(data) if encoding == "deflate" else data
    except (OSError, EOFError, zlib.error):
        raise ValueError("not compressed as stated") from None
    if encoding not in ("", "identity", "gzip", "deflate"):
        raise ValueError(f"encoding {encoding!r}")
    if content_type == PROTOBUF:
        return json.dumps(protobuf.decode(data, MESSAGES[path]) or {PATHS[path]: []})
    text = data.decode("utf-8")
    body = loads(text)
    if not isinstance(body, dict) or PATHS[path] not in body:
        raise ValueError(f"{PATHS[path]} is missing")
    return text.replace("\r", " ").replace("\n", " ")  # line ends stand between tokens only


def make_server(address: tuple[str, int], landing: str, engine=None, hub=None) -> ThreadingHTTPServer:
    """POST to PATHS writes one JSON line to ``landing`` (a local or mounted folder); POST /graphql answers by ``engine``.
    Any origin may call.

    GET /feed subscribes to ``hub`` (S8, T9) and gives {client, snapshot}, the newest page of each signal; GET
    /feed?client=N gives {messages} that came since, an unknown client 404, upon which it subscribes again.
    """
    os.makedirs(landing, exist_ok=True)
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _reply(self, code: int, body: dict | None) -> None:
            data = b"" if body is None else json.dumps(body).encode()  # nothing is an empty protobuf message
            self.send_response(code)
            self.send_header("Content-Type", PROTOBUF if body is None else "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Headers", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self) -> None:  # noqa: N802
            self._reply(200, {})

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            if url.path != "/feed" or hub is None:
                return self._reply(404, {"error": "no such path"})
            client = parse_qs(url.query).get("client", [""])[0]
            if client:
                if not client.isdigit() or int(client) not in hub.clients:
                    return self._reply(404, {"error": "no such client"})
                return self._reply(200, {"messages": hub.take(int(client))})
            mine = hub.subscribe()  # before the snapshot: what comes meanwhile is in both, none is lost
            with lock:
                snapshot = {}
                for name in ("traces", "metrics", "logs") if engine is not None else ():
                    snapshot[name] = [json.loads(r) for r in getattr(engine, name)().items.toJSON().collect()]
            return self._reply(200, {"client": mine, "snapshot": snapshot})

        def do_POST(self) -> None:  # noqa: N802
            data = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            kind = (self.headers.get("Content-Type") or "application/json").split(";")[0].strip().lower()
            if self.path in PATHS:
                try:
                    line = request_line(self.path, data, kind, (self.headers.get("Content-Encoding") or "").strip().lower())
                except ValueError as e:
                    return self._reply(400, {"error": str(e)})
                name = f"{landing}/{uuid.uuid4().hex}"
                with open(f"{landing}/.{uuid.uuid4().hex}", "w") as f:
                    f.write(line + "\n")
                os.rename(f.name, name + ".json")  # a stream never sees half a file
                return self._reply(200, {} if kind != PROTOBUF else None)
            try:
                body = json.loads(data)
            except ValueError:
                return self._reply(400, {"error": "not JSON"})
            if self.path == "/graphql" and engine is not None and isinstance(body, dict):
                with lock:
                    return self._reply(200, engine.execute(body.get("query") or "", body.get("variables"), body.get("operationName")))
            return self._reply(404, {"error": "no such path"})

    return ThreadingHTTPServer(address, Handler)
