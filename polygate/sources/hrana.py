"""The HTTP pipeline: a server over sessions, a client, and a Spark reader over the client."""

from __future__ import annotations

import base64
import json
import threading
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from polygate.errors import EngineError, classify

VERSION = "polygate/0.1"


def to_wire(v: object) -> dict:
    """A value as JSON: integers as text, blobs in base 64."""
    if v is None:
        return {"type": "null"}
    if isinstance(v, (bool, int)):
        return {"type": "integer", "value": str(int(v))}
    if isinstance(v, float):
        return {"type": "float", "value": v}
    if isinstance(v, (bytes, bytearray)):
        return {"type": "blob", "base64": base64.b64encode(bytes(v)).decode()}
    return {"type": "text", "value": str(v)}


def from_wire(d: dict) -> object:
    """A value from JSON; integers that don't parse are 0 and bad base 64 is empty, as clients know it."""
    kind = d.get("type")
    if kind == "integer":
        try:
            return int(d["value"])
        except (ValueError, KeyError, TypeError):
            return 0
    if kind == "float":
        return float(d["value"])
    if kind == "text":
        return d["value"]
    if kind == "blob":
        try:
            return base64.b64decode(d["base64"], validate=True)
        except (ValueError, KeyError):
            return b""
    return None


def run_pipeline(connect: Callable[[], object], request: dict) -> dict:
    """Runs each request on a session of its own; an error is that request's result, and the next one runs."""
    results = []
    for r in request.get("requests", []):
        if r.get("type") == "close":
            results.append({"type": "ok", "response": {"type": "close"}})
            continue
        try:
            if r.get("type") != "execute":
                raise EngineError(f"unknown request type {r.get('type')!r}")
            stmt = r["stmt"]
            session = connect()
            try:
                out = session.query(stmt["sql"], [from_wire(a) for a in stmt.get("args", [])])
            finally:
                session.close()
            rows = out.kind == "query" or bool(out.columns)
            result = {
                "cols": [{"name": c, "decltype": t} for c, t in zip(out.columns, out.types)] if rows else [],
                "rows": [[to_wire(v) for v in row] for row in out.rows],
                "affected_row_count": out.affected,
                "last_insert_rowid": None if out.last_insert_id is None else str(out.last_insert_id),
            }
            results.append({"type": "ok", "response": {"type": "execute", "result": result}})
        except Exception as e:
            results.append({"type": "error", "error": {"message": classify(e).message, "code": None}})
    return {"baton": None, "base_url": None, "results": results}


class HranaServer:
    """``POST /v2/pipeline``, ``GET /health`` and ``GET /version`` in a thread of its own."""

    def __init__(self, connect: Callable[[], object], host: str = "127.0.0.1", port: int = 0, limiter=None) -> None:
        class Handler(BaseHTTPRequestHandler):
            def _send(self, code: int, body: bytes, kind: str = "text/plain") -> None:
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self) -> None:  # noqa: N802
                text = {"/health": "ok", "/version": VERSION}.get(self.path)
                self._send(200 if text else 404, (text or "not found").encode())

            def do_POST(self) -> None:  # noqa: N802
                if self.path != "/v2/pipeline":
                    self._send(404, b"not found")
                    return
                slot = limiter.try_acquire() if limiter is not None else None
                if limiter is not None and slot is None:
                    self._send(503, b"Too many connections")
                    return
                try:
                    body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                    try:
                        request = json.loads(body)
                    except ValueError:
                        self._send(400, b"malformed JSON")
                        return
                    self._send(200, json.dumps(run_pipeline(connect, request)).encode(), "application/json")
                finally:
                    if slot is not None:
                        slot.release()

            def log_message(self, *args: object) -> None:
                pass

        self._http = ThreadingHTTPServer((host, port), Handler)
        self.host, self.port = self._http.server_address[:2]
        self.url = f"http://{self.host}:{self.port}"
        self._thread = threading.Thread(target=self._http.serve_forever, daemon=True)

    def start(self) -> HranaServer:
        self._thread.start()
        return self

    def close(self) -> None:
        self._http.shutdown()
        self._http.server_close()


class HranaClient:
    """Statements to a remote pipeline; a baton that the server gives is sent along with the next."""

    def __init__(self, url: str, token: str | None = None, timeout: float = 60.0) -> None:
        self.url, self.token, self.timeout, self._baton = url.rstrip("/"), token, timeout, None

    def health_check(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/health", timeout=self.timeout) as r:
                return r.status == 200
        except OSError:
            return False

    def pipeline(self, requests: list[dict]) -> list[dict]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        body = json.dumps({"baton": self._baton, "requests": requests}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/v2/pipeline", body, headers), timeout=self.timeout) as r:
                out = json.loads(r.read())
        except urllib.error.HTTPError as e:
            raise EngineError(f"HTTP {e.code}: {e.read().decode(errors='replace')}") from None
        except OSError as e:
            raise EngineError(f"no connection: {e}") from None
        self._baton = out.get("baton")
        return out["results"]

    def execute(self, sql: str, args: Sequence = ()) -> dict:
        """cols, rows, affected_row_count and last_insert_rowid of one statement."""
        r = self.pipeline([{"type": "execute", "stmt": {"sql": sql, "args": [to_wire(a) for a in args]}}])[0]
        if r["type"] == "error":
            raise EngineError(r["error"]["message"])
        out = r["response"]["result"]
        out["rows"] = [tuple(from_wire(v) for v in row) for row in out["rows"]]
        return out

    def close(self) -> None:
        if self._baton is not None:
            self.pipeline([{"type": "close"}])
            self._baton = None


def read(spark: SparkSession, url: str, sql: str, schema: str, args: Sequence = (), slices: Sequence[Sequence] = ((),)) -> DataFrame:
    """A remote query as a DataFrame: each slice of extra arguments is one task's statement, run on an executor.

    Without slices one task reads the whole result; with, say, ranges of a key as last two arguments, as many as there
    are ranges.
    """
    import pandas as pd
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(schema).names
    parts = spark.createDataFrame([(i, json.dumps([to_wire(a) for a in (*args, *s)])) for i, s in enumerate(slices)], "i int, args string").repartition(len(slices), "i")

    def run(frames):
        for f in frames:
            for text in f["args"]:
                got = HranaClient(url).execute(sql, [from_wire(a) for a in json.loads(text)])
                yield pd.DataFrame(got["rows"], columns=fields)

    return parts.mapInPandas(run, schema)
