"""HTTP control of an engine, by the standard library."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from concord.functions import filters
from concord.model import DST, SRC

from . import reports
from .engine import Engine


ROOT = "/api/v1/"


class Server:
    """POST check and writesOff; GET progress, summary, docMismatches, nsMismatches: all under /api/v1. Two POSTs at once are an error that stops the server."""

    def __init__(self, engine: Engine, port: int = 27020, host: str = "127.0.0.1"):
        self.engine, self.busy, self.failed, self.worker = engine, threading.Lock(), None, None
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_GET(self):  # noqa: N802
                outer._answer(self, "GET")

            def do_POST(self):  # noqa: N802
                outer._answer(self, "POST")

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.port = self.http.server_address[1]

    def serve(self) -> threading.Thread:
        thread = threading.Thread(target=self.http.serve_forever, daemon=True)
        thread.start()
        return thread

    def close(self) -> None:
        self.http.shutdown()
        self.http.server_close()

    def _answer(self, request: BaseHTTPRequestHandler, verb: str) -> None:
        parts = urlsplit(request.path)
        query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
        body = request.rfile.read(int(request.headers.get("Content-Length") or 0))
        try:
            route = getattr(self, f"_{verb.lower()}_{parts.path.removeprefix(ROOT)}", None) if parts.path.startswith(ROOT) else None
            if route is None:
                return self._send(request, 404, {"error": "no such route"})
            out = route(json.loads(body) if body else {}, query)
        except Exception as e:  # the caller is told; the engine goes on
            return self._send(request, 400, {"error": str(e)})
        if isinstance(out, dict):
            return self._send(request, 200, out)
        request.send_response(200)
        request.send_header("Content-Type", "application/x-ndjson")
        request.end_headers()
        for line in out:
            request.wfile.write(line.encode() + b"\n")
        return None

    @staticmethod
    def _send(request, code: int, value: dict) -> None:
        data = reports.to_json(value).encode()
        request.send_response(code)
        request.send_header("Content-Type", "application/json")
        request.send_header("Content-Length", str(len(data)))
        request.end_headers()
        request.wfile.write(data)

    def _alone(self, work) -> dict:
        if not self.busy.acquire(blocking=False):
            threading.Thread(target=self.close, daemon=True).start()
            raise RuntimeError("another operation is running; the server stops")
        try:
            return work() or {"success": True}
        finally:
            self.busy.release()

    def _post_check(self, body: dict, _) -> dict:
        def begin():
            if self.worker is not None and self.worker.is_alive():
                raise RuntimeError("a check is running")
            if body.get("filter"):
                # A SQL predicate could call anything; only query documents come this way.
                if not isinstance(body["filter"], dict):
                    raise ValueError("filter is a query document")
                filters.compiled(body["filter"])
                self.engine.options.filter = body["filter"]
            self.worker = threading.Thread(target=self._run, daemon=True)
            self.worker.start()

        return self._alone(begin)

    def _run(self) -> None:
        try:
            self.engine.run()
        except Exception as e:
            self.failed = e

    def _post_writesOff(self, body: dict, _) -> dict:  # noqa: N802
        final = {c: (int(t["t"]), int(t.get("i", 0))) for c, t in ((SRC, body.get("srcTimestamp")), (DST, body.get("dstTimestamp"))) if t}
        return self._alone(lambda: self.engine.writes_off(final))

    def _get_progress(self, _, query: dict) -> dict:
        return {"progress": self.engine.progress() | ({"error": str(self.failed)} if self.failed else {})}

    def _get_summary(self, _, query: dict) -> dict:
        return {"summary": self.engine.summary(float(query.get("minDurationSecs", 0)))}

    def _get_docMismatches(self, _, query: dict):  # noqa: N802
        return reports.ndjson(self.engine.doc_mismatches(float(query.get("minDurationSecs", 0))))

    def _get_nsMismatches(self, _, query: dict):  # noqa: N802
        tolerances = tuple(t for t in query.get("indexSpecIgnore", "").split(",") if t)
        return reports.ndjson(self.engine.ns_mismatches(tolerances or None))
