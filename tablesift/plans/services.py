"""Small HTTP services on the driver's host or beside a task, for queries whose sources are reached over HTTP."""

from __future__ import annotations

import bisect
import contextlib
import json
import threading
import urllib.parse
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


Answer = Callable[[str, dict | None], tuple[int, dict | None]]


@contextlib.contextmanager
def listen(answer: Answer, host: str = "") -> Iterator[int]:
    """Serves answer(path and query, body sent as JSON or None), a status and what to reply as JSON; gives the port."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"  # connections stay open
        wbufsize = -1  # headers and body leave together
        disable_nagle_algorithm = True

        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, reply = answer(self.path, json.loads(self.rfile.read(size)) if size else None)
            body = b"" if reply is None else json.dumps(reply).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, 0), Handler)
    threading.Thread(target=lambda: server.serve_forever(0.05), daemon=True).start()
    try:
        yield server.server_port
    finally:
        server.shutdown()
        server.server_close()


@contextlib.contextmanager
def serve(spark, answer: Answer) -> Iterator[str]:
    """A service on the driver's host; gives the address."""
    with listen(answer) as port:
        yield f"http://{spark.conf.get('spark.driver.host', '127.0.0.1')}:{port}"


@contextlib.contextmanager
def portal_service(spark, packages: list[dict]) -> Iterator[str]:
    """An open-data portal over a list of packages (id, metadata_modified, ...), which may grow while it is served. They are put in order when
    they have changed, not for each request, so a page costs no more where there are more packages."""
    lock, shown_of = threading.Lock(), {}

    def in_order() -> tuple[list[dict], list[dict], list[str]]:
        with lock:
            if shown_of.get("all") != packages:  # the same objects are told apart without being looked into
                ordered = sorted(packages, key=lambda p: (p["metadata_modified"], p["id"]))
                shown_of.update(all=list(packages), ordered=ordered, times=[p["metadata_modified"] for p in ordered])
            return shown_of["all"], shown_of["ordered"], shown_of["times"]

    def answer(path: str, _) -> tuple[int, dict]:
        query = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(path).query))
        found, ordered, times = in_order()
        if "fq" in query or "sort" in query:
            begin, end = 0, len(ordered)
            if "fq" in query:
                first, last = query["fq"].removeprefix("metadata_modified:[").removesuffix("]").split(" TO ")
                begin = 0 if first == "*" else bisect.bisect_left(times, first)
                end = len(ordered) if last == "*" else max(begin, bisect.bisect_right(times, last))
            at, rows, total = int(query.get("start", 0)), int(query["rows"]), end - begin
            if " desc" in query.get("sort", ""):
                shown = ordered[max(begin, end - at - rows) : max(begin, end - at)][::-1]
            else:
                shown = ordered[begin + at : min(end, begin + at + rows)]
        else:
            at, total = int(query.get("start", 0)), len(found)
            shown = found[at : at + int(query["rows"])]
        return 200, {"result": {"count": total, "results": shown if "fl" not in query else [{k: p[k] for k in query["fl"].split(",")} for p in shown]}}

    with serve(spark, answer) as url:
        yield url
