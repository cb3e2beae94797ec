"""A thin HTTP face of the engine: tables, loads, requests and benchmarks as JSON."""

from __future__ import annotations

import json
import re
import time
import urllib.parse
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from . import benchmarks, session
from .engine import Engine
from .errors import EngineError, InvalidQueryError, LoadError, TooLargeError
from .plans.request import QueryRequest
from .sources.sinks import envelope

#: Larger bodies, and larger JSON bodies or form fields, are refused with 413.
LARGEST_BODY, LARGEST_JSON = 4 << 30, 16 << 20


class Body:
    """A request's body, read in chunks; never more than its declared length."""

    def __init__(self, stream, size: int):
        self.stream, self.left = stream, size

    def read(self, n: int = session.CHUNK) -> bytes:
        got = self.stream.read(min(n, self.left))
        if not got and self.left:
            raise LoadError("the body ends before its declared length")
        self.left -= len(got)
        return got


def multipart(content_type: str, body, file: Callable[[Iterator[bytes]], object]) -> dict[str, object]:
    """The parts of a form by name: text of fields, and for a part with a file name what `file` makes of its chunks."""
    found = re.search(r'boundary="?([^";]+)"?', content_type or "")
    if not (content_type or "").lower().startswith("multipart/form-data") or not found:
        raise LoadError("multipart/form-data is expected")
    mark = b"\r\n--" + found.group(1).encode()
    held = b"\r\n"

    def until(stop: bytes) -> Iterator[bytes]:
        nonlocal held
        while (at := held.find(stop)) < 0:
            if len(held) > len(stop):
                yield held[: -len(stop)]
                held = held[-len(stop) :]
            more = body.read()
            if not more:
                raise LoadError("a part of the form has no end")
            held += more
        yield held[:at]
        held = held[at + len(stop) :]

    def small(chunks: Iterator[bytes]) -> bytes:
        out = b""
        for chunk in chunks:
            out += chunk
            if len(out) > LARGEST_JSON:
                raise TooLargeError(f"a form field of more than {LARGEST_JSON} bytes")
        return out

    out: dict[str, object] = {}
    small(until(mark))
    while True:
        while len(held) < 2 and (more := body.read()):
            held += more
        if held.startswith(b"--"):
            return out
        small(until(b"\r\n"))
        head = b""
        while line := small(until(b"\r\n")):
            head += line + b"\n"
        named, filed = re.search(rb'[; ]name="?([^";\r\n]+)"?', head), re.search(rb'filename\*?="?([^";\r\n]*)"?', head)
        chunks = until(mark)
        value = file(chunks) if filed else small(chunks).decode()
        for _ in chunks:  # what the taker left
            pass
        if named:
            out[named.group(1).decode()] = value
        if filed and filed.group(1):
            out["filename"] = filed.group(1).decode()


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 0, roots: list[str] | None = None, hosts: list[str] | None = None) -> ThreadingHTTPServer:
    """A server that the caller starts with serve_forever(). Files by path need a listed root, URLs a listed host if any are listed."""

    def body_json(handler) -> dict:
        if handler.body.left > LARGEST_JSON:
            raise TooLargeError(f"JSON of more than {LARGEST_JSON} bytes")
        try:
            got = json.loads(b"".join(session.pieces(handler.body)) or b"{}")
        except ValueError as e:
            raise InvalidQueryError(f"no JSON: {e}") from e
        if not isinstance(got, dict):
            raise InvalidQueryError("a JSON object is expected")
        return got

    def form(handler) -> tuple[dict, str | None]:
        """Fields of a form, and the path of its file, spooled to the shared folder; None if there is none or an empty one."""
        spooled = []

        def file(chunks):
            path, size = session.spool(engine.spark, chunks, "upload")
            spooled.append(path)
            return size

        try:
            fields = multipart(handler.headers.get("Content-Type", ""), handler.body, file)
        except BaseException:
            for path in spooled:
                session.remove(engine.spark, path)
            raise
        for path in spooled[1:] if fields.get("file") else spooled:
            session.remove(engine.spark, path)
        return fields, spooled[0] if fields.get("file") else None

    def create(handler):
        got = body_json(handler)
        columns = got.get("columns") or []
        try:
            pairs = [(c["name"], c["type"]) for c in columns]
        except (KeyError, TypeError) as e:
            raise InvalidQueryError("columns need name and type") from e
        engine.create_table(got.get("name") or got.get("tableName") or "", pairs)
        return 201, engine.describe(got.get("name") or got.get("tableName"))

    def drop(handler, name):
        engine.drop_table(name)
        return 200, {"message": f"table {name} dropped"}

    def loaded(run):
        began = time.perf_counter()
        rows = run()
        return 200, {"message": "loaded", "rowsLoaded": rows, "loadingMs": int((time.perf_counter() - began) * 1000)}

    def load(handler):
        fields, path = form(handler)
        if not path:
            raise LoadError("the file is empty")
        text = lambda k: str(fields.get(k, "")).strip()
        return loaded(lambda: engine.adopt(text("tableName"), path, text("fileFormat") or text("format")))

    def load_url(handler):
        got = body_json(handler)
        return loaded(lambda: engine.load_url(got.get("tableName") or "", got.get("url") or "", got.get("fileFormat") or got.get("format") or "", got.get("maxRows"), hosts))

    def select(handler):
        return 200, envelope(engine.query(QueryRequest.from_json(body_json(handler))))

    def scales_of(value, default: str) -> list[int]:
        try:
            return [int(x) for x in (value if isinstance(value, list) else str(value or default).split(","))]
        except ValueError as e:
            raise InvalidQueryError(f"scales are whole numbers: {e}") from e

    def bench_path(handler):
        """File and scales as parameters of the address or as JSON, where requests may stand as well."""
        got = {k: v[-1] for k, v in urllib.parse.parse_qs(handler.path.partition("?")[2]).items()} | body_json(handler)
        path = Path(str(got.get("filePath") or got.get("path") or "")).resolve()
        if not any(path.is_relative_to(Path(r).resolve()) for r in roots or []):
            raise InvalidQueryError(f"not below an allowed folder: {path}")
        if not path.exists():
            raise LoadError(f"no file {path}")
        asked = {k: QueryRequest.from_json({"tableName": "bench", **v}) for k, v in (got.get("requests") or {}).items()}
        return 200, benchmarks.report(engine.spark, str(path), path.name, scales_of(got.get("scales"), benchmarks.PATH_SCALES), asked, engine.profile)

    def bench(handler):
        fields, path = form(handler)
        if not path:
            raise LoadError("the file is empty")
        try:
            return 200, benchmarks.report(engine.spark, path, str(fields.get("filename") or "upload"), scales_of(fields.get("scales"), benchmarks.UPLOAD_SCALES), {}, engine.profile)
        finally:
            session.remove(engine.spark, path)

    routes = [
        ("POST", r"/api/tables", create),
        ("GET", r"/api/tables", lambda h: (200, [engine.describe(t) for t in engine.list_tables()])),
        ("POST", r"/api/tables/load", load),
        ("POST", r"/api/tables/load-url", load_url),
        ("GET", r"/api/tables/([^/]+)", lambda h, name: (200, engine.describe(name))),
        ("DELETE", r"/api/tables/([^/]+)", drop),
        ("POST", r"/api/query/select", select),
        ("POST", r"/api/benchmark/run", bench),
        ("POST", r"/api/benchmark/run-path", bench_path),
    ]

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            status, out = 404, {"status": 404, "detail": "no such address"}
            try:
                size = int(self.headers.get("Content-Length") or 0)
                self.body = Body(self.rfile, min(size, LARGEST_BODY))
                if size > LARGEST_BODY:
                    raise TooLargeError(f"a body of more than {LARGEST_BODY} bytes")
                path = self.path.partition("?")[0]
                for method, pattern, run in routes:
                    found = re.fullmatch(pattern, path)
                    if method == self.command and found:
                        status, out = run(self, *map(urllib.parse.unquote, found.groups()))
                        break
            except EngineError as e:
                status, out = e.status, {"status": e.status, "title": type(e).__name__, "detail": str(e)}
            except Exception as e:  # noqa: BLE001
                status, out = 500, {"status": 500, "title": type(e).__name__, "detail": str(e).partition("\n")[0]}
            # A body that nobody read would be taken for the next request.
            self.close_connection = self.close_connection or bool(getattr(self, "body", None) and self.body.left)
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/problem+json" if status >= 400 else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
