"""The recognition service over HTTP: routing and answers as plain functions, and a threaded server around them."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from io import BytesIO
from pathlib import PurePath
from urllib.parse import parse_qs, urlsplit

from pagemill import __version__, hardware
from pagemill.engine import Engine
from pagemill.operators.prompts import DEFAULT_PROMPT
from pagemill.operators.requests import MAX_NEW_TOKENS
from pagemill.sources.kinds import PDF_SUFFIX

#: Bytes that a request body may have.
LARGEST = 256 << 20


class Refused(Exception):
    """An answer other than 200: its status and what the body says."""

    def __init__(self, status: int, detail: object):
        super().__init__(str(detail))
        self.status, self.detail = status, detail


@dataclass(frozen=True)
class Upload:
    name: str
    data: bytes


def form_fields(kind: str, body: bytes) -> dict[str, str | Upload]:
    """Fields of a multipart or url-encoded form; a part with a file name is an upload."""
    if kind.startswith("application/x-www-form-urlencoded"):
        return {k: v[-1] for k, v in parse_qs(body.decode("utf-8"), keep_blank_values=True).items()}
    if not kind.startswith("multipart/form-data"):
        return {}
    whole = BytesParser(policy=HTTP).parse(BytesIO(b"Content-Type: " + kind.encode("latin-1") + b"\r\n\r\n" + body))
    found: dict[str, str | Upload] = {}
    for part in whole.iter_parts():
        name, file = part.get_param("name", header="content-disposition"), part.get_filename()
        raw = part.get_payload(decode=True) or b""
        if name:
            found[str(name)] = Upload(file, raw) if file is not None else raw.decode("utf-8", "replace")
    return found


class App:
    """Answers of the service; ``engine`` may come later, until then recognition is refused."""

    def __init__(self, engine: Engine | None = None, origins: str | None = None):
        self.engine, self.origins = engine, origins
        self.routes: dict[tuple[str, str], Callable[[str, bytes], dict]] = {
            ("GET", "/"): lambda kind, body: self.about(), ("GET", "/api/v1/health"): lambda kind, body: self.health(), ("GET", "/api/v1/hardware"): lambda kind, body: hardware.inspect(),
            ("POST", "/api/v1/ocr"): self.from_form, ("POST", "/api/v1/ocr/json-payload"): self.from_json,
        }

    def handle(self, method: str, path: str, kind: str = "", body: bytes = b"") -> tuple[int, dict]:
        """Status and JSON body of a request."""
        route = urlsplit(path).path
        route = route.rstrip("/") or "/"
        run = self.routes.get((method, route))
        try:
            if run is None:
                known = any(r == route for _, r in self.routes)
                raise Refused(405 if known else 404, "Method Not Allowed" if known else "Not Found")
            return 200, run(kind, body)
        except Refused as e:
            return e.status, {"detail": e.detail}
        except Exception as e:  # whatever a document or model raises is the server's answer, not its end
            return 500, {"detail": str(e)}

    def about(self) -> dict:
        device = self.engine.device if self.engine else "unknown"
        return {"name": "pagemill recognition service", "version": __version__, "status": "online", "device": device, "cuda_accelerated": device == "cuda"}

    def health(self) -> dict:
        e = self.engine
        return {"status": "healthy" if e and e.is_loaded else "initializing", "model_id": e.model_id if e else None, "device": e.device if e else None, "is_cuda": bool(e) and e.device == "cuda"}

    def _ready(self) -> Engine:
        if self.engine is None or not self.engine.is_loaded:
            raise Refused(503, "OCR model is not loaded yet")
        return self.engine

    def _answer(self, engine: Engine, source: object, is_pdf: bool, prompt: str, limit: int) -> dict:
        began = time.perf_counter()
        result = {"pages": engine.read_pdf(source, prompt, max_new_tokens=limit)} if is_pdf else {"text": engine.read(source, prompt, max_new_tokens=limit)}
        return {"status": "success", "is_pdf": is_pdf, **result, "device_used": engine.device, "execution_time_seconds": round(time.perf_counter() - began, 3)}

    def from_form(self, kind: str, body: bytes) -> dict:
        engine, fields = self._ready(), form_fields(kind, body)
        prompt = fields.get("prompt", DEFAULT_PROMPT)
        try:
            limit = int(fields.get("max_new_tokens", MAX_NEW_TOKENS))
        except (TypeError, ValueError):
            raise Refused(422, "max_new_tokens must be a whole number") from None
        upload, url = fields.get("file"), fields.get("image_url")
        if isinstance(upload, Upload):
            return self._answer(engine, upload.data, PurePath(upload.name or "image.png").suffix.lower() == PDF_SUFFIX, prompt, limit)
        if isinstance(url, str):
            return self._url(engine, url, prompt, limit)
        raise Refused(400, "Must provide either a file upload ('file') or an image URL ('image_url')")

    def from_json(self, kind: str, body: bytes) -> dict:
        try:
            data = json.loads(body)
            url, prompt, limit = data["image_url"], data.get("prompt", DEFAULT_PROMPT), data.get("max_new_tokens", MAX_NEW_TOKENS)
        except (ValueError, KeyError, TypeError, AttributeError):
            raise Refused(422, "a JSON object with image_url is needed") from None
        if not isinstance(url, str) or not isinstance(prompt, str) or not isinstance(limit, int):
            raise Refused(422, "image_url and prompt are text, max_new_tokens is a whole number")
        return self._url(self._ready(), url, prompt, limit)

    def _url(self, engine: Engine, url: str, prompt: str, limit: int) -> dict:
        if not url.startswith(("http://", "https://")):
            raise Refused(400, "image_url must be an http or https URL")  # no files of the server's own
        return self._answer(engine, url, url.lower().endswith(PDF_SUFFIX), prompt, limit)


class _Requests(BaseHTTPRequestHandler):
    """Hands what comes in to the server's app."""

    def log_message(self, *args) -> None:
        pass

    def _pass_on(self) -> None:
        size = int(self.headers.get("Content-Length") or 0)
        if size > LARGEST:
            status, answer = 413, {"detail": "request body too large"}
            self.close_connection = True
        else:
            status, answer = self.server.app.handle(self.command, self.path, self.headers.get("Content-Type", ""), self.rfile.read(size))
        raw = json.dumps(answer, ensure_ascii=False).encode("utf-8")
        self.send_response(status)
        self.send_header("Content-Type", "application/json; charset=utf-8")
        self.send_header("Content-Length", str(len(raw)))
        if self.server.app.origins:
            self.send_header("Access-Control-Allow-Origin", self.server.app.origins)
        self.end_headers()
        self.wfile.write(raw)

    do_GET = do_POST = do_PUT = do_DELETE = _pass_on


def create_app(engine: Engine | None = None, origins: str | None = None) -> App:
    """The service's app; ``origins`` allows other sites' pages to call it."""
    return App(engine, origins)


def serve(app: App, host: str = "127.0.0.1", port: int = 8000, block: bool = False) -> ThreadingHTTPServer:
    """Start the server, in a thread of its own unless it is to block."""
    server = ThreadingHTTPServer((host, port), _Requests)
    server.daemon_threads, server.app = True, app
    if block:
        server.serve_forever()
    else:
        threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
