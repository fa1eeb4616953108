"""A small threaded HTTP adapter: job status, tasks, logs, an event stream and the job's controls; bound to this host."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Protocol
from urllib.parse import urlsplit

from pagemill.operators.requests import ROUTES

PAGE = b"<!doctype html><title>pagemill</title><h1>Batch job</h1><pre id=s></pre><script>new EventSource('/api/stream').addEventListener('metrics',e=>{document.getElementById('s').textContent=e.data})</script>"


class Control(Protocol):
    """What the adapter's buttons do: a JobControl, or a BatchJob."""

    status: str

    def pause(self) -> None: ...

    def resume(self) -> None: ...

    def cancel(self) -> None: ...

    def reconfigure(self, workers: int | None = None, output_format: str | None = None, retries: int | None = None) -> None: ...


class LogBuffer:
    """The newest lines of a log with sequence numbers that never repeat."""

    def __init__(self, keep: int = 2000):
        self.keep, self.next, self.lines, self.lock = keep, 0, [], threading.Lock()

    def add(self, message: str) -> None:
        with self.lock:
            self.lines.append((self.next, f"[{time.strftime('%H:%M:%S')}] {message}"))
            self.next += 1
            del self.lines[: -self.keep]

    def since(self, sequence: int) -> list[tuple[int, str]]:
        with self.lock:
            return [x for x in self.lines if x[0] >= sequence]

    def tail(self, n: int = 100) -> list[str]:
        with self.lock:
            return [line for _, line in self.lines[-n:]]


def serve(control: Control, metrics: Callable[[], dict], tasks: Callable[[], list[dict]], log: LogBuffer, retry_failed: Callable[[], int], host: str = "127.0.0.1", port: int = 8765, period: float = 1.0) -> ThreadingHTTPServer:
    """Start the adapter in a thread of its own; an open event stream doesn't block other requests."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def reply(self, payload, status: int = 200, kind: str = "application/json; charset=utf-8") -> None:
            body = payload if isinstance(payload, bytes) else json.dumps(payload, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def handler(self) -> str:
            return ROUTES.get((self.command, urlsplit(self.path).path.rstrip("/")), "")

        def do_GET(self) -> None:
            name = self.handler()
            if name == "page":
                self.reply(PAGE, kind="text/html; charset=utf-8")
            elif name == "status":
                self.reply(metrics())
            elif name == "tasks":
                self.reply(tasks())
            elif name == "logs":
                self.reply(log.tail(200))
            elif name == "stream":
                self.stream()
            else:
                self.reply({"ok": False, "message": "Not Found"}, 404)

        def do_POST(self) -> None:
            name = self.handler()
            try:
                if name in ("pause", "resume", "cancel"):
                    getattr(control, name)()
                    self.reply({"ok": True, "message": f"Job {control.status.lower()}"})
                elif name == "retry-failed":
                    self.reply({"ok": True, "message": f"Re-queued {retry_failed()} failed task(s)"})
                elif name == "reconfigure":
                    raw = self.rfile.read(int(self.headers.get("Content-Length", 0)))
                    data = json.loads(raw) if raw.strip() else {}
                    control.reconfigure(**{k: data.get(k) for k in ("workers", "output_format", "retries")})
                    self.reply({"ok": True, "message": "Reconfigured successfully"})
                else:
                    self.reply({"ok": False, "message": "Not Found"}, 404)
            except (ValueError, TypeError, AttributeError) as e:
                self.reply({"ok": False, "message": str(e)}, 400)

        def stream(self) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()
            seen = 0
            try:
                while not server.stopped.is_set():
                    lines = log.since(seen)
                    seen = lines[-1][0] + 1 if lines else seen
                    for event, data in (("metrics", metrics()), ("tasks", tasks()), ("logs", [x for _, x in lines])):
                        if event != "logs" or data:
                            self.wfile.write(f"event: {event}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n".encode())
                    self.wfile.flush()
                    server.stopped.wait(period)
            except OSError:
                return

    server = ThreadingHTTPServer((host, port), Handler)
    server.daemon_threads = True
    server.stopped = threading.Event()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
