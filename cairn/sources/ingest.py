"""A small ingest server: each POST body is appended to the landing folder of its resource.

Streams then read the landing folders as files. A body is written whole under a temporary name and
renamed, so a reader never sees a part of it. Unknown resources go to ``*`` if it is routed.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

Logger = Callable[[bytes], None]


def landing(folder: str) -> Logger:
    """Writes each message as a file of its own."""
    os.makedirs(folder, exist_ok=True)

    def log(body: bytes) -> None:
        name = uuid.uuid4().hex
        with open(f"{folder}/.{name}", "wb") as f:
            f.write(body.rstrip(b"\n") + b"\n")
        os.rename(f"{folder}/.{name}", f"{folder}/{name}.txt")

    return log


def server(routes: dict[str, Logger], port: int = 0) -> ThreadingHTTPServer:
    """Serves routes in the background: 201 for a message that was logged, 400 otherwise."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            log = routes.get(self.path.strip("/"), routes.get("*"))
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            ok = log is not None and bool(body)
            if ok:
                try:
                    log(body)
                except OSError:
                    ok = False
            self.send_response(201 if ok else 400)
            self.end_headers()

        def log_message(self, *_) -> None:
            pass

    s = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    return s
