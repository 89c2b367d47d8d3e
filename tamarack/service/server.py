"""The service over HTTP with the standard library, one session for all threads."""

from __future__ import annotations

import email.parser
import email.policy
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from tamarack.service.dashboard import PAGE
from tamarack.service.handlers import Service


def parse_upload(content_type: str, data: bytes) -> tuple[str, bytes] | None:
    """(file name, bytes) of the field ``file`` of a multipart body."""
    message = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + data)
    if message.is_multipart():
        for part in message.iter_parts():
            if part.get_param("name", header="content-disposition") == "file":
                return part.get_filename() or "upload", part.get_payload(decode=True) or b""
    return None


def make_server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def _send(self, status: int, data: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            origin = self.headers.get("Origin")
            if origin and origin in service.settings.cors_origins:
                self.send_header("Access-Control-Allow-Origin", origin)
                self.send_header("Access-Control-Allow-Methods", "*")
                self.send_header("Access-Control-Allow-Headers", "*")
            self.end_headers()
            self.wfile.write(data)

        def _json(self, status: int, body: dict) -> None:
            self._send(status, json.dumps(body, ensure_ascii=False).encode(), "application/json")

        def _run(self) -> None:
            url = urlsplit(self.path)
            if self.command == "GET" and url.path == "/dashboard":
                return self._send(200, PAGE.encode(), "text/html; charset=utf-8")
            length = int(self.headers.get("Content-Length") or 0)
            # a body may be larger than a file by its frame; more isn't read
            if length > service.settings.max_upload_mb * 1024 * 1024 + 65_536:
                self.close_connection = True
                return self._json(413, {"detail": f"File exceeds the {service.settings.max_upload_mb} MB upload limit"})
            data, kind = self.rfile.read(length), self.headers.get("Content-Type", "")
            body, upload = None, None
            try:
                if kind.startswith("multipart/form-data"):
                    upload = parse_upload(kind, data)
                elif data:
                    body = json.loads(data)
                    if not isinstance(body, dict):
                        raise ValueError("not an object")
            except ValueError:
                return self._json(422, {"detail": "The body isn't a JSON object"})
            self._json(*service.handle(self.command, url.path, body, self.headers.get("Authorization"), dict(parse_qsl(url.query)), upload))

        do_GET = do_POST = do_DELETE = _run

        def do_OPTIONS(self) -> None:
            self._send(204, b"", "text/plain")

    return ThreadingHTTPServer((host, port), Handler)
