"""What the wire front ends share: a threaded server, exact reads and buffered writes."""

from __future__ import annotations

import contextlib
import socket
import socketserver
import threading
from collections.abc import Callable

from polygate.lexer import Dialect
from polygate.plans.translate import Translated
from polygate.session import Session


class Closed(Exception):
    """The client went away."""


class Stream:
    """A socket with exact reads; writes are held until :meth:`flush`."""

    def __init__(self, sock: socket.socket) -> None:
        sock.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.sock, self._in, self._out = sock, sock.makefile("rb", 1 << 16), bytearray()

    def read(self, n: int) -> bytes:
        data = self._in.read(n) if n else b""
        if len(data) < n:
            raise Closed
        return data

    def write(self, data: bytes) -> None:
        self._out += data
        if len(self._out) >= 1 << 16:
            self.flush()

    def flush(self) -> None:
        if self._out:
            self.sock.sendall(self._out)
            self._out.clear()


class WireServer:
    """One protocol on one address.  ``connect`` gives each client its session; a limiter bounds their number."""

    dialect = Dialect.MYSQL

    def __init__(self, connect: Callable[..., Session], host: str = "127.0.0.1", port: int = 0) -> None:
        self.connect = connect
        outer = self

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                with contextlib.suppress(Closed, OSError):
                    outer.converse(Stream(self.request))

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads, allow_reuse_address = True, True

        self._server = Server((host, port), Handler)
        self.host, self.port = self._server.server_address[:2]
        self._thread = threading.Thread(target=self._server.serve_forever, daemon=True)

    def converse(self, stream: Stream) -> None:
        """Serves one client to its end."""
        raise NotImplementedError

    def start(self) -> WireServer:
        self._thread.start()
        return self

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()


def command_of(t: Translated) -> str:
    """The words that name a statement in replies: SELECT, INSERT, CREATE TABLE, BEGIN, ..."""
    if t.kind in ("query", "metadata", "found_rows"):
        return "SELECT"
    if t.kind == "transaction":
        return {"rollback_to": "ROLLBACK", "savepoint": "SAVEPOINT", "release": "RELEASE"}.get(t.plan.action, t.plan.action.upper())
    words = [x.upper for x in t.tokens if x.kind == "word"]
    if t.kind == "ddl":
        what = next((w for w in words[1:] if w in ("TABLE", "INDEX", "VIEW")), "TABLE")
        return f"{words[0]} {what}"
    return "INSERT" if words[:1] == ["REPLACE"] else words[0] if words else t.text or "SET"
