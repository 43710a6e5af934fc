"""The MySQL protocol, version 10: logins, text queries and prepared statements.

Columns have four types: 64-bit integer, double, string and blob.  Commands outside the list below are refused.
"""

from __future__ import annotations

import itertools
import os
import struct

from polygate.errors import AccessDenied, EngineError, SqlSyntaxError, classify
from polygate.frontends.wire import Closed, Stream, WireServer
from polygate.functions.scalar import SERVER_VERSION
from polygate.guard import AuthRequest
from polygate.lexer import Dialect
from polygate.session import Prepared, Result, Session

# Fixed values of the protocol: commands, capabilities, column types, status bits.
QUIT, INIT_DB, QUERY, FIELD_LIST, STATISTICS, PING, CHANGE_USER, STMT_PREPARE, STMT_EXECUTE, SEND_LONG_DATA, STMT_CLOSE, STMT_RESET, SET_OPTION, RESET_CONNECTION = 1, 2, 3, 4, 9, 14, 17, 22, 23, 24, 25, 26, 27, 31
LONG_PASSWORD, FOUND_ROWS, CONNECT_WITH_DB, PROTOCOL_41, TRANSACTIONS, SECURE_CONNECTION, MULTI_STATEMENTS, MULTI_RESULTS, PLUGIN_AUTH, LENENC_AUTH = 1, 2, 8, 512, 8192, 32768, 65536, 131072, 524288, 2097152
LONGLONG, DOUBLE, VAR_STRING, BLOB = 8, 5, 253, 252
IN_TRANSACTION, AUTOCOMMIT, MORE_RESULTS = 1, 2, 8
TYPES = {"INTEGER": (LONGLONG, 63, 20), "REAL": (DOUBLE, 63, 22), "TEXT": (VAR_STRING, 45, 65535), "BLOB": (BLOB, 63, 65535)}
NATIVE = b"mysql_native_password"
_OFFERED = LONG_PASSWORD | FOUND_ROWS | CONNECT_WITH_DB | PROTOCOL_41 | TRANSACTIONS | SECURE_CONNECTION | MULTI_STATEMENTS | MULTI_RESULTS | PLUGIN_AUTH
_LARGEST = (1 << 24) - 1


def lenenc(n: int) -> bytes:
    """A length-encoded integer."""
    if n < 251:
        return bytes([n])
    if n < 1 << 16:
        return b"\xfc" + n.to_bytes(2, "little")
    return b"\xfd" + n.to_bytes(3, "little") if n < 1 << 24 else b"\xfe" + n.to_bytes(8, "little")


def read_lenenc(data: bytes, at: int) -> tuple[int, int]:
    size = {0xFC: 2, 0xFD: 3, 0xFE: 8}.get(data[at], 0)
    return (int.from_bytes(data[at + 1 : at + 1 + size], "little"), at + 1 + size) if size else (data[at], at + 1)


def string(data: bytes) -> bytes:
    return lenenc(len(data)) + data


def _text(v: object) -> bytes:
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return str(int(v) if isinstance(v, bool) else v).encode()


def text_row(row: tuple) -> bytes:
    return b"".join(b"\xfb" if v is None else string(_text(v)) for v in row)


def binary_row(row: tuple, types: list[str]) -> bytes:
    nulls, out = bytearray((len(row) + 9) // 8), []
    for i, (v, t) in enumerate(zip(row, types, strict=True)):
        if v is None:
            nulls[(i + 2) // 8] |= 1 << (i + 2) % 8
        elif t == "INTEGER":
            out.append(struct.pack("<q", int(v)))
        elif t == "REAL":
            out.append(struct.pack("<d", v))
        else:
            out.append(string(_text(v)))
    return b"\0" + bytes(nulls) + b"".join(out)


#: Types of bound values that have a fixed size.
_FIXED = {1: "b", 2: "h", 3: "i", 8: "q", 9: "i", 13: "h", 4: "f", 5: "d"}


def bound_values(data: bytes, at: int, n: int, kinds: list[tuple[int, bool]] | None, long: dict[int, bytes]) -> tuple[list, list[tuple[int, bool]]]:
    """The parameters of COM_STMT_EXECUTE and their types, which a client may leave out the next time."""
    if not n:
        return [], []
    nulls = data[at : at + (n + 7) // 8]
    at += (n + 7) // 8
    if data[at]:
        kinds = [(data[at + 1 + 2 * i], bool(data[at + 2 + 2 * i] & 0x80)) for i in range(n)]
        at += 2 * n
    at += 1
    if kinds is None:
        raise SqlSyntaxError("parameters without types")
    out: list = []
    for i, (kind, unsigned) in enumerate(kinds):
        if i in long:
            out.append(long[i] if kind in (249, 250, 251, 252) else long[i].decode())
        elif nulls[i // 8] >> i % 8 & 1 or kind == 6:
            out.append(None)
        elif kind in _FIXED:
            code = _FIXED[kind].upper() if unsigned and kind not in (4, 5) else _FIXED[kind]
            (v,) = struct.unpack_from("<" + code, data, at)
            at += struct.calcsize("<" + code)
            out.append(v - (1 << 64) if kind == 8 and v >= 1 << 63 else v)
        elif kind in (7, 10, 12, 11):
            size = data[at]
            out.append(_moment(kind, data[at + 1 : at + 1 + size]))
            at += 1 + size
        else:
            size, at = read_lenenc(data, at)
            raw = data[at : at + size]
            at += size
            out.append(_string_or_bytes(raw, kind))
    return out, kinds


def _string_or_bytes(raw: bytes, kind: int) -> object:
    """Blob types carry text as well: what is valid UTF-8 is text."""
    if kind in (249, 250, 251, 252):
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw
    return raw.decode()


def _moment(kind: int, raw: bytes) -> str:
    """A date, a time stamp or a time as text."""
    if kind == 11:
        if not raw:
            return "00:00:00"
        minus, days, h, m, s = struct.unpack("<BIBBB", raw[:8])
        return f"{'-' if minus else ''}{days * 24 + h:02d}:{m:02d}:{s:02d}"
    y, mo, d = struct.unpack("<HBB", raw[:4]) if len(raw) >= 4 else (0, 0, 0)
    date = f"{y:04d}-{mo:02d}-{d:02d}"
    if kind == 10:
        return date
    h, m, s = raw[4:7] if len(raw) >= 7 else (0, 0, 0)
    micro = f".{struct.unpack('<I', raw[7:11])[0]:06d}" if len(raw) >= 11 else ""
    return f"{date} {h:02d}:{m:02d}:{s:02d}{micro}"


class _Client:
    def __init__(self, stream: Stream) -> None:
        self.stream, self.sequence, self.session = stream, 0, None
        self.prepared: dict[int, Prepared] = {}
        self.kinds: dict[int, list] = {}
        self.long: dict[int, dict[int, bytes]] = {}

    def receive(self) -> bytes:
        out = b""
        while True:
            head = self.stream.read(4)
            size = int.from_bytes(head[:3], "little")
            self.sequence = (head[3] + 1) % 256
            out += self.stream.read(size)
            if size < _LARGEST:
                return out

    def send(self, body: bytes) -> None:
        while True:
            part, body = body[:_LARGEST], body[_LARGEST:]
            self.stream.write(len(part).to_bytes(3, "little") + bytes([self.sequence]) + part)
            self.sequence = (self.sequence + 1) % 256
            if len(part) < _LARGEST:
                return

    def status(self, more: bool = False) -> int:
        inside = self.session is not None and self.session.in_transaction
        return AUTOCOMMIT | (IN_TRANSACTION if inside else 0) | (MORE_RESULTS if more else 0)

    def ok(self, affected: int = 0, last_id: int = 0, more: bool = False) -> None:
        self.send(b"\0" + lenenc(affected) + lenenc(max(last_id, 0)) + struct.pack("<HH", self.status(more), 0))

    def eof(self, more: bool = False) -> None:
        self.send(b"\xfe" + struct.pack("<HH", 0, self.status(more)))

    def error(self, e: BaseException) -> None:
        m = classify(e)
        self.send(b"\xff" + struct.pack("<H", m.code) + b"#" + m.sqlstate.encode() + m.message.encode())

    def column(self, name: str, kind: str) -> None:
        code, charset, size = TYPES[kind]
        self.send(string(b"def") + string(b"") * 3 + string(name.encode()) * 2 + b"\x0c" + struct.pack("<HIBHB", charset, size, code, 0, 0x1F if kind == "REAL" else 0) + b"\0\0")

    def result(self, r: Result, binary: bool = False, more: bool = False) -> None:
        if not r.columns:
            self.ok(r.affected, r.last_insert_id or 0, more)
            return
        self.send(lenenc(len(r.columns)))
        for c, t in zip(r.columns, r.types, strict=True):
            self.column(c, t)
        self.eof(more)
        for row in r.rows:
            self.send(binary_row(row, r.types) if binary else text_row(row))
        self.eof(more)


class MySqlServer(WireServer):
    """``login(request)`` gives a session; without logins any user gets one."""

    dialect = Dialect.MYSQL

    def __init__(self, connect, host: str = "127.0.0.1", port: int = 0) -> None:
        super().__init__(connect, host, port)
        self._ids = itertools.count(1)

    def converse(self, stream: Stream) -> None:
        c = _Client(stream)
        try:
            c.session = self._login(c)
        except Closed:
            raise
        except Exception as e:
            c.error(e)
            stream.flush()
            return
        try:
            c.ok()
            stream.flush()
            while self._command(c):
                stream.flush()
        finally:
            c.session.close()

    def _login(self, c: _Client) -> Session:
        salt = bytes(1 + b % 127 for b in os.urandom(20))  # no zero bytes: clients read it as text
        low, high = _OFFERED & 0xFFFF, _OFFERED >> 16
        c.send(b"\x0a" + SERVER_VERSION.encode() + b"\0" + struct.pack("<I", next(self._ids)) + salt[:8] + b"\0" + struct.pack("<HBHHB", low, 45, AUTOCOMMIT, high, 21) + bytes(10) + salt[8:] + b"\0" + NATIVE + b"\0")
        c.stream.flush()
        data = c.receive()
        (flags,) = struct.unpack_from("<I", data)
        if not flags & PROTOCOL_41:
            raise EngineError("the client's protocol is too old")
        at = 32
        end = data.index(b"\0", at)
        user, at = data[at:end].decode(), end + 1
        if flags & LENENC_AUTH:
            size, at = read_lenenc(data, at)
        else:
            size, at = data[at], at + 1
        response, at = data[at : at + size], at + size
        database = None
        if flags & CONNECT_WITH_DB and at < len(data):
            end = data.find(b"\0", at)
            end = len(data) if end < 0 else end
            database, at = data[at:end].decode(), end + 1
        plugin = data[at:].split(b"\0")[0] if flags & PLUGIN_AUTH else NATIVE
        if plugin not in (NATIVE, b""):
            c.send(b"\xfe" + NATIVE + b"\0" + salt + b"\0")
            c.stream.flush()
            response = c.receive()
        return self.connect(self.dialect, AuthRequest(user, salt, response, database))

    def _command(self, c: _Client) -> bool:
        """Serves one command; False at the end."""
        data = c.receive()
        command, body = data[0], data[1:]
        if command == QUIT:
            return False
        try:
            if command == QUERY:
                self._query(c, body.decode())
            elif command in (PING, INIT_DB):
                c.ok()
            elif command == STMT_PREPARE:
                self._prepare(c, body.decode())
            elif command == STMT_EXECUTE:
                self._execute(c, body)
            elif command == SEND_LONG_DATA:
                key, i = struct.unpack_from("<IH", body)
                mine = c.long.setdefault(key, {})
                mine[i] = mine.get(i, b"") + body[6:]
            elif command == STMT_CLOSE:
                (key,) = struct.unpack_from("<I", body)
                if (p := c.prepared.pop(key, None)) is not None:
                    c.session.close_prepared(p)
                c.kinds.pop(key, None)
                c.long.pop(key, None)
            elif command == STMT_RESET:
                c.long.pop(struct.unpack_from("<I", body)[0], None)
                c.ok()
            elif command == SET_OPTION:
                c.eof()
            elif command == RESET_CONNECTION:
                c.session.reset()
                c.prepared.clear()
                c.ok()
            elif command == FIELD_LIST:
                r = c.session.query(f"SELECT * FROM `{body.split(b'\0')[0].decode().replace('`', '``')}` LIMIT 0")
                for name, kind in zip(r.columns, r.types, strict=True):
                    c.column(name, kind)
                c.eof()
            elif command == STATISTICS:
                c.send(b"Uptime: 0")
            elif command == CHANGE_USER:
                raise AccessDenied("changing the user needs a new connection")
            else:
                c.send(b"\xff" + struct.pack("<H", 1047) + b"#08S01" + f"Unknown command {command}".encode())
        except Closed:
            raise
        except Exception as e:
            c.error(e)
        return True

    @staticmethod
    def _query(c: _Client, text: str) -> None:
        empty = True
        for _, r in c.session.each(text, paged=True):
            empty = False
            c.result(r, more=r.more)
        if empty:
            raise SqlSyntaxError("Query was empty")

    @staticmethod
    def _prepare(c: _Client, text: str) -> None:
        p = c.session.prepare(text)
        columns, types = c.session.shape_of(p.plan)
        c.prepared[p.id] = p
        c.send(b"\0" + struct.pack("<IHHBH", p.id, len(columns), p.n_params, 0, 0))
        if p.n_params:
            for _ in range(p.n_params):
                c.column("?", "TEXT")
            c.eof()
        if columns:
            for name, kind in zip(columns, types, strict=True):
                c.column(name, kind)
            c.eof()

    @staticmethod
    def _execute(c: _Client, body: bytes) -> None:
        (key,) = struct.unpack_from("<I", body)
        p = c.prepared.get(key)
        if p is None:
            raise EngineError("unknown prepared statement")
        values, c.kinds[key] = bound_values(body, 9, p.n_params, c.kinds.get(key), c.long.pop(key, {}))
        c.result(c.session.execute_prepared(p, values), binary=True)
