"""Small clients of the three wire protocols, enough to ask and to check: for queries about the front ends, and tests."""

from __future__ import annotations

import socket
import struct

from polygate.frontends import mysql as my
from polygate.frontends import tds
from polygate.frontends.wire import WireServer
from polygate.guard import native_response


class Wire:
    """A connection to a server."""

    def __init__(self, server: WireServer) -> None:
        self.sock = socket.create_connection((server.host, server.port), 60)
        self.file = self.sock.makefile("rb")

    def close(self) -> None:
        self.sock.close()
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.close()


class MySqlClient(Wire):
    """Logs in with a native password; text queries and prepared statements."""

    def __init__(self, server: WireServer, user: bytes = b"root", password: bytes = b"", plugin: bytes = my.NATIVE) -> None:
        super().__init__(server)
        greeting = self.receive()
        assert greeting[0] == 10
        at = greeting.index(b"\0") + 5
        salt = greeting[at : at + 8] + greeting[at + 27 : at + 39]
        flags = my.PROTOCOL_41 | my.SECURE_CONNECTION | my.PLUGIN_AUTH | my.CONNECT_WITH_DB
        answer = native_response(password, salt) if plugin == my.NATIVE else b"x" * 32
        self.send(struct.pack("<IIB23x", flags, 1 << 24, 45) + user + b"\0" + bytes([len(answer)]) + answer + b"db\0" + plugin + b"\0")
        reply = self.receive()
        if reply[:1] == b"\xfe":  # another method
            self.send(native_response(password, reply.split(b"\0")[1]))
            reply = self.receive()
        self.first = reply

    def receive(self):
        head = self.file.read(4)
        self.sequence = head[3] + 1
        return self.file.read(int.from_bytes(head[:3], "little"))

    def send(self, body):
        self.sock.sendall(len(body).to_bytes(3, "little") + bytes([self.sequence % 256]) + body)

    def command(self, code, body=b""):
        self.sequence = 0
        self.send(bytes([code]) + body)

    def columns(self, n):
        out = []
        for _ in range(n):
            data, at, parts = self.receive(), 0, []
            for _ in range(6):
                size, at = my.read_lenenc(data, at)
                parts.append(data[at : at + size])
                at += size
            out.append((parts[4].decode(), data[at + 7]))
        assert self.receive()[0] == 0xFE
        return out

    def result(self, binary=False):
        head = self.receive()
        if head[0] == 0xFF:
            return ("error", struct.unpack_from("<H", head, 1)[0], head[4:9].decode())
        if head[0] == 0:
            affected, at = my.read_lenenc(head, 1)
            last, at = my.read_lenenc(head, at)
            self.status = struct.unpack_from("<H", head, at)[0]
            return ("ok", affected, last)
        columns, rows = self.columns(my.read_lenenc(head, 0)[0]), []
        while True:
            data = self.receive()
            if data[0] == 0xFE and len(data) < 9:
                self.status = struct.unpack_from("<H", data, 3)[0]
                return columns, rows
            rows.append(self.binary(data, columns) if binary else self.text(data))

    @staticmethod
    def text(data):
        at, out = 0, []
        while at < len(data):
            if data[at] == 0xFB:
                out.append(None)
                at += 1
                continue
            size, at = my.read_lenenc(data, at)
            out.append(data[at : at + size])
            at += size
        return tuple(out)

    @staticmethod
    def binary(data, columns):
        nulls, at, out = data[1 : 1 + (len(columns) + 9) // 8], 1 + (len(columns) + 9) // 8, []
        for i, (_, kind) in enumerate(columns):
            if nulls[(i + 2) // 8] >> (i + 2) % 8 & 1:
                out.append(None)
            elif kind in (my.LONGLONG, my.DOUBLE):
                out.append(struct.unpack_from("<q" if kind == my.LONGLONG else "<d", data, at)[0])
                at += 8
            else:
                size, at = my.read_lenenc(data, at)
                out.append(data[at : at + size])
                at += size
        return tuple(out)

    def query(self, sql: str):
        """(columns, rows), or a tuple that begins with ok or error."""
        self.command(my.QUERY, sql.encode())
        return self.result()

    def prepare(self, sql):
        self.command(my.STMT_PREPARE, sql.encode())
        head = self.receive()
        if head[0] == 0xFF:
            return ("error", struct.unpack_from("<H", head, 1)[0])
        key, columns, params = struct.unpack_from("<IHH", head, 1)
        if params:
            self.columns(params)
        return key, self.columns(columns) if columns else []

    def execute(self, key, values):
        body = struct.pack("<IBI", key, 0, 1)
        if values:
            nulls, kinds, data = bytearray((len(values) + 7) // 8), b"", b""
            for i, v in enumerate(values):
                if v is None:
                    nulls[i // 8] |= 1 << i % 8
                    kinds += bytes([6, 0])
                elif isinstance(v, int):
                    kinds += bytes([8, 0])
                    data += struct.pack("<q", v)
                elif isinstance(v, float):
                    kinds += bytes([5, 0])
                    data += struct.pack("<d", v)
                else:
                    kinds += bytes([252 if isinstance(v, bytes) else 253, 0])
                    data += my.string(v if isinstance(v, bytes) else v.encode())
            body += bytes(nulls) + b"\1" + kinds + data
        self.command(my.STMT_EXECUTE, body)
        return self.result(binary=True)


class PostgresClient(Wire):
    """Simple and extended queries."""

    def __init__(self, server: WireServer) -> None:
        super().__init__(server)
        self.sock.sendall(struct.pack(">ii", 8, 80877103))
        assert self.file.read(1) == b"N"
        body = struct.pack(">i", 196608) + b"user\0me\0database\0d\0\0"
        self.sock.sendall(struct.pack(">i", len(body) + 4) + body)
        self.hello = self.until_ready()

    def send(self, kind, body=b""):
        self.sock.sendall(kind + struct.pack(">i", len(body) + 4) + body)

    def message(self):
        kind = self.file.read(1)
        return kind, self.file.read(struct.unpack(">i", self.file.read(4))[0] - 4)

    def until_ready(self):
        out = []
        while True:
            kind, body = self.message()
            if kind == b"Z":
                self.status = body
                return out
            out.append((kind, body))

    @staticmethod
    def row(body):
        (n,), at, out = struct.unpack_from(">h", body), 2, []
        for _ in range(n):
            (size,) = struct.unpack_from(">i", body, at)
            at += 4
            out.append(None if size < 0 else body[at : at + size])
            at += max(size, 0)
        return tuple(out)

    def query(self, sql: str) -> list:
        """Rows as tuples, and a text for each command's end or error."""
        self.send(b"Q", sql.encode() + b"\0")
        out = []
        for kind, body in self.until_ready():
            if kind == b"D":
                out.append(self.row(body))
            elif kind == b"C":
                out.append(body[:-1].decode())
            elif kind == b"E":
                out.append("error " + next(f[1:] for f in body.split(b"\0") if f[:1] == b"C").decode())
            elif kind == b"I":
                out.append("empty")
        return out

    def extended(self, sql, params, oids=(), binary=False, most=0):
        self.send(b"P", b"\0" + sql.encode() + b"\0" + struct.pack(f">h{len(oids)}I", len(oids), *oids))
        self.send(b"D", b"S\0")
        body = b"\0\0" + struct.pack(">hh", 0, len(params))
        for p in params:
            body += struct.pack(">i", -1) if p is None else struct.pack(">i", len(p)) + p
        self.send(b"B", body + struct.pack(">hh", 1, int(binary)))
        self.send(b"D", b"P\0")
        self.send(b"E", b"\0" + struct.pack(">i", most))
        self.send(b"S")
        return self.until_ready()


class TdsClient(Wire):
    """Batches."""

    def __init__(self, server: WireServer) -> None:
        super().__init__(server)
        self.send(tds.PRELOGIN, b"\xff")
        pre = self.receive()
        assert pre[0] == 0
        user = "sa".encode("utf-16-le")
        fixed = struct.pack("<IIIIIIBBBBiI", 94 + len(user), tds.VERSION_74, 4096, 0, 0, 0, 0, 0, 0, 0, 0, 0)
        offsets = struct.pack("<HHHH", 94, 0, 94, 2) + struct.pack("<HH", 94, 0) * 7 + bytes(6) + struct.pack("<HH", 94, 0) * 3 + bytes(4)
        self.send(tds.LOGIN7, (fixed + offsets).ljust(94, b"\0")[:94] + user)
        self.hello = self.receive()

    def send(self, kind, body):
        for at in range(0, max(len(body), 1), 4088):
            part = body[at : at + 4088]
            self.sock.sendall(struct.pack(">BBHHBB", kind, int(at + 4088 >= len(body)), len(part) + 8, 0, 1, 0) + part)

    def receive(self):
        out = b""
        while True:
            _, status, size = struct.unpack(">BBH4x", self.file.read(8))
            out += self.file.read(size - 8)
            if status & 1:
                return out

    def query(self, sql: str) -> list[tuple]:
        """Columns, rows, errors and ends in order."""
        headers = struct.pack("<IIHQI", 22, 18, 2, 0, 1)
        self.send(tds.BATCH, headers + sql.encode("utf-16-le"))
        return self.tokens(self.receive())

    @staticmethod
    def tokens(data):
        out, at, columns = [], 0, []
        while at < len(data):
            token = data[at]
            at += 1
            if token in (tds.DONE, tds.DONEPROC, tds.DONEINPROC):
                status, _, count = struct.unpack_from("<HHQ", data, at)
                at += 12
                out.append(("done", status, count))
            elif token in (tds.ERROR, tds.ENVCHANGE, tds.LOGINACK):
                (size,) = struct.unpack_from("<H", data, at)
                if token == tds.ERROR:
                    out.append(("error", struct.unpack_from("<I", data, at + 2)[0], data[at + 7]))
                elif token == tds.ENVCHANGE:
                    out.append(("env", data[at + 2]))
                at += 2 + size
            elif token == tds.RETURNSTATUS:
                at += 4
            elif token == tds.COLMETADATA:
                (n,), columns = struct.unpack_from("<H", data, at), []
                at += 2
                for _ in range(n):
                    kind = data[at + 6]
                    at += 7
                    if kind in (tds.INTN, tds.FLTN):
                        most, at = data[at], at + 1
                    else:
                        (most,) = struct.unpack_from("<H", data, at)
                        at += 2 + 5 * (kind == tds.NVARCHAR)
                    size = data[at]
                    columns.append((data[at + 1 : at + 1 + 2 * size].decode("utf-16-le"), kind, most))
                    at += 1 + 2 * size
                out.append(("columns", [c[0] for c in columns]))
            elif token == tds.ROW:
                row = []
                for _, kind, most in columns:
                    if kind in (tds.INTN, tds.FLTN):
                        size = data[at]
                        row.append(struct.unpack_from("<q" if kind == tds.INTN else "<d", data, at + 1)[0] if size else None)
                        at += 1 + size
                    else:
                        raw, at = tds._chunks(data, at) if most == 0xFFFF else tds._short(data, at)
                        row.append(None if raw is None else raw.decode("utf-16-le") if kind == tds.NVARCHAR else raw)
                out.append(tuple(row))
            else:
                raise ValueError(f"token {token:#x}")
        return out
