"""The tabular data stream of SQL Server, version 7.4: login, batches, sp_executesql and transaction requests.

Columns have four types: 64-bit integer, float, nvarchar and varbinary, of unbounded length where a value needs it.
"""

from __future__ import annotations

import struct

from polygate.errors import EngineError, SqlSyntaxError, classify
from polygate.frontends.wire import Stream, WireServer, command_of
from polygate.lexer import Dialect, Token, lex, significant
from polygate.session import Result, Session

# Fixed values of the protocol: packet types, tokens, data types, status bits.
BATCH, RPC, REPLY, ATTENTION, TRANSACTION, LOGIN7, PRELOGIN = 0x01, 0x03, 0x04, 0x06, 0x0E, 0x10, 0x12
COLMETADATA, ERROR, LOGINACK, ROW, ENVCHANGE, DONE, DONEPROC, DONEINPROC, RETURNSTATUS = 0x81, 0xAA, 0xAD, 0xD1, 0xE3, 0xFD, 0xFE, 0xFF, 0x79
INTN, BITN, FLTN, GUID, BIGVARBINARY, BIGVARCHAR, BIGBINARY, BIGCHAR, NVARCHAR, NCHAR = 0x26, 0x68, 0x6D, 0x24, 0xA5, 0xA7, 0xAD, 0xAF, 0xE7, 0xEF
MORE, HAS_ERROR, HAS_COUNT, ATTENTION_DONE = 0x01, 0x02, 0x10, 0x20
VERSION_74 = 0x74000004
COLLATION = bytes([0x09, 0x04, 0xD0, 0x00, 0x34])
PROGRAM, PACKET = "polygate", 4096
_COMMANDS = {"SELECT": 0xC1, "INSERT": 0xC3, "DELETE": 0xC4, "UPDATE": 0xC5}
_EXECUTESQL = 10


def b_varchar(s: str) -> bytes:
    return bytes([len(s)]) + s.encode("utf-16-le")


def us_varchar(s: str) -> bytes:
    return struct.pack("<H", len(s.encode("utf-16-le")) // 2) + s.encode("utf-16-le")


def done(status: int = 0, command: int = 0, count: int = 0, token: int = DONE) -> bytes:
    return struct.pack("<BHHQ", token, status, command, count)


def error(e: BaseException) -> bytes:
    m = classify(e, "tsql")
    body = struct.pack("<IBB", m.code, 1, 14) + us_varchar(m.message[:4000]) + b_varchar(PROGRAM) + b_varchar("") + struct.pack("<I", 1)
    return struct.pack("<BH", ERROR, len(body)) + body


def env_change(kind: int, new: bytes, old: bytes) -> bytes:
    body = bytes([kind]) + new + old
    return struct.pack("<BH", ENVCHANGE, len(body)) + body


def metadata(columns: list[str], types: list[str], long: list[bool]) -> bytes:
    out = struct.pack("<BH", COLMETADATA, len(columns))
    for c, t, big in zip(columns, types, long, strict=True):
        out += struct.pack("<IH", 0, 1)  # nullable
        if t == "INTEGER":
            out += bytes([INTN, 8])
        elif t == "REAL":
            out += bytes([FLTN, 8])
        elif t == "BLOB":
            out += struct.pack("<BH", BIGVARBINARY, 0xFFFF if big else 8000)
        else:
            out += struct.pack("<BH", NVARCHAR, 0xFFFF if big else 8000) + COLLATION
        out += b_varchar(c[:127])
    return out


def _bytes(v: object) -> bytes:
    return bytes(v) if isinstance(v, (bytes, bytearray)) else str(v).encode("utf-16-le")


def row(values: tuple, types: list[str], long: list[bool]) -> bytes:
    out = bytes([ROW])
    for v, t, big in zip(values, types, long, strict=True):
        if t in ("INTEGER", "REAL"):
            out += b"\0" if v is None else b"\x08" + (struct.pack("<q", int(v)) if t == "INTEGER" else struct.pack("<d", v))
        elif big:
            data = b"" if v is None else _bytes(v)
            out += b"\xff" * 8 if v is None else struct.pack("<Q", len(data)) + (struct.pack("<I", len(data)) + data if data else b"") + struct.pack("<I", 0)
        else:
            out += b"\xff\xff" if v is None else struct.pack("<H", len(_bytes(v))) + _bytes(v)
    return out


def rows_of(r: Result) -> bytes:
    """Column descriptions and rows; a column is unbounded if any value needs it."""
    long = [t in ("TEXT", "BLOB") and any(v is not None and len(_bytes(v)) > 8000 for v in col) for t, col in zip(r.types, zip(*r.rows) if r.rows else [()] * len(r.types))]
    return metadata(r.columns, r.types, long) + b"".join(row(x, r.types, long) for x in r.rows)


def parameters(data: bytes, at: int) -> list[tuple[str, object]]:
    """Names and values of a remote call's parameters."""
    out: list[tuple[str, object]] = []
    while at < len(data) and data[at] not in (0x80, 0xFF):
        n = data[at]
        name = data[at + 1 : at + 1 + 2 * n].decode("utf-16-le")
        at += 2 + 2 * n  # the status byte too
        kind = data[at]
        at += 1
        value: object = None
        if kind in (INTN, BITN, FLTN, GUID):
            size = data[at + 1]
            raw = data[at + 2 : at + 2 + size]
            at += 2 + size
            if size:
                value = bool(raw[0]) if kind == BITN else struct.unpack("<f" if size == 4 else "<d", raw)[0] if kind == FLTN else raw.hex() if kind == GUID else int.from_bytes(raw, "little", signed=size > 1)
        elif kind in (BIGVARBINARY, BIGVARCHAR, BIGBINARY, BIGCHAR, NVARCHAR, NCHAR):
            (most,) = struct.unpack_from("<H", data, at)
            at += 2 + (5 if kind in (BIGVARCHAR, BIGCHAR, NVARCHAR, NCHAR) else 0)
            raw, at = _chunks(data, at) if most == 0xFFFF else _short(data, at)
            if raw is not None:
                value = raw.decode("utf-16-le") if kind in (NVARCHAR, NCHAR) else raw.decode("latin-1") if kind in (BIGVARCHAR, BIGCHAR) else raw
        elif kind == 0x1F:  # NULL
            pass
        elif kind in (0x30, 0x32, 0x34, 0x38, 0x7F, 0x3B, 0x3E):
            code = {0x30: "<B", 0x32: "<?", 0x34: "<h", 0x38: "<i", 0x7F: "<q", 0x3B: "<f", 0x3E: "<d"}[kind]
            (value,) = struct.unpack_from(code, data, at)
            at += struct.calcsize(code)
        else:
            raise EngineError(f"unsupported parameter type 0x{kind:02x}")
        out.append((name, value))
    return out


def _short(data: bytes, at: int) -> tuple[bytes | None, int]:
    (size,) = struct.unpack_from("<H", data, at)
    return (None, at + 2) if size == 0xFFFF else (data[at + 2 : at + 2 + size], at + 2 + size)


def _chunks(data: bytes, at: int) -> tuple[bytes | None, int]:
    (total,) = struct.unpack_from("<Q", data, at)
    at += 8
    if total == 0xFFFFFFFFFFFFFFFF:
        return None, at
    out = b""
    while True:
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        if not size:
            return out, at
        out += data[at : at + size]
        at += size


def bound(sql: str, named: list[tuple[str, object]]) -> tuple[str, list]:
    """Text whose ``@name`` variables are numbered placeholders, and their values in that order."""
    by = {n.lower(): v for n, v in named}
    out, values, at = [], [], {}
    for t in lex(sql, Dialect.TSQL):
        name = t.text.lower()
        if t.kind == "word" and name in by:
            if name not in at:
                values.append(by[name])
                at[name] = len(values)
            t = Token("param", f"?{at[name]}")
        out.append(t.text)
    return "".join(out), values


class _Client:
    def __init__(self, stream: Stream) -> None:
        self.stream, self.session = stream, None
        self.transactions = 0

    def receive(self) -> tuple[int, bytes]:
        body = b""
        while True:
            kind, status, size = struct.unpack(">BBH4x", self.stream.read(8))
            body += self.stream.read(size - 8)
            if status & 1:
                return kind, body

    def send(self, body: bytes) -> None:
        part = PACKET - 8
        n = max(1, -(-len(body) // part))
        for i in range(n):
            data = body[i * part : (i + 1) * part]
            self.stream.write(struct.pack(">BBHHBB", REPLY, int(i == n - 1), len(data) + 8, 0, (i + 1) % 256, 0) + data)
        self.stream.flush()


class TdsServer(WireServer):
    dialect = Dialect.TSQL

    def converse(self, stream: Stream) -> None:
        c = _Client(stream)
        kind, body = c.receive()
        if kind == PRELOGIN:
            options = ((0, bytes([16, 0, 0, 0, 0, 0])), (1, b"\x02"), (2, b"\0"), (3, b""), (4, b"\0"))  # version, no encryption, instance, thread, one result at a time
            at, head, data = 5 * len(options) + 1, b"", b""
            for code, value in options:
                head += struct.pack(">BHH", code, at + len(data), len(value))
                data += value
            c.send(head + b"\xff" + data)
            kind, body = c.receive()
        if kind != LOGIN7:
            return
        user = self._field(body, 40)
        try:
            c.session = self.connect(self.dialect, user)
        except Exception as e:
            c.send(error(e) + done(HAS_ERROR))
            return
        try:
            ack = bytes([1]) + struct.pack(">I", VERSION_74) + b_varchar(PROGRAM) + bytes([16, 0, 0, 0])
            c.send(
                env_change(1, b_varchar("main"), b_varchar("main"))
                + env_change(4, b_varchar(str(PACKET)), b_varchar(str(PACKET)))
                + struct.pack("<BH", LOGINACK, len(ack)) + ack + done()
            )
            while True:
                kind, body = c.receive()
                if kind == ATTENTION:
                    c.send(done(ATTENTION_DONE))
                elif kind == BATCH:
                    (size,) = struct.unpack_from("<I", body)
                    c.send(self._run(c, body[size:].decode("utf-16-le")))
                elif kind == RPC:
                    c.send(self._call(c, body))
                elif kind == TRANSACTION:
                    c.send(self._transaction(c, body))
                else:
                    c.send(error(EngineError(f"unsupported request 0x{kind:02x}")) + done(HAS_ERROR))
        finally:
            c.session.close()

    @staticmethod
    def _field(body: bytes, at: int) -> str:
        start, size = struct.unpack_from("<HH", body, at)
        return body[start : start + 2 * size].decode("utf-16-le")

    @staticmethod
    def _env(c: _Client, before: bool, after: bool) -> bytes:
        """Tells of a transaction that began or ended."""
        if before == after:
            return b""
        c.transactions += after
        mark = b"\x08" + struct.pack("<Q", c.transactions)
        return env_change(8, mark, b"\0") if after else env_change(9, b"\0", mark)

    def _run(self, c: _Client, text: str) -> bytes:
        out = b""
        try:
            if not significant(lex(text, Dialect.TSQL)):
                return done()
            results = list_until_error(c.session, text)
            for i, (t, r, before, after) in enumerate(results):
                name = command_of(t)
                more = MORE if i < len(results) - 1 or results.failed else 0
                out += self._env(c, before, after)
                if r.columns:
                    out += rows_of(r) + done(HAS_COUNT | more, _COMMANDS.get(name, 0), len(r.rows))
                else:
                    out += done((HAS_COUNT if r.kind == "dml" else 0) | more, _COMMANDS.get(name, 0), r.affected)
            if results.failed is not None:
                out += error(results.failed) + done(HAS_ERROR)
        except Exception as e:
            out += error(e) + done(HAS_ERROR)
        return out

    def _call(self, c: _Client, body: bytes) -> bytes:
        try:
            (at,) = struct.unpack_from("<I", body)
            (n,) = struct.unpack_from("<H", body, at)
            at += 2
            if n == 0xFFFF:
                (number,) = struct.unpack_from("<H", body, at)
                name, at = "sp_executesql" if number == _EXECUTESQL else f"procedure {number}", at + 2
            else:
                name, at = body[at : at + 2 * n].decode("utf-16-le"), at + 2 * n
            given = parameters(body, at + 2)
            if name.lower().rpartition(".")[2] != "sp_executesql":
                sql, values = f"EXEC {name} " + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for _, v in given), []
            elif not given or not isinstance(given[0][1], str):
                raise SqlSyntaxError("sp_executesql needs a statement")
            else:
                sql, values = bound(given[0][1], given[2:])
            r = c.session.query(sql, values)
            body = rows_of(r) + done(HAS_COUNT, 0xC1, len(r.rows), DONEINPROC) if r.columns else done(HAS_COUNT if r.kind == "dml" else 0, 0, r.affected, DONEINPROC)
            return body + struct.pack("<Bi", RETURNSTATUS, 0) + done(0, 0, 0, DONEPROC)
        except Exception as e:
            return error(e) + done(HAS_ERROR, 0, 0, DONEPROC)

    def _transaction(self, c: _Client, body: bytes) -> bytes:
        (at,) = struct.unpack_from("<I", body)
        (kind,) = struct.unpack_from("<H", body, at)
        text = {5: "BEGIN TRANSACTION", 7: "COMMIT", 8: "ROLLBACK"}.get(kind)
        if text is None:
            return error(EngineError(f"unsupported transaction request {kind}")) + done(HAS_ERROR)
        return self._run(c, text)


class _Results(list):
    failed: BaseException | None = None


def list_until_error(session: Session, text: str) -> _Results:
    """(statement, result, in a transaction before, and after) of each statement up to the first that fails."""
    out = _Results()
    try:
        before = session.in_transaction
        for t, r in session.each(text):
            out.append((t, r, before, session.in_transaction))
            before = session.in_transaction
    except Exception as e:
        out.failed = e
    return out
