"""The PostgreSQL protocol, version 3: simple queries, and parse, bind, describe, execute.

Values go as text, or in binary where the client asks for it.  Columns have four types: int8, float8, text and bytea.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

from polygate.errors import EngineError, SqlSyntaxError, classify
from polygate.frontends.wire import Stream, WireServer, command_of
from polygate.lexer import Dialect
from polygate.plans.translate import Translated
from polygate.session import Prepared, Result, Session

SSL, GSS, CANCEL, VERSION_3 = 80877103, 80877104, 80877102, 196608
#: Type identifiers of the columns, and their sizes.
OIDS = {"INTEGER": (20, 8), "REAL": (701, 8), "TEXT": (25, -1), "BLOB": (17, -1)}
_INTEGERS, _FLOATS = {20: ">q", 21: ">h", 23: ">i", 26: ">I"}, {700: ">f", 701: ">d"}
_PARAMETERS = {"server_version": "15.0 (polygate)", "server_encoding": "UTF8", "client_encoding": "UTF8", "DateStyle": "ISO, MDY", "integer_datetimes": "on", "standard_conforming_strings": "on", "TimeZone": "UTC"}


@dataclass
class _Statement:
    plan: Prepared | None  # None for empty text
    oids: list[int]


@dataclass
class _Portal:
    statement: _Statement
    params: list
    formats: list[int]
    result: Result | None = None
    at: int = 0


@dataclass
class _Client:
    session: Session
    stream: Stream
    statements: dict[str, _Statement] = field(default_factory=dict)
    portals: dict[str, _Portal] = field(default_factory=dict)

    def send(self, kind: bytes, body: bytes = b"") -> None:
        self.stream.write(kind + struct.pack(">i", len(body) + 4) + body)

    def ready(self) -> None:
        self.send(b"Z", b"T" if self.session.in_transaction else b"I")
        self.stream.flush()

    def error(self, e: BaseException) -> None:
        m = classify(e, "postgres")
        code = m.sqlstate
        self.send(b"E", b"".join(k + v.encode() + b"\0" for k, v in ((b"S", "ERROR"), (b"V", "ERROR"), (b"C", code), (b"M", m.message))) + b"\0")


def _cstring(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode(), end + 1


def encode(v: object, binary: bool) -> bytes | None:
    """A value of a row; None for NULL."""
    if v is None:
        return None
    if isinstance(v, (bytes, bytearray)):
        return bytes(v) if binary else b"\\x" + bytes(v).hex().encode()
    if isinstance(v, (bool, int)):
        return struct.pack(">q", int(v)) if binary else str(int(v)).encode()
    if isinstance(v, float):
        return struct.pack(">d", v) if binary else {"inf": "Infinity", "-inf": "-Infinity", "nan": "NaN"}.get(repr(v), repr(v)).encode()
    return str(v).encode()


def decode(data: bytes | None, oid: int, binary: bool) -> object:
    """A parameter by its declared type; undeclared text stays text."""
    if data is None:
        return None
    if binary:
        if oid in _INTEGERS:
            return struct.unpack(_INTEGERS[oid], data)[0]
        if oid in _FLOATS:
            return struct.unpack(_FLOATS[oid], data)[0]
        if oid == 16:
            return data != b"\0"
        return data if oid == 17 else data.decode()
    text = data.decode()
    if oid in _INTEGERS:
        return int(text)
    if oid in _FLOATS or oid == 1700:
        return float(text)
    if oid == 16:
        return text.lower() in ("t", "true", "1", "on", "yes", "y")
    if oid == 17:
        return bytes.fromhex(text[2:]) if text.startswith("\\x") else data
    return text


def _described(columns: list[str], types: list[str], formats: list[int]) -> bytes:
    out = struct.pack(">h", len(columns))
    for i, (c, t) in enumerate(zip(columns, types, strict=True)):
        oid, size = OIDS[t]
        out += c.encode() + b"\0" + struct.pack(">ihihih", 0, 0, oid, size, -1, _format(formats, i))
    return out


def _format(formats: list[int], i: int) -> int:
    return 0 if not formats else formats[0] if len(formats) == 1 else formats[i]


def _tag(t: Translated, r: Result) -> bytes:
    name = command_of(t)
    n = len(r.rows) if r.columns and name == "SELECT" else r.affected
    tag = f"{name} 0 {n}" if name == "INSERT" else f"{name} {n}" if name in ("SELECT", "UPDATE", "DELETE") else name
    return tag.encode() + b"\0"


class PostgresServer(WireServer):
    dialect = Dialect.POSTGRES

    def converse(self, stream: Stream) -> None:
        while True:
            size, code = struct.unpack(">ii", stream.read(8))
            rest = stream.read(size - 8)
            if code in (SSL, GSS):
                stream.write(b"N")
                stream.flush()
                continue
            break
        if code == CANCEL:
            return
        probe = _Client(None, stream)
        if code != VERSION_3:
            probe.error(EngineError("unsupported protocol version"))
            stream.flush()
            return
        words = rest.split(b"\0")
        given = dict(zip(words[::2], words[1::2]))
        try:
            session = self.connect(self.dialect, given.get(b"user", b"").decode())
        except Exception as e:
            probe.error(e)
            stream.flush()
            return
        c = _Client(session, stream)
        try:
            c.send(b"R", struct.pack(">i", 0))
            for k, v in _PARAMETERS.items():
                c.send(b"S", k.encode() + b"\0" + v.encode() + b"\0")
            c.send(b"K", struct.pack(">ii", 1, 1))
            c.ready()
            self._serve(c)
        finally:
            session.close()

    def _serve(self, c: _Client) -> None:
        skipping = False  # after an error in the extended protocol, up to Sync
        while True:
            kind = c.stream.read(1)
            (size,) = struct.unpack(">i", c.stream.read(4))
            body = c.stream.read(size - 4)
            if kind == b"X":
                return
            if kind == b"S":
                skipping = False
                c.ready()
                continue
            if skipping:
                continue
            if kind == b"Q":
                self._simple(c, body[:-1].decode())
                c.ready()
                continue
            act = {b"P": self._parse, b"B": self._bind, b"D": self._describe, b"E": self._execute, b"C": self._close}.get(kind)
            try:
                if kind == b"H":
                    c.stream.flush()
                elif act is None:
                    raise EngineError(f"unsupported message {kind!r}")
                else:
                    act(c, body)
            except Exception as e:
                c.error(e)
                skipping = True

    def _simple(self, c: _Client, text: str) -> None:
        try:
            empty = True
            for t, r in c.session.each(text, paged=True):
                empty = False
                if r.columns:
                    c.send(b"T", _described(r.columns, r.types, []))
                    self._rows(c, r.rows, [])
                c.send(b"C", _tag(t, r))
            if empty:
                c.send(b"I")
        except Exception as e:
            c.error(e)

    @staticmethod
    def _rows(c: _Client, rows: Iterable[tuple], formats: list[int]) -> None:
        for row in rows:
            body = struct.pack(">h", len(row))
            for i, v in enumerate(row):
                data = encode(v, _format(formats, i) == 1)
                body += struct.pack(">i", -1) if data is None else struct.pack(">i", len(data)) + data
            c.send(b"D", body)

    def _parse(self, c: _Client, body: bytes) -> None:
        name, at = _cstring(body, 0)
        sql, at = _cstring(body, at)
        (n,) = struct.unpack_from(">h", body, at)
        oids = list(struct.unpack_from(f">{n}I", body, at + 2))
        if name in c.statements:
            self._forget(c, name)
        c.statements[name] = _Statement(c.session.prepare(sql) if sql.strip(" \t\n;") else None, oids)
        c.send(b"1")

    @staticmethod
    def _forget(c: _Client, name: str) -> None:
        old = c.statements.pop(name, None)
        if old is not None and old.plan is not None:
            c.session.close_prepared(old.plan)

    def _bind(self, c: _Client, body: bytes) -> None:
        portal, at = _cstring(body, 0)
        name, at = _cstring(body, at)
        if name not in c.statements:
            raise EngineError(f"prepared statement {name!r} does not exist")
        s = c.statements[name]
        (n,) = struct.unpack_from(">h", body, at)
        formats = list(struct.unpack_from(f">{n}h", body, at + 2))
        at += 2 + 2 * n
        (n,) = struct.unpack_from(">h", body, at)
        at += 2
        params = []
        for i in range(n):
            (size,) = struct.unpack_from(">i", body, at)
            at += 4
            data = None if size < 0 else body[at : at + size]
            at += max(size, 0)
            try:
                params.append(decode(data, s.oids[i] if i < len(s.oids) else 0, _format(formats, i) == 1))
            except (ValueError, struct.error) as e:
                raise SqlSyntaxError(f"parameter ${i + 1}: {e}") from None
        (n,) = struct.unpack_from(">h", body, at)
        c.portals[portal] = _Portal(s, params, list(struct.unpack_from(f">{n}h", body, at + 2)))
        c.send(b"2")

    def _describe(self, c: _Client, body: bytes) -> None:
        name, _ = _cstring(body, 1)
        if body[:1] == b"S":
            if name not in c.statements:
                raise EngineError(f"prepared statement {name!r} does not exist")
            s, formats = c.statements[name], []
            n = s.plan.n_params if s.plan else 0
            oids = [(s.oids[i] if i < len(s.oids) else 0) or 25 for i in range(n)]
            c.send(b"t", struct.pack(f">h{n}I", n, *oids))
        else:
            if name not in c.portals:
                raise EngineError(f"portal {name!r} does not exist")
            s, formats = c.portals[name].statement, c.portals[name].formats
        columns, types = ([], []) if s.plan is None else c.session.shape_of(s.plan.plan)
        if columns:
            c.send(b"T", _described(columns, types, formats))
        else:
            c.send(b"n")

    def _execute(self, c: _Client, body: bytes) -> None:
        name, at = _cstring(body, 0)
        (most,) = struct.unpack_from(">i", body, at)
        if name not in c.portals:
            raise EngineError(f"portal {name!r} does not exist")
        p = c.portals[name]
        if p.statement.plan is None:
            c.send(b"I")
            return
        if p.result is None:
            p.result = c.session.execute_prepared(p.statement.plan, p.params)
        end = p.at + most if most > 0 else len(p.result.rows)
        self._rows(c, p.result.rows[p.at : end], p.formats)
        p.at = end
        if end < len(p.result.rows):
            c.send(b"s")
        else:
            c.send(b"C", _tag(p.statement.plan.plan, p.result))

    def _close(self, c: _Client, body: bytes) -> None:
        name, _ = _cstring(body, 1)
        if body[:1] == b"S":
            self._forget(c, name)
        else:
            c.portals.pop(name, None)
        c.send(b"3")
