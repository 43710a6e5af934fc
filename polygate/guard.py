"""Who may connect, what a tenant may say, and how many may write."""

from __future__ import annotations

import hashlib
import hmac
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from polygate.errors import AccessDenied, BusyError, SqlSyntaxError, TooManyConnections
from polygate.lexer import Dialect, Token, lex, significant, split_statements

# --- tenant screen --------------------------------------------------------------------------------------------------

_WORDS = {"ATTACH", "DETACH"}
_PRAGMAS = {"writable_schema", "temp_store_directory", "data_store_directory"}
#: Spark's own ways to files and code outside the session's tables.
_SPARK_WORDS = {"ADD", "LIST", "SET", "RESET", "LOAD", "CACHE", "REFRESH", "MSCK", "IMPORT", "EXPORT"}
_FORMATS = {"PARQUET", "CSV", "JSON", "ORC", "TEXT", "BINARYFILE", "AVRO", "DELTA", "ICEBERG", "JDBC", "FILE"}


def _refuse(what: str) -> None:
    raise AccessDenied(f"not authorized: {what}")


def _check(sig: list[Token]) -> None:
    """One statement; EXPLAIN in front of it changes nothing."""
    while sig and sig[0].is_("EXPLAIN"):
        sig = sig[1:]
        while sig and sig[0].is_("QUERY", "PLAN", "EXTENDED", "CODEGEN", "COST", "FORMATTED", "ANALYZE"):
            sig = sig[1:]
    if not sig:
        return
    first = sig[0].upper
    if first in _WORDS:
        _refuse(first)
    if first == "VACUUM" and len(sig) > 1:
        _refuse("VACUUM with an argument")
    if first == "PRAGMA":
        for t in sig[1:]:
            if t.op("=", "("):
                break
            if t.value.lower() in _PRAGMAS:
                _refuse(f"PRAGMA {t.value}")
    if first in _SPARK_WORDS and not (first == "SET" and len(sig) > 1 and (sig[1].kind == "sysvar" or sig[1].kind == "word" and "." not in sig[1].text and not (len(sig) > 2 and sig[2].op(".")))):
        _refuse(first)
    words = [t.upper for t in sig]
    for i, t in enumerate(sig):
        nxt = sig[i + 1] if i + 1 < len(sig) else Token("op", ";")
        after = sig[i + 2] if i + 2 < len(sig) else Token("op", ";")
        if t.kind in ("word", "ident") and t.value.upper() in _FORMATS and nxt.op(".") and after.kind == "ident":
            _refuse(f"{t.value}.`path`")
        if t.is_("LOCATION") and nxt.kind == "str" and first in ("CREATE", "ALTER"):
            _refuse("LOCATION")
        if t.is_("DIRECTORY") and "OVERWRITE" in words:
            _refuse("INSERT OVERWRITE DIRECTORY")
        if t.is_("FUNCTION") and first in ("CREATE", "DROP"):
            _refuse("CREATE FUNCTION")
        if t.is_("REFLECT", "JAVA_METHOD", "TRY_REFLECT") and nxt.op("("):
            _refuse(t.value)
        if t.is_("TRANSFORM") and nxt.op("(") and "USING" in words:
            _refuse("TRANSFORM")


def screen_sql(sql: str, dialect: Dialect = Dialect.SQLITE) -> None:
    """Raises for text that would reach beyond the session's own tables, and for text that isn't whole."""
    try:
        parts = split_statements(lex(sql, dialect))
    except SqlSyntaxError:
        raise SqlSyntaxError("malformed SQL") from None
    for s in parts:
        _check(significant(s))


def screened(dialect: Dialect) -> Callable[[str], None]:
    """A session's ``screen``."""
    return lambda sql: screen_sql(sql, dialect)


# --- authentication -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class AuthRequest:
    user: str
    salt: bytes = b""
    response: bytes = b""
    database: str | None = None


def password_hash(password: bytes) -> bytes:
    """SHA-1 of SHA-1: what a server of the native method keeps."""
    return hashlib.sha1(hashlib.sha1(password).digest()).digest()


def native_response(password: bytes, salt: bytes) -> bytes:
    """What a client answers to a salt; empty for an empty password."""
    if not password:
        return b""
    inner = hashlib.sha1(password).digest()
    mask = hashlib.sha1(salt + password_hash(password)).digest()
    return bytes(a ^ b for a, b in zip(inner, mask))


def verify(stored: bytes, salt: bytes, response: bytes) -> bool:
    """Whether a response shows the password of a stored hash, compared in constant time."""
    if len(response) != 20:
        return not response and hmac.compare_digest(stored, password_hash(b""))
    mask = hashlib.sha1(salt + stored).digest()
    inner = bytes(a ^ b for a, b in zip(response, mask))
    return hmac.compare_digest(hashlib.sha1(inner).digest(), stored)


def authenticate(authenticator: Callable[[AuthRequest], object | None], request: AuthRequest) -> object:
    """What the authenticator gives the user (a session factory), or AccessDenied."""
    out = authenticator(request)
    if out is None:
        raise AccessDenied(f"Access denied for user '{request.user}'")
    return out


# --- connections and writers ----------------------------------------------------------------------------------------


class ConnectionLimiter:
    """At most ``most`` slots at a time, 0 for any number; a slot is freed when its context ends."""

    def __init__(self, most: int = 0) -> None:
        self.most, self.used, self._lock = most, 0, threading.Lock()

    def try_acquire(self) -> _Slot | None:
        with self._lock:
            if self.most and self.used >= self.most:
                return None
            self.used += 1
            return _Slot(self)

    def acquire(self) -> _Slot:
        slot = self.try_acquire()
        if slot is None:
            raise TooManyConnections("Too many connections")
        return slot


class _Slot:
    def __init__(self, limiter: ConnectionLimiter) -> None:
        self._limiter = limiter

    def release(self) -> None:
        if self._limiter is not None:
            with self._limiter._lock:
                self._limiter.used -= 1
            self._limiter = None

    def __enter__(self) -> _Slot:
        return self

    def __exit__(self, *exc: object) -> None:
        self.release()


class WriteAdmission:
    """A number of write permits, given first come first served.

    A session takes one at its first write and keeps it to the end of its transaction; reads and COMMIT never wait.  A
    wait beyond ``timeout`` seconds raises BusyError.
    """

    def __init__(self, permits: int = 1, timeout: float = 30.0) -> None:
        self.free, self.timeout = permits, timeout
        self._held: set[int] = set()
        self._queue: deque[object] = deque()
        self._cond = threading.Condition()

    def admit(self, session: object) -> object:
        with self._cond:
            if id(session) in self._held:
                return self
            me, end = object(), time.monotonic() + self.timeout
            self._queue.append(me)
            try:
                while not (self.free and self._queue[0] is me):
                    left = end - time.monotonic()
                    if left <= 0 or not self._cond.wait(left):
                        if not (self.free and self._queue[0] is me):
                            raise BusyError("database is locked")
                self.free -= 1
                self._held.add(id(session))
            finally:
                self._queue.remove(me)
                self._cond.notify_all()
            return self

    def release(self, session: object) -> None:
        with self._cond:
            if id(session) in self._held:
                self._held.remove(id(session))
                self.free += 1
                self._cond.notify_all()


#: First words of statements after which a session isn't reused: they may leave settings, other databases or temporary tables.
DIRTY = frozenset({"ATTACH", "DETACH", "PRAGMA", "SET", "LOAD", "REINDEX", "ANALYZE", "EXEC", "DECLARE", "USE"})


def leaves_traces(text: str, dialect: Dialect) -> bool:
    """Whether any statement of a text may leave something in a session; what can't be read counts as one."""
    try:
        for part in split_statements(lex(text, dialect)):
            words = [t.upper for t in significant(part)[:4]]
            if words[:1] and words[0] in DIRTY or words[:1] == ["CREATE"] and {"TEMP", "TEMPORARY"} & set(words[1:]):
                return True
    except SqlSyntaxError:
        return True
    return False


class SessionPool:
    """Sessions for reuse: one is kept only if it ended clean, outside a transaction, with settings as they were, and ran no
    statement that leaves traces."""

    def __init__(self, factory: Callable[[], object], size: int = 8) -> None:
        self.factory, self.size = factory, size
        self._idle: list[object] = []
        self._lock = threading.Lock()

    def checkout(self) -> object:
        with self._lock:
            if self._idle:
                return self._idle.pop()
        session = self.factory()
        session._pool_mark, session._pool_dirty = self._fingerprint(session), False
        screen = session.screen

        def watch(text: str) -> None:
            session._pool_dirty |= leaves_traces(text, session.dialect)
            if screen is not None:
                screen(text)

        session.screen = watch
        return session

    @staticmethod
    def _fingerprint(session) -> tuple:
        return tuple(sorted((r.key, r.value) for r in session.spark.sql("SET").collect()))

    def park(self, session) -> bool:
        """Whether the session was kept."""
        clean = not session.in_transaction and not getattr(session, "_pool_dirty", True) and getattr(session, "_pool_mark", None) == self._fingerprint(session)
        session.reset()
        with self._lock:
            if clean and len(self._idle) < self.size:
                self._idle.append(session)
                return True
        session.close()
        return False
