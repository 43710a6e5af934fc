"""From SQL text in a dialect to what the session does with it; the first rule that fits wins.

Metadata questions, transaction control, statements without effect, then DDL and DML in parts, then queries as Spark
SQL.  Results are kept by dialect and text, the least recently used go first; errors are not kept.
"""

from __future__ import annotations

import logging
import threading
from collections import OrderedDict
from dataclasses import dataclass, field

from polygate.dialect import Options, to_spark
from polygate.errors import UnsupportedError
from polygate.lexer import Dialect, Token, lex, significant, split_statements, text_of
from polygate.plans import metadata, statements
from polygate.plans.statements import Kind

log = logging.getLogger("polygate")


@dataclass(frozen=True)
class Translated:
    """kind: query, noop, metadata, transaction, ddl, dml or found_rows; plan holds the parts of all but queries."""

    kind: str
    text: str = ""
    plan: object = None
    params: tuple[int, ...] = ()
    like_params: frozenset[int] = frozenset()
    tokens: tuple[Token, ...] = field(default=(), compare=False)
    count_text: str = ""  # of SQL_CALC_FOUND_ROWS

    @property
    def n_params(self) -> int:
        return max(self.params, default=0)


#: Settings that change nothing here: of MySQL, of T-SQL, and those that PostgreSQL clients send on connecting.
_IGNORED_SET = (
    "NAMES", "CHARACTER", "CHARSET", "TIME_ZONE", "SQL_MODE", "TRANSACTION", "SESSION", "GLOBAL", "LOCAL", "AUTOCOMMIT", "WAIT_TIMEOUT", "FOREIGN_KEY_CHECKS", "UNIQUE_CHECKS",
    "NOCOUNT", "ANSI_NULLS", "QUOTED_IDENTIFIER", "XACT_ABORT", "ANSI_PADDING", "ANSI_WARNINGS", "ANSI_DEFAULTS", "ANSI_NULL_DFLT_ON", "ARITHABORT", "CONCAT_NULL_YIELDS_NULL", "CURSOR_CLOSE_ON_COMMIT", "IMPLICIT_TRANSACTIONS", "LANGUAGE", "DATEFORMAT", "DATEFIRST", "TEXTSIZE", "LOCK_TIMEOUT",
    "CLIENT_ENCODING", "DATESTYLE", "SEARCH_PATH", "EXTRA_FLOAT_DIGITS", "APPLICATION_NAME", "STATEMENT_TIMEOUT", "STANDARD_CONFORMING_STRINGS", "CLIENT_MIN_MESSAGES",
)


def noop(sig: list[Token]) -> str | None:
    """Why a statement needs nothing done, if so; warns where a client may have counted on an effect."""
    if sig[0].is_("SET") and len(sig) > 1:
        body = sig[1:]
        if body[0].kind == "sysvar" or body[0].kind == "word" and body[0].upper.split(".")[0] in _IGNORED_SET:
            name = body[0].value.upper().split(".")[-1]
            if name == "AUTOCOMMIT" and body[-1].text.upper() in ("0", "OFF", "FALSE"):
                log.warning("SET autocommit=0: statements still commit on their own outside BEGIN ... COMMIT")
            return "SET"
    if sig[0].is_("LOCK", "UNLOCK") and len(sig) > 1 and sig[1].is_("TABLES", "TABLE"):
        log.warning("%s TABLES has no effect", sig[0].upper)
        return "LOCK"
    if sig[0].is_("USE") and len(sig) >= 2:
        return "USE"
    return None


def _tail(tokens: list[Token]) -> tuple[list[Token], bool]:
    """A query without ORDER BY, LIMIT, OFFSET and FETCH at depth 0, and whether those held a placeholder."""
    depth = 0
    for i, t in enumerate(tokens):
        depth += t.op("(") - t.op(")")
        if not depth and (t.is_("LIMIT", "FETCH", "OFFSET") or t.is_("ORDER")):
            return tokens[:i], any(x.kind == "param" for x in tokens[i:])
    return tokens, False


def count_of(tokens: list[Token], dialect: Dialect, options: Options | None) -> str:
    """``SELECT count(*)`` over a query without its limits; empty where a dropped placeholder forbids it."""
    body, dropped = _tail(tokens)
    if dropped:
        return ""
    return f"SELECT count(*) AS n FROM ({to_spark(body, dialect, options, named=True).text}) AS q"


def found_rows_column(sig: list[Token]) -> str | None:
    """The column name of a bare ``SELECT FOUND_ROWS() [AS x]``."""
    if len(sig) < 4 or not (sig[0].is_("SELECT") and sig[1].is_("FOUND_ROWS") and sig[2].op("(") and sig[3].op(")")):
        return None
    rest = sig[4:]
    if not rest:
        return text_of(sig[1:4])
    if rest[0].is_("AS"):
        rest = rest[1:]
    return rest[0].value if len(rest) == 1 and rest[0].kind in ("word", "ident", "str") else None


def translate_statement(tokens: list[Token], dialect: Dialect, options: Options | None = None) -> Translated:
    sig = significant(tokens)
    if (q := metadata.detect(tokens)) is not None:
        return Translated("metadata", plan=q)
    if (t := statements.transaction(tokens)) is not None:
        return Translated("transaction", plan=t)
    if (why := noop(sig)) is not None:
        return Translated("noop", why)
    if dialect is Dialect.MYSQL and (name := found_rows_column(sig)) is not None:
        return Translated("found_rows", name)
    if sig[0].is_("VACUUM", "ANALYZE", "REINDEX", "OPTIMIZE"):
        return Translated("maintenance", sig[0].upper)
    kind = statements.classify(tokens)
    if kind is Kind.QUERY:
        e = to_spark(tokens, dialect, options)
        calc = dialect is Dialect.MYSQL and any(t.is_("SQL_CALC_FOUND_ROWS") for t in sig[:4])
        return Translated("query", e.text, None, tuple(e.params), frozenset(e.like_params), tuple(tokens), count_of(tokens, dialect, options) if calc else "")
    if kind in (Kind.MUTATION, Kind.DDL):
        params = sorted({i for i in _ordinals(tokens)})
        return Translated("dml" if kind is Kind.MUTATION else "ddl", text_of(list(tokens)), statements.parse(list(tokens), dialect), tuple(params), tokens=tuple(tokens))
    raise UnsupportedError(f"{sig[0].text} statements are not supported")


def _ordinals(tokens: list[Token]) -> list[int]:
    out, n = [], 0
    for t in tokens:
        if t.kind == "param":
            if t.text == "?":
                n += 1
                out.append(n)
            else:
                out.append(int(t.text[1:]))
    return out


def translate(sql: str, dialect: Dialect, options: Options | None = None) -> list[Translated]:
    """What each statement of ``sql`` comes to, in order."""
    return [translate_statement(s, dialect, options) for s in split_statements(lex(sql, dialect))]


class TranslateCache:
    """The results of :func:`translate` by dialect and text; safe to share between sessions."""

    def __init__(self, capacity: int = 1024) -> None:
        self.capacity, self._kept, self._lock = capacity, OrderedDict(), threading.Lock()
        self.hits = self.misses = 0

    def __len__(self) -> int:
        return len(self._kept)

    def translate(self, sql: str, dialect: Dialect, options: Options | None = None) -> list[Translated]:
        key = (dialect, sql, options.like_ci if options else False)
        with self._lock:
            if key in self._kept:
                self._kept.move_to_end(key)
                self.hits += 1
                return self._kept[key]
            self.misses += 1
        out = translate(sql, dialect, options)
        with self._lock:
            self._kept[key] = out
            while len(self._kept) > self.capacity:
                self._kept.popitem(last=False)
        return out
