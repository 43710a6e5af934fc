"""Errors with the codes that each dialect's clients expect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class EngineError(Exception):
    """An error with a condition that :func:`classify` maps to codes."""

    condition = "other"


class SqlSyntaxError(EngineError):
    condition = "syntax"


class UnsupportedError(EngineError):
    condition = "syntax"


class MissingTable(EngineError):
    condition = "no_table"


class UniqueViolation(EngineError):
    condition = "unique"

    def __init__(self, value: object, key: str) -> None:
        self.value, self.key = value, key
        super().__init__(f"UNIQUE constraint failed: {key}")


class ForeignKeyViolation(EngineError):
    condition = "foreign_key"


class NotNullViolation(EngineError):
    condition = "not_null"


class CheckViolation(EngineError):
    condition = "check"


class BusyError(EngineError):
    condition = "busy"


class ReadOnlyError(EngineError):
    condition = "read_only"


class TooManyPrepared(EngineError):
    condition = "too_many_prepared"


class TooManyConnections(EngineError):
    condition = "too_many_connections"


class AccessDenied(EngineError):
    condition = "denied"


@dataclass(frozen=True)
class MappedError:
    code: int
    sqlstate: str
    message: str


#: condition: (MySQL code, MySQL state, PostgreSQL state)
CODES = {
    "unique": (1062, "23000", "23505"),
    "no_table": (1146, "42S02", "XX000"),
    "foreign_key": (1452, "23000", "23503"),
    "not_null": (1105, "HY000", "23502"),
    "check": (1105, "HY000", "23514"),
    "busy": (1205, "HY000", "55P03"),
    "read_only": (1290, "HY000", "25006"),
    "syntax": (1064, "42000", "XX000"),
    "too_many_prepared": (1461, "42000", "XX000"),
    "too_many_connections": (1040, "08004", "53300"),
    "denied": (1045, "28000", "28P01"),
    "other": (1105, "HY000", "XX000"),
}


def condition_of(e: BaseException) -> str:
    """The condition of one of our errors or of Spark's."""
    if isinstance(e, EngineError):
        return e.condition
    name = (getattr(e, "getCondition", None) or getattr(e, "getErrorClass", lambda: None))() or ""
    if name.startswith(("TABLE_OR_VIEW_NOT_FOUND", "VIEW_NOT_FOUND")):
        return "no_table"
    if name.startswith("PARSE_") or type(e).__name__ == "ParseException":
        return "syntax"
    return "other"


def classify(e: BaseException, dialect: str = "mysql") -> MappedError:
    """Code, SQLSTATE and message for a client of ``dialect``: mysql, postgres, tsql or sqlite."""
    condition = condition_of(e)
    code, my_state, pg_state = CODES[condition]
    message = re.split(r"\n\n?JVM stacktrace|\n== SQL", str(e))[0].strip()
    if dialect == "tsql":
        return MappedError(50000, "S0001", message)
    if dialect == "postgres":
        return MappedError(0, pg_state, message)
    if isinstance(e, UniqueViolation):
        message = f"Duplicate entry '{e.value}' for key '{e.key}' ({e})"
    return MappedError(code, my_state, message)
