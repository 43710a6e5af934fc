"""Scalar functions that a dialect spells otherwise, or that ask for the state of the session.

Each handler gets the call's arguments as Spark SQL and returns Spark SQL.  Values of the session are named parameters,
bound on execution, so the rewritten text can be cached.
"""

from __future__ import annotations

from collections.abc import Callable

from polygate.errors import UnsupportedError
from polygate.lexer import Dialect

SERVER_VERSION = "8.0.36-polygate"
NOW = "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')"
TODAY = "date_format(current_date(), 'yyyy-MM-dd')"
LAST_ID, CHANGES = ":__last_insert_id", ":__row_count"

Handler = Callable[[list[str], str], str | None]


def _none(text: str) -> Handler:
    """A constant, whatever the (few) arguments."""
    return lambda args, name: text


def _last_id(args: list[str], name: str) -> str:
    if args:
        raise UnsupportedError("LAST_INSERT_ID() with an argument is not supported")
    return LAST_ID


def _isnull(args: list[str], name: str) -> str | None:
    return f"ifnull({args[0]}, {args[1]})" if len(args) == 2 else None


def _part(part: str) -> Handler:
    return lambda args, name: f"CAST({part}({args[0]}) AS BIGINT)" if len(args) == 1 else None


def _week(args: list[str], name: str) -> str:
    raise UnsupportedError("WEEK() is not supported: its numbering differs from Spark's weekofyear()")


def _unix(args: list[str], name: str) -> str:
    return f"CAST(unix_timestamp({', '.join(args)}) AS STRING)" if args else "CAST(unix_timestamp() AS STRING)"


#: For all dialects.
COMMON: dict[str, Handler] = {
    **{f: _none(NOW) for f in ("NOW", "CURRENT_TIMESTAMP", "GETDATE", "GETUTCDATE")},
    **{f: _none(TODAY) for f in ("CURDATE", "CURRENT_DATE")},
    "UNIX_TIMESTAMP": _unix,
    "ISNULL": _isnull,
    "LAST_INSERT_ID": _last_id,
    "LAST_INSERT_ROWID": _last_id,
    "ROW_COUNT": _none(CHANGES),
    "CHANGES": _none(CHANGES),
    **{f: (lambda args, name: None if args else "'main'") for f in ("DATABASE", "SCHEMA")},
    "VERSION": lambda args, name: None if args else f"'{SERVER_VERSION}'",
    "FOUND_ROWS": _none("0"),
    **{f: (lambda args, name: None if args else "'root@localhost'") for f in ("USER", "CURRENT_USER", "SESSION_USER", "SYSTEM_USER")},
    "CONNECTION_ID": _none("0"),
    "NEWID": _none("replace(uuid(), '-', '')"),
    "REGEXP": lambda args, name: f"({args[1]} RLIKE {args[0]})" if len(args) == 2 else None,
}
#: For one dialect.
OWN: dict[Dialect, dict[str, Handler]] = {
    Dialect.MYSQL: {"YEAR": _part("year"), "MONTH": _part("month"), "DAYOFMONTH": _part("day"), "DAY": _part("day"), "DAYOFWEEK": _part("dayofweek"), "DAYOFYEAR": _part("dayofyear"), "WEEK": _week},
    Dialect.POSTGRES: {},
    Dialect.TSQL: {},
    Dialect.SQLITE: {},
}
#: Words that are calls without parentheses.
BARE = {"CURRENT_TIMESTAMP": NOW, "CURRENT_DATE": TODAY}

#: ``@@name``: what metadata queries and expressions give; others are NULL.  Fixed values: clients compare some of them.
VARIABLES: dict[str, str] = {
    "max_allowed_packet": "67108864", "wait_timeout": "28800", "interactive_timeout": "28800", "net_write_timeout": "60", "net_read_timeout": "30",
    "socket": "'/tmp/polygate.sock'", "character_set_client": "'utf8mb4'", "character_set_connection": "'utf8mb4'", "character_set_results": "'utf8mb4'",
    "character_set_server": "'utf8mb4'", "collation_connection": "'utf8mb4_general_ci'", "collation_server": "'utf8mb4_general_ci'",
    "version": f"'{SERVER_VERSION}'", "version_comment": "'polygate'", "sql_mode": "''", "lower_case_table_names": "0", "autocommit": "1",
    "transaction_isolation": "'SERIALIZABLE'", "tx_isolation": "'SERIALIZABLE'", "identity": LAST_ID, "rowcount": CHANGES,
}


def variable(name: str) -> str:
    name = name.lower()
    for prefix in ("session.", "global."):
        name = name.removeprefix(prefix)
    return VARIABLES.get(name, "CAST(NULL AS STRING)")


def rewrite(name: str, args: list[str], dialect: Dialect) -> str | None:
    """Spark SQL for a call, or None to leave it as it is."""
    handler = OWN[dialect].get(name) or COMMON.get(name)
    return handler(args, name) if handler else None


#: Type names in casts that Spark doesn't have, or has with another meaning.
CAST_TYPES = {
    "TEXT": "STRING", "VARCHAR": "STRING", "NVARCHAR": "STRING", "CHAR": "STRING", "NCHAR": "STRING", "CHARACTER": "STRING", "CLOB": "STRING", "UUID": "STRING", "JSON": "STRING", "JSONB": "STRING", "UNIQUEIDENTIFIER": "STRING",
    "SIGNED": "BIGINT", "UNSIGNED": "BIGINT", "INT8": "BIGINT", "INT4": "INT", "INT2": "SMALLINT", "SERIAL": "BIGINT", "BIT": "BIGINT",
    "REAL": "DOUBLE", "FLOAT8": "DOUBLE", "FLOAT4": "FLOAT", "MONEY": "DOUBLE", "BYTEA": "BINARY", "BLOB": "BINARY", "VARBINARY": "BINARY", "BOOL": "BOOLEAN", "DATETIME": "TIMESTAMP", "DATETIME2": "TIMESTAMP",
}
