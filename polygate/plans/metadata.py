"""Questions about the catalog in each dialect's words, answered from the catalog's tables.

Forms are recognised by tokens, so names in strings don't count, a semicolon or blanks don't matter, and LIKE filters
hold.  Canned forms give their fixed columns; other queries over ``information_schema`` run as SQL over its views.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from polygate.dialect import like_pattern
from polygate.functions import scalar
from polygate.lexer import Token, significant, value_of


@dataclass(frozen=True)
class MetadataQuery:
    kind: str
    table: str = ""
    like: str | None = None
    names: tuple[str, ...] = field(default=())


def _equals(sig: list[Token], column: str) -> str | None:
    """The string that ``column = '...'`` compares with."""
    for i in range(len(sig) - 2):
        if sig[i].kind in ("word", "ident") and sig[i].value.upper() == column and sig[i + 1].op("=") and sig[i + 2].kind == "str":
            return value_of(sig[i + 2])
    return None


def _dotted(sig: list[Token], i: int) -> tuple[list[str], int]:
    """The parts of a dotted name at ``i``, in upper case, and where it ends."""
    out = [sig[i].value.upper()]
    while i + 2 < len(sig) and sig[i + 1].op(".") and sig[i + 2].kind in ("word", "ident"):
        i += 2
        out.append(sig[i].value.upper())
    return out, i + 1


def _name(sig: list[Token], i: int) -> str:
    """A possibly qualified name's last part."""
    while i + 2 < len(sig) and sig[i + 1].op("."):
        i += 2
    return value_of(sig[i]) if i < len(sig) else ""


def detect(tokens: list[Token]) -> MetadataQuery | None:
    """The metadata question that a statement asks, if it does."""
    sig = [t for t in significant(tokens) if not t.op(";")]
    if not sig:
        return None
    words = [t.upper for t in sig]
    if words[0] == "SHOW":
        return _show(sig, words)
    if words[0] in ("DESCRIBE", "DESC") and len(sig) >= 2 and sig[1].kind in ("word", "ident"):
        return MetadataQuery("columns", _name(sig, 1))
    if words[0] in ("EXEC", "EXECUTE"):
        sig, words = sig[1:], words[1:]
    if sig and words[0] in ("SP_TABLES", "SP_COLUMNS"):
        return MetadataQuery("sys_tables") if words[0] == "SP_TABLES" else MetadataQuery("sys_columns", _name(sig, 1) if len(sig) > 1 else "")
    if words[:1] == ["PRAGMA"] and len(sig) >= 2:
        name, end = _dotted(sig, 1)
        arg = next((value_of(t) for t in sig[end:] if t.kind in ("word", "ident", "str")), "")
        return MetadataQuery("pragma", arg, names=(name[-1].lower(),))
    if words[0] != "SELECT":
        return None
    if "FROM" not in words:
        items = [t for t in sig[1:] if not t.op(",")]
        if items and all(t.kind == "sysvar" for t in items):
            return MetadataQuery("variables", names=tuple(t.text for t in items))
        return None
    return _from(sig, words)


def _show(sig: list[Token], words: list[str]) -> MetadataQuery | None:
    rest = words[1:]
    like = next((value_of(sig[i + 1]) for i, w in enumerate(words[:-1]) if w == "LIKE" and sig[i + 1].kind == "str"), None)
    if rest[:1] == ["FULL"]:
        rest = rest[1:]
    if rest[:1] == ["TABLES"]:
        return MetadataQuery("tables", like=like)
    if rest[:1] in (["DATABASES"], ["SCHEMAS"]):
        return MetadataQuery("databases", like=like)
    at = next((i for i, w in enumerate(words) if w in ("FROM", "IN")), None)
    if rest[:1] in (["COLUMNS"], ["FIELDS"]) and at:
        return MetadataQuery("columns", _name(sig, at + 1), like)
    if rest[:1] in (["INDEX"], ["INDEXES"], ["KEYS"]) and at:
        return MetadataQuery("index", _name(sig, at + 1))
    if rest[:2] == ["CREATE", "TABLE"]:
        return MetadataQuery("create", _name(sig, 3))
    if rest[:1] == ["VARIABLES"] or rest[1:2] == ["VARIABLES"]:
        return MetadataQuery("show_variables", like=like)
    return None


def _from(sig: list[Token], words: list[str]) -> MetadataQuery | None:
    """Canned answers: one source, as in the forms that clients send, without other clauses than WHERE and ORDER BY."""
    at = words.index("FROM")
    if at + 1 >= len(sig):
        return None
    if words[1] == "EXISTS" and sig[2].op("("):
        source, _ = _dotted(sig, at + 1)
        if source[-2:] == ["INFORMATION_SCHEMA", "TABLES"] and (t := _equals(sig, "TABLE_NAME")) is not None:
            return MetadataQuery("exists", t)
        return None
    if sig[at + 1].kind not in ("word", "ident"):
        return None
    source, end = _dotted(sig, at + 1)
    last = source[-1]
    if "PG_CATALOG" in source[:-1] or last.startswith("PG_"):
        if last in ("PG_TABLES", "PG_CLASS"):
            return MetadataQuery("pg_tables")
        if last == "PG_ATTRIBUTE":
            return MetadataQuery("pg_attribute", _equals(sig, "TABLE_NAME") or _equals(sig, "RELNAME") or "")
        return None
    if source[:-1] == ["SYS"] and last == "TABLES" or last == "SYSOBJECTS":
        return MetadataQuery("sys_tables")
    if source[:-1] == ["SYS"] and last == "COLUMNS" or last == "SYSCOLUMNS":
        return MetadataQuery("sys_columns", _equals(sig, "TABLE_NAME") or _equals(sig, "NAME") or "")
    return None


#: The columns of each view over the catalog.
VIEWS = {
    "tables": "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string",
    "columns": "TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION long, COLUMN_DEFAULT string, IS_NULLABLE string, DATA_TYPE string, COLUMN_KEY string",
    "schemata": "CATALOG_NAME string, SCHEMA_NAME string",
}


def view_rows(name: str, tables: Iterable) -> list[tuple]:
    """The rows of an information_schema view."""
    if name == "tables":
        return [("main", "main", t.name, "VIEW" if t.is_view else "BASE TABLE") for t in tables]
    if name == "schemata":
        return [("main", "main")]
    return [
        ("main", t.name, c.name, i, c.default, "NO" if c.not_null else "YES", c.decl, "PRI" if c.name in t.primary else "")
        for t in tables
        for i, c in enumerate(t.columns)
    ]


def _mysql_type(decl: str) -> tuple[str, str | None]:
    d = decl.upper()
    if "INT" in d:
        return "bigint", None
    if d in ("REAL", "DOUBLE", "FLOAT", "NUMERIC", "DECIMAL"):
        return "double", None
    if "BLOB" in d:
        return "longblob", None
    if not d or any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "longtext", "utf8mb4_unicode_ci"
    return d.lower(), None


def like_matches(pattern: str | None) -> Callable[[str], bool]:
    """A test of names by a MySQL LIKE pattern, without case; all pass without a pattern."""
    import re

    if pattern is None:
        return lambda s: True
    out, p, i = [], like_pattern(pattern), 0
    while i < len(p):
        if p[i] == "\\":
            out.append(re.escape(p[i + 1 : i + 2]))
            i += 2
            continue
        out.append(".*" if p[i] == "%" else "." if p[i] == "_" else re.escape(p[i]))
        i += 1
    whole = re.compile("".join(out), re.I | re.S)
    return lambda s: whole.fullmatch(s) is not None


def answer(q: MetadataQuery, tables: dict, value: Callable[[str], object]) -> tuple[str, list[tuple]]:
    """(schema, rows).  tables: by lower-case name, in any order; value: of a session variable's Spark SQL."""
    some = sorted(tables.values(), key=lambda t: t.name)
    keep = like_matches(q.like)
    one = tables.get(q.table.lower())
    columns = one.columns if one else []
    pk = one.primary if one else []
    if q.kind == "tables":
        return "Tables_in_database string", [(t.name,) for t in some if keep(t.name)]
    if q.kind == "databases":
        return "Database string", [(d,) for d in ("main",) if keep(d)]
    if q.kind == "columns":
        rows = []
        for c in columns:
            kind, collation = _mysql_type(c.decl)
            rows.append((c.name, kind, "NO" if c.not_null else "YES", "PRI" if c.name in pk else "", c.default, "", collation, "select,insert,update,references", ""))
        return "Field string, Type string, Null string, Key string, Default string, Extra string, Collation string, Privileges string, Comment string", [r for r in rows if keep(r[0])]
    if q.kind == "create":
        return "`Create Table` string", [(one.sql,)] if one else []
    if q.kind == "index":
        rows = [(i.name, int(i.unique), "c") for i in one.indexes] if one else []
        rows += [(f"sqlite_autoindex_{one.name}_{k + 1}", 1, "u") for k, _ in enumerate(one.unique)] if one else []
        if one and pk and not one.rowid_alias:
            rows.append((f"sqlite_autoindex_{one.name}_{len(one.unique) + 1}", 1, "pk"))
        return "seq long, name string, unique long, origin string, partial long", [(k, *r, 0) for k, r in enumerate(rows)]
    if q.kind == "exists":
        return "exists long", [(int(one is not None),)]
    if q.kind == "variables":
        return ", ".join(f"`{n}` string" for n in q.names), [tuple(value(scalar.variable(n[2:])) for n in q.names)]
    if q.kind == "show_variables":
        return "Variable_name string, Value string", [(n, value(v)) for n, v in sorted(scalar.VARIABLES.items()) if keep(n)]
    if q.kind == "pg_tables":
        return "tablename string, schemaname string", [(t.name, "public") for t in some]
    if q.kind == "pg_attribute":
        rows = [(t.name, c.name, c.decl, "NO" if c.not_null else "YES", c.default) for t in some if not q.table or t.name.lower() == q.table.lower() for c in t.columns]
        return "table_name string, column_name string, data_type string, is_nullable string, column_default string", rows
    if q.kind == "sys_tables":
        return "name string, type string", [(t.name, "U") for t in some]
    if q.kind == "sys_columns":
        rows = [(c.name, c.decl, 0 if c.not_null else 1) for t in some if not q.table or t.name.lower() == q.table.lower() for c in t.columns]
        return "COLUMN_NAME string, DATA_TYPE string, is_nullable long", rows
    return _pragma(q, one)


def _pragma(q: MetadataQuery, one) -> tuple[str, list[tuple]]:
    name = q.names[0]
    if name in ("table_info", "table_xinfo"):
        rows = [(i, c.name, c.decl, int(c.not_null), c.default, one.primary.index(c.name) + 1 if c.name in one.primary else 0) for i, c in enumerate(one.columns)] if one else []
        return "cid long, name string, type string, notnull long, dflt_value string, pk long", rows
    if name == "index_list":
        return answer(MetadataQuery("index", q.table), {q.table.lower(): one} if one else {}, lambda v: None)
    if name == "foreign_key_list":
        rows = [(i, k, f.parent, a, b, "NO ACTION", "NO ACTION", "NONE") for i, f in enumerate(one.foreign) for k, (a, b) in enumerate(zip(f.columns, f.parent_columns))] if one else []
        return "id long, seq long, `table` string, `from` string, `to` string, on_update string, on_delete string, `match` string", rows
    known = {"journal_mode": "wal", "foreign_keys": "1", "busy_timeout": "5000", "encoding": "UTF-8", "user_version": "0"}
    return f"`{name}` string", [(known[name],)] if name in known else []
