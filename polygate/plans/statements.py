"""What a statement is, and the parts of those that Spark's file tables can't run: DDL, DML and transactions."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from polygate.dialect import number_params, to_spark
from polygate.errors import SqlSyntaxError, UnsupportedError
from polygate.lexer import Dialect, Token, close_of, significant, split_commas, text_of


class Kind(Enum):
    QUERY = "query"
    MUTATION = "mutation"
    DDL = "ddl"
    TRANSACTION = "transaction"
    OTHER = "other"


def classify(tokens: list[Token]) -> Kind:
    """The kind of a statement by its first word; WITH, VALUES and parentheses are queries unless a WITH ends in DML."""
    sig = significant(tokens)
    while sig and sig[0].op("("):
        sig = sig[1:]
    if not sig or sig[0].kind != "word":
        return Kind.OTHER
    w = sig[0].upper
    if w == "WITH":
        depth = 0
        for t in sig:
            depth += t.op("(") - t.op(")")
            if not depth and t.is_("INSERT", "UPDATE", "DELETE", "REPLACE"):
                return Kind.MUTATION
        return Kind.QUERY
    if w in ("SELECT", "VALUES", "EXPLAIN", "PRAGMA", "SHOW", "DESCRIBE", "DESC", "TABLE"):
        return Kind.QUERY
    if w in ("INSERT", "UPDATE", "DELETE", "REPLACE"):
        return Kind.MUTATION
    if w in ("CREATE", "ALTER", "DROP", "TRUNCATE"):
        return Kind.DDL
    if w in ("BEGIN", "START", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE", "END", "SAVE"):
        return Kind.TRANSACTION
    return Kind.OTHER


# --- column types ---------------------------------------------------------------------------------------------------

_INTEGER = {"TINYINT", "SMALLINT", "MEDIUMINT", "INT", "BIGINT", "INTEGER", "INT2", "INT4", "INT8", "BOOLEAN", "BOOL", "SERIAL", "BIGSERIAL", "SMALLSERIAL", "BIT", "YEAR"}
_REAL = {"FLOAT", "DOUBLE", "DECIMAL", "NUMERIC", "REAL", "FLOAT4", "FLOAT8", "MONEY", "SMALLMONEY", "DEC", "FIXED"}
_TEXT = {
    "VARCHAR", "CHAR", "TEXT", "TINYTEXT", "MEDIUMTEXT", "LONGTEXT", "ENUM", "SET", "DATE", "DATETIME", "TIMESTAMP", "TIME", "JSON", "JSONB", "UUID", "INTERVAL", "NVARCHAR", "NCHAR",
    "UNIQUEIDENTIFIER", "CHARACTER", "CLOB", "TIMESTAMPTZ", "DATETIME2", "NTEXT", "STRING",
}
_BLOB = {"BINARY", "VARBINARY", "BLOB", "TINYBLOB", "MEDIUMBLOB", "LONGBLOB", "BYTEA", "IMAGE"}


def affinity(name: str) -> tuple[str, str]:
    """(declared affinity, Spark type) of a type name; unknown ones keep their name and hold text."""
    n = name.upper()
    if n in _INTEGER:
        return "INTEGER", "bigint"
    if n in _REAL:
        return "REAL", "double"
    if n in _TEXT:
        return "TEXT", "string"
    if n in _BLOB:
        return "BLOB", "binary"
    return n, "bigint" if "INT" in n else "string"


@dataclass
class Column:
    name: str
    decl: str
    type: str
    not_null: bool = False
    default: str | None = None  # Spark SQL
    autoinc: bool = False


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    unique: bool = False
    if_not_exists: bool = False


@dataclass
class ForeignKey:
    columns: list[str]
    parent: str
    parent_columns: list[str]


@dataclass
class CreateTable:
    name: str
    columns: list[Column]
    sql: str
    if_not_exists: bool = False
    primary: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    query: list[Token] | None = None


@dataclass
class CreateView:
    name: str
    query: list[Token]
    if_not_exists: bool = False


@dataclass
class Drop:
    what: str
    name: str
    if_exists: bool


@dataclass
class Truncate:
    name: str


@dataclass
class Alter:
    """One change: add_column, drop_column, rename_table, rename_column, create_index, drop_index or nothing."""

    table: str
    action: str
    column: Column | None = None
    index: Index | None = None
    old: str = ""
    new: str = ""


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[list[Token]]] | None  # VALUES
    query: list[Token] | None
    conflict: str = "error"  # error, ignore, replace, update
    target: list[str] | None = None
    updates: list[tuple[str, list[Token]]] = field(default_factory=list)
    where: list[Token] | None = None
    returning: list[Token] | None = None


@dataclass
class Update:
    table: str
    alias: str | None
    sets: list[tuple[str, list[Token]]]
    where: list[Token] | None
    returning: list[Token] | None = None


@dataclass
class Delete:
    table: str
    alias: str | None
    where: list[Token] | None
    returning: list[Token] | None = None


@dataclass
class Transaction:
    action: str  # begin, commit, rollback, savepoint, release, rollback_to
    name: str = ""


class Cursor:
    """Reads significant tokens one after the other."""

    def __init__(self, tokens: list[Token]) -> None:
        self.t, self.i = significant(tokens), 0

    def peek(self, k: int = 0) -> Token:
        return self.t[self.i + k] if self.i + k < len(self.t) else Token("op", "<end>")

    def take(self) -> Token:
        t = self.peek()
        self.i += 1
        return t

    def accept(self, *words: str) -> bool:
        """Takes the given words if they come next."""
        if all(self.peek(k).is_(w) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise SqlSyntaxError(f"expected {' '.join(words)} near {self.peek().text!r}")

    def op(self, o: str) -> bool:
        if self.peek().op(o):
            self.i += 1
            return True
        return False

    def name(self) -> str:
        """A possibly qualified name; only its last part counts: there is one database."""
        t = self.take()
        if t.kind not in ("word", "ident"):
            raise SqlSyntaxError(f"expected a name near {t.text!r}")
        while self.op("."):
            t = self.take()
        return t.value

    def parens(self) -> list[Token]:
        if not self.peek().op("("):
            raise SqlSyntaxError(f"expected ( near {self.peek().text!r}")
        end = close_of(self.t, self.i)
        out = self.t[self.i + 1 : end]
        self.i = end + 1
        return out

    def names(self) -> list[str]:
        return [Cursor(c).name() for c in split_commas(self.parens())]

    def until(self, *words: str) -> list[Token]:
        """Tokens up to one of the words outside parentheses."""
        out, depth = [], 0
        while self.i < len(self.t):
            t = self.peek()
            if not depth and t.is_(*words):
                break
            depth += t.op("(") - t.op(")")
            out.append(self.take())
        return out

    @property
    def done(self) -> bool:
        return self.i >= len(self.t)


_COLUMN_WORDS = ("NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "AUTO_INCREMENT", "AUTOINCREMENT", "IDENTITY", "CHECK", "REFERENCES", "COLLATE", "COMMENT", "CONSTRAINT", "CHARACTER", "GENERATED", "ON", "KEY")


def spaced(tokens: list[Token]) -> list[Token]:
    """Significant tokens with blanks between, as text needs them."""
    out: list[Token] = []
    for t in tokens:
        out += [t, Token("space", " ")]
    return out


def _column(c: Cursor, dialect: Dialect, table: CreateTable | None) -> Column:
    name = c.name()
    decl, kind = ("", "string")
    type_word = ""
    if c.peek().kind == "word" and not c.peek().is_(*_COLUMN_WORDS) or c.peek().is_("CHARACTER"):
        type_word = c.take().text.upper()
        decl, kind = affinity(type_word)
        while c.peek().is_("UNSIGNED", "SIGNED", "ZEROFILL", "PRECISION", "VARYING"):
            c.take()
        if c.peek().op("("):
            c.parens()
        while c.peek().is_("UNSIGNED", "SIGNED", "ZEROFILL") or c.peek().is_("WITH", "WITHOUT") and c.peek(1).is_("TIME"):
            if c.take().is_("WITH", "WITHOUT"):
                c.take()
                c.take()
    col = Column(name, decl, kind, autoinc=type_word.endswith("SERIAL"))
    while not c.done:
        if c.accept("NOT", "NULL"):
            col.not_null = True
        elif c.accept("NULL"):
            pass
        elif c.accept("DEFAULT"):
            if c.peek().op("("):
                value = c.parens()
            else:
                value = [c.take()]
                if value[0].op("-", "+"):
                    value.append(c.take())
                if c.peek().op("("):
                    inner = c.parens()
                    value += [Token("op", "("), *inner, Token("op", ")")]
                while c.op("::"):
                    c.take()
            col.default = to_spark(spaced(value), dialect, named=False).text
        elif c.accept("PRIMARY", "KEY"):
            c.accept("ASC") or c.accept("DESC")
            if table is not None:
                table.primary = [name]
        elif c.accept("UNIQUE"):
            c.accept("KEY")
            if table is not None:
                table.unique.append([name])
        elif c.accept("AUTO_INCREMENT") or c.accept("AUTOINCREMENT"):
            col.autoinc = True
        elif c.accept("IDENTITY"):
            col.autoinc = True
            if c.peek().op("("):
                c.parens()
        elif c.accept("CHECK"):
            check = to_spark(spaced(c.parens()), dialect, named=False).text
            if table is not None:
                table.checks.append(check)
        elif c.accept("REFERENCES"):
            parent = c.name()
            columns = c.names() if c.peek().op("(") else []
            if table is not None:
                table.foreign.append(ForeignKey([name], parent, columns))
            _actions(c)
        elif c.accept("COLLATE") or c.accept("COMMENT") or c.accept("CONSTRAINT"):
            c.take()
        elif c.accept("CHARACTER", "SET") or c.accept("ON", "UPDATE"):
            c.take()
            if c.peek().op("("):
                c.parens()
        elif c.accept("GENERATED"):
            c.until("PRIMARY", "UNIQUE", "NOT")
            col.autoinc = True
        else:
            c.take()
    return col


def _actions(c: Cursor) -> None:
    while c.accept("ON", "DELETE") or c.accept("ON", "UPDATE"):
        if c.accept("SET"):
            c.take()
        elif not c.accept("NO", "ACTION"):
            c.take()


def _index_columns(c: Cursor) -> list[str]:
    return [Cursor(x).name() for x in split_commas(c.parens())]


def _create(c: Cursor, tokens: list[Token], dialect: Dialect) -> CreateTable | CreateView | Index:
    c.expect("CREATE")
    unique = c.accept("UNIQUE")
    if c.accept("INDEX"):
        exists = c.accept("IF", "NOT", "EXISTS")
        name = c.name()
        c.expect("ON")
        return Index(name, c.name(), _index_columns(c), unique, exists)
    c.accept("OR", "REPLACE")
    c.accept("TEMPORARY") or c.accept("TEMP")
    if c.accept("VIEW"):
        exists = c.accept("IF", "NOT", "EXISTS")
        name = c.name()
        c.expect("AS")
        return CreateView(name, spaced(c.t[c.i :]), exists)
    if not c.accept("TABLE"):
        raise UnsupportedError(f"CREATE {c.peek().text} is not supported")
    exists = c.accept("IF", "NOT", "EXISTS")
    table = CreateTable(c.name(), [], text_of(tokens), exists)
    if c.accept("AS"):
        table.query = spaced(c.t[c.i :])
        return table
    for part in split_commas(c.parens()):
        p = Cursor(part)
        if p.accept("CONSTRAINT"):
            if not p.peek().is_("PRIMARY", "UNIQUE", "FOREIGN", "CHECK"):
                p.name()
        if p.accept("PRIMARY", "KEY"):
            table.primary = _index_columns(p)
        elif p.peek().is_("UNIQUE") and (p.peek(1).op("(") or p.peek(1).is_("KEY", "INDEX") or p.peek(2).op("(")):
            p.take()
            p.accept("KEY") or p.accept("INDEX")
            if not p.peek().op("("):
                p.name()
            table.unique.append(_index_columns(p))
        elif p.accept("FOREIGN", "KEY"):
            if not p.peek().op("("):
                p.name()
            columns = p.names()
            p.expect("REFERENCES")
            parent = p.name()
            table.foreign.append(ForeignKey(columns, parent, p.names() if p.peek().op("(") else []))
        elif p.accept("CHECK"):
            table.checks.append(to_spark(spaced(p.parens()), dialect, named=False).text)
        elif p.peek().is_("FULLTEXT", "SPATIAL") and p.peek(1).is_("KEY", "INDEX"):
            continue
        elif p.peek().is_("KEY", "INDEX") and (p.peek(1).op("(") or p.peek(2).op("(") or p.peek(2).is_("USING")):
            p.take()
            name = "" if p.peek().op("(") else p.name()
            while not p.done and not p.peek().op("("):
                p.take()
            columns = _index_columns(p)
            table.indexes.append(Index(name or f"{table.name}_{'_'.join(columns)}", table.name, columns))
        else:
            table.columns.append(_column(p, dialect, table))
    c.until("AS")
    if c.accept("AS"):
        table.query = spaced(c.t[c.i :])
    if not table.columns and table.query is None:
        raise SqlSyntaxError("a table needs a column")
    for col in table.columns:
        if col.name in table.primary and (len(table.primary) > 1 or col.decl != "INTEGER"):
            col.not_null = True
    return table


def _alter(c: Cursor, dialect: Dialect) -> list[Alter]:
    """The changes of an ALTER TABLE, those that add indexes last."""
    c.expect("ALTER", "TABLE")
    c.accept("IF", "EXISTS")
    table = c.name()
    first, last = [], []
    for part in split_commas(c.t[c.i :]):
        p = Cursor(part)
        if p.accept("ADD"):
            named = p.accept("CONSTRAINT")
            name = p.name() if named else ""
            if p.peek().is_("FULLTEXT", "SPATIAL"):
                continue
            unique = p.accept("UNIQUE")
            if unique and (p.accept("KEY") or p.accept("INDEX") or True) or p.accept("KEY") or p.accept("INDEX"):
                if not p.peek().op("("):
                    name = p.name()
                columns = _index_columns(p)
                last.append(Alter(table, "create_index", index=Index(name or f"{table}_{'_'.join(columns)}", table, columns, unique)))
                continue
            if named or p.peek().is_("PRIMARY", "FOREIGN", "CHECK"):
                raise UnsupportedError("ALTER TABLE can't add this constraint")
            p.accept("COLUMN")
            p.accept("IF", "NOT", "EXISTS")
            first.append(Alter(table, "add_column", column=_column(p, dialect, None)))
        elif p.accept("DROP"):
            what = "drop_index" if p.accept("INDEX") or p.accept("KEY") else "drop_column"
            p.accept("COLUMN")
            p.accept("IF", "EXISTS")
            first.append(Alter(table, what, old=p.name()))
        elif p.accept("RENAME"):
            if p.accept("TO") or p.accept("AS"):
                first.append(Alter(table, "rename_table", new=p.name()))
            else:
                p.accept("COLUMN")
                old = p.name()
                p.expect("TO")
                first.append(Alter(table, "rename_column", old=old, new=p.name()))
        else:
            raise UnsupportedError(f"ALTER TABLE ... {p.peek().text} is not supported")
    return first + last


def _returning(c: Cursor) -> list[Token] | None:
    return spaced(c.t[c.i :]) if c.accept("RETURNING") else None


def _sets(tokens: list[Token]) -> list[tuple[str, list[Token]]]:
    out = []
    for part in split_commas(tokens):
        p = Cursor(part)
        name = p.name()
        if not p.op("="):
            raise SqlSyntaxError(f"expected = near {p.peek().text!r}")
        out.append((name, spaced(p.t[p.i :])))
    return out


def _insert(c: Cursor) -> Insert:
    conflict = "error"
    if c.accept("REPLACE"):
        conflict = "replace"
    else:
        c.expect("INSERT")
        if c.accept("OR"):
            word = c.take().upper
            conflict = {"REPLACE": "replace", "IGNORE": "ignore"}.get(word, "error")
        elif c.accept("IGNORE"):
            conflict = "ignore"
    c.accept("INTO")
    out = Insert(c.name(), None, None, None, conflict)
    if c.accept("DEFAULT", "VALUES"):
        out.columns, out.rows = [], [[]]
    else:
        if c.peek().op("(") and not c.peek(1).is_("SELECT", "WITH"):
            out.columns = c.names()
        if c.accept("VALUES") or c.accept("VALUE"):
            out.rows = []
            while True:
                out.rows.append([spaced(v) for v in split_commas(c.parens())])
                if not c.op(","):
                    break
        else:
            out.query = spaced(c.until("ON", "RETURNING") if not _joins(c) else _query_part(c))
            if not out.query:
                raise SqlSyntaxError(f"INSERT INTO {out.table} without rows")
    if c.accept("ON", "DUPLICATE", "KEY", "UPDATE"):
        out.conflict, out.updates = "update", _sets(c.until("RETURNING"))
    elif c.accept("ON", "CONFLICT"):
        if c.peek().op("("):
            out.target = c.names()
        if c.accept("DO", "NOTHING"):
            out.conflict = "ignore"
        else:
            c.expect("DO", "UPDATE", "SET")
            out.conflict, out.updates = "update", _sets(c.until("WHERE", "RETURNING"))
            if c.accept("WHERE"):
                out.where = spaced(c.until("RETURNING"))
    out.returning = _returning(c)
    return out


def _joins(c: Cursor) -> bool:
    return any(t.is_("JOIN") for t in c.t[c.i :])


def _query_part(c: Cursor) -> list[Token]:
    """A query with joins: its ON is no conflict clause unless DUPLICATE or CONFLICT follows."""
    out, depth = [], 0
    while not c.done:
        t = c.peek()
        if not depth and (t.is_("RETURNING") or t.is_("ON") and c.peek(1).is_("DUPLICATE", "CONFLICT")):
            break
        depth += t.op("(") - t.op(")")
        out.append(c.take())
    return out


def _alias(c: Cursor) -> str | None:
    if c.accept("AS"):
        return c.name()
    if c.peek().kind in ("word", "ident") and not c.peek().is_("SET", "WHERE", "RETURNING", "FROM", "ORDER", "LIMIT"):
        return c.name()
    return None


def _update(c: Cursor) -> Update:
    c.expect("UPDATE")
    table = c.name()
    alias = _alias(c)
    c.expect("SET")
    sets = _sets(c.until("WHERE", "RETURNING", "FROM", "ORDER", "LIMIT"))
    if c.peek().is_("FROM", "ORDER", "LIMIT"):
        raise UnsupportedError(f"UPDATE ... {c.peek().text} is not supported")
    where = spaced(c.until("RETURNING", "ORDER", "LIMIT")) if c.accept("WHERE") else None
    if c.peek().is_("ORDER", "LIMIT"):
        raise UnsupportedError(f"UPDATE ... {c.peek().text} is not supported")
    return Update(table, alias, sets, where, _returning(c))


def _delete(c: Cursor) -> Delete:
    c.expect("DELETE")
    c.accept("FROM")
    table = c.name()
    alias = _alias(c)
    where = spaced(c.until("RETURNING", "ORDER", "LIMIT")) if c.accept("WHERE") else None
    if c.peek().is_("ORDER", "LIMIT"):
        raise UnsupportedError(f"DELETE ... {c.peek().text} is not supported")
    return Delete(table, alias, where, _returning(c))


def transaction(tokens: list[Token]) -> Transaction | None:
    """BEGIN, START TRANSACTION, COMMIT, ROLLBACK, SAVEPOINT and their longer spellings."""
    c = Cursor(tokens)
    if c.accept("START", "TRANSACTION") or c.accept("BEGIN"):
        return Transaction("begin")
    if c.accept("COMMIT") or c.accept("END"):
        return Transaction("commit")
    if c.accept("SAVEPOINT") or c.accept("SAVE", "TRANSACTION") or c.accept("SAVE", "TRAN"):
        return Transaction("savepoint", c.name().lower())
    if c.accept("RELEASE"):
        c.accept("SAVEPOINT")
        return Transaction("release", c.name().lower())
    if c.accept("ROLLBACK"):
        c.accept("WORK") or c.accept("TRANSACTION") or c.accept("TRAN")
        if c.accept("TO"):
            c.accept("SAVEPOINT")
            return Transaction("rollback_to", c.name().lower())
        return Transaction("rollback", "" if c.done else c.name().lower())
    return None


def parse(tokens: list[Token], dialect: Dialect) -> object:
    """The parts of a DDL or DML statement; a list for ALTER TABLE."""
    tokens = number_params(tokens)
    c = Cursor(tokens)
    t = c.peek()
    if t.is_("CREATE"):
        return _create(c, tokens, dialect)
    if t.is_("ALTER"):
        return _alter(c, dialect)
    if t.is_("DROP"):
        c.take()
        what = c.take().upper
        if what not in ("TABLE", "INDEX", "VIEW"):
            raise UnsupportedError(f"DROP {what} is not supported")
        exists = c.accept("IF", "EXISTS")
        return Drop(what.lower(), c.name(), exists)
    if t.is_("TRUNCATE"):
        c.take()
        c.accept("TABLE")
        return Truncate(c.name())
    if t.is_("INSERT", "REPLACE"):
        return _insert(c)
    if t.is_("UPDATE"):
        return _update(c)
    if t.is_("DELETE"):
        return _delete(c)
    raise UnsupportedError(f"{t.text} is not supported")
