"""A client's session: SQL in its dialect in, Spark results out, with the state that dialects keep between statements."""

from __future__ import annotations

import itertools
import json
import os
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polygate.dialect import Options, like_pattern, quote, to_spark
from polygate.errors import BusyError, EngineError, MissingTable, ReadOnlyError, SqlSyntaxError, TooManyPrepared
from polygate.functions.scalar import CHANGES, LAST_ID
from polygate.lexer import Dialect, Token, significant, split_commas, text_of
from polygate.operators import dml
from polygate.operators.lowering import lower, wire_class
from polygate.plans import metadata, statements
from polygate.plans.metadata import MetadataQuery
from polygate.plans.statements import Alter, CreateTable, CreateView, Delete, Drop, Index, Insert, Transaction, Truncate, Update
from polygate.plans.translate import TranslateCache, Translated
from polygate.sources.store import Manifest, Store, Table

PREPARED_CAP = 1024
_CONF = {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.variable.substitute": "false"}
_COPIED = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")
_shared_cache = TranslateCache()


@dataclass
class Result:
    """What a statement came to: rows of a query, or counts of a change; more: whether another statement follows."""

    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    affected: int = 0
    last_insert_id: int | None = None
    kind: str = "ok"
    types: list[str] = field(default_factory=list)
    df: DataFrame | None = None
    more: bool = False


class Pages:
    """Rows that are fetched partition by partition while they are sent, once; ``len`` tells how many were.

    The first is fetched at once, so that what is wrong with a query shows before any of it is sent.
    """

    def __init__(self, df: DataFrame, done: Callable[[int], None]) -> None:
        self._rows = df.toLocalIterator()
        self._first = list(itertools.islice(self._rows, 1))
        self._done, self._sent = done, 0

    def __iter__(self) -> Iterator[tuple]:
        for r in itertools.chain(self._first, self._rows):
            self._sent += 1
            yield _plain(r)
        self._done(self._sent)

    def __len__(self) -> int:
        return self._sent


def _plain(row: Sequence) -> tuple:
    return tuple(bytes(v) if isinstance(v, bytearray) else v for v in row)


@dataclass(frozen=True)
class Prepared:
    id: int
    sql: str
    plan: Translated
    n_params: int
    columns: tuple[str, ...] = ()


@dataclass
class _Overlay:
    """What a transaction has written so far."""

    tables: dict[str, Table | None] = field(default_factory=dict)
    changes: list = field(default_factory=list)

    def copy(self) -> _Overlay:
        return _Overlay(dict(self.tables), list(self.changes))


def child_session(spark: SparkSession) -> SparkSession:
    """A session of its own temporary views and settings on the same application."""
    child = spark.newSession()
    for k in _COPIED:
        v = spark.conf.get(k, None)
        if v is not None:
            child.conf.set(k, v)
    for k, v in _CONF.items():
        child.conf.set(k, v)
    return child


class Session:
    """SQL in one dialect over a store and read-only tables.

    ``store`` may be shared: each session sees committed versions, its own transaction pins a snapshot.  Errors leave
    the transaction as it was before the statement.  In a text of several statements the first error stops, and what
    came before it stays.
    """

    def __init__(self, spark: SparkSession, dialect: Dialect = Dialect.MYSQL, store: Store | None = None, options: Options | None = None, cache: TranslateCache | None = None, admission=None, screen=None, schema: str = "main") -> None:
        self.spark, self.dialect, self.options = child_session(spark), dialect, options or Options()
        self.store = store
        self._own_store = store is None
        self.cache = cache if cache is not None else _shared_cache
        self.admission, self.screen = admission, screen
        self.external: dict[str, DataFrame] = {}
        self.last_insert_id, self.row_count, self.found_rows = 0, 0, 0
        self._prepared: dict[int, Prepared] = {}
        self._ids = itertools.count(1)
        self._snapshot: Manifest | None = None
        self._overlay = _Overlay()
        self._savepoints: list[tuple[str, _Overlay]] = []
        self._staged: list[str] = []  # what statements wrote aside, until the transaction ends
        self._views: dict[str, object] = {}
        self._shared: list[str] = []
        self._lock = threading.RLock()

    # --- tables -----------------------------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame, of this or another session of the application, a read-only table."""
        if df.sparkSession is not self.spark:
            shared = f"polygate_{uuid.uuid4().hex}"
            df.createOrReplaceGlobalTempView(shared)
            self._shared.append(shared)
            df = self.spark.table(f"{self.spark.conf.get('spark.sql.globalTempDatabase')}.{shared}")
        self.external[name.lower()] = df
        self._views.pop(name.lower(), None)

    def register_parquet(self, folder: str, names: Sequence[str] | None = None) -> Session:
        """Makes Parquet tables of a folder (``<name>.parquet``) read-only tables; names are listed if not given."""
        if names is None:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(folder)
            fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            names = [s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def _manifest(self) -> Manifest:
        if self.store is None:
            return Manifest()
        return self._snapshot if self._snapshot is not None else self.store.manifest()

    def tables(self) -> dict[str, Table]:
        """All tables that a statement sees, by lower-case name."""
        out = {}
        for n, df in self.external.items():
            cols = tuple(statements.Column(f.name, wire_class(f.dataType), f.dataType.simpleString(), not f.nullable) for f in df.schema)
            out[n] = Table(n, cols)
        for n, t in {**self._manifest().tables, **self._overlay.tables}.items():
            if t is None:
                out.pop(n, None)
            else:
                out[n] = t
        return out

    def table(self, name: str) -> Table:
        n = name.lower()
        t = self._overlay.tables.get(n, self._manifest().tables.get(n))
        if t is None and n in self.external:
            raise ReadOnlyError(f"table {name} is read-only")
        if t is None:
            raise MissingTable(f"no such table: {name}")
        return t

    def _writable(self) -> Store:
        if self.store is None:
            self.store = Store(self.spark)
        return self.store

    def _refresh(self) -> None:
        """Temporary views of all tables in the versions that this statement sees."""
        want: dict[str, object] = {n: ("external", id(df)) for n, df in self.external.items()}
        current = {**self._manifest().tables, **{n: t for n, t in self._overlay.tables.items()}}
        for n, t in current.items():
            if t is None:
                want.pop(n, None)
            else:
                want[n] = (t.segments, t.columns, t.view)
        for n in [n for n in self._views if n not in want]:
            self.spark.catalog.dropTempView(n)
            del self._views[n]
        views = [n for n, t in current.items() if t is not None and t.is_view and self._views.get(n) != want[n]]
        for n, mark in want.items():
            if self._views.get(n) == mark or n in views:
                continue
            if mark[0] == "external":
                self.external[n].createOrReplaceTempView(quote(n))
            else:
                t = current[n]
                self.store.read(self.spark, t).select(*[F.col(quote(c.name)) for c in t.columns]).createOrReplaceTempView(quote(n))
            self._views[n] = mark
        for n in views:
            self.spark.sql(current[n].view).createOrReplaceTempView(quote(n))
            self._views[n] = want[n]

    def _information_schema(self, text: str) -> None:
        for name, schema in metadata.VIEWS.items():
            if f"information_schema__{name}" in text:
                rows = metadata.view_rows(name, sorted(self.tables().values(), key=lambda t: t.name))
                self.spark.createDataFrame(rows, schema).createOrReplaceTempView(f"information_schema__{name}")

    # --- running ----------------------------------------------------------------------------------------------------

    def _args(self, t: Translated, params: Sequence | None) -> dict:
        params = list(params or [])
        if len(params) != t.n_params:
            raise SqlSyntaxError(f"{t.n_params} parameters needed, {len(params)} given")
        args = {f"p{i + 1}": like_pattern(v) if i + 1 in t.like_params and isinstance(v, str) else v for i, v in enumerate(params)}
        return args | {LAST_ID[1:]: self.last_insert_id, CHANGES[1:]: self.row_count}

    def _spark_sql(self, text: str, args: dict) -> DataFrame:
        used = {k: v for k, v in args.items() if f":{k}" in text}
        return self.spark.sql(text, args=used) if used else self.spark.sql(text)

    def _query(self, t: Translated, params: Sequence | None) -> DataFrame:
        self._refresh()
        self._information_schema(t.text)
        args = self._args(t, params)
        try:
            return self._spark_sql(t.text, args)
        except Exception as e:
            name = (getattr(e, "getCondition", lambda: None)() or "")
            if name.startswith(("MISSING_AGGREGATION", "MISSING_GROUP_BY")) and self.dialect in (Dialect.MYSQL, Dialect.SQLITE):
                loose = any_values(list(t.tokens), self.dialect, self.options)
                if loose is not None:
                    return self._spark_sql(loose, args)
            raise

    def sql(self, text: str, params: Sequence | None = None) -> DataFrame:
        """A query's DataFrame, not yet run.  Other statements run at once and give their result as one row."""
        plans = self._plans(text)
        if len(plans) == 1 and plans[0].kind == "query":
            return self._query(plans[0], params)
        if len(plans) == 1 and plans[0].kind == "metadata":
            return self._metadata(plans[0].plan)
        r = self.query(text, params)
        if r.df is not None:
            return r.df
        return self.spark.createDataFrame([(r.affected, r.last_insert_id)], "affected long, last_insert_id long")

    def _plans(self, text: str) -> list[Translated]:
        if self.screen is not None:
            self.screen(text)
        return self.cache.translate(text, self.dialect, self.options)

    def query(self, text: str, params: Sequence | None = None, lowered: bool = True) -> Result:
        """Runs all statements of a text and returns the last one's result; rows in wire classes unless told otherwise."""
        with self._lock:
            plans = self._plans(text)
            if not plans:
                return Result()
            if params and len(plans) > 1:
                raise SqlSyntaxError("parameters need a single statement")
            out = Result()
            for t in plans:
                out = self._run(t, params, lowered)
            return out

    execute = query

    def each(self, text: str, lowered: bool = True, paged: bool = False) -> Iterator[tuple[Translated, Result]]:
        """Runs the statements of a text one after the other and gives each with its result.

        With ``paged`` a query's rows are :class:`Pages`, to be read before the next statement is asked for.
        """
        with self._lock:
            plans = self._plans(text)
            for i, t in enumerate(plans):
                out = self._run(t, None, lowered, paged)
                out.more = i < len(plans) - 1
                yield t, out

    def _run(self, t: Translated, params: Sequence | None, lowered: bool, paged: bool = False) -> Result:
        if t.kind == "noop":
            return Result()
        if t.kind == "found_rows":
            n, self.found_rows = self.found_rows, 1
            return self._rows(self.spark.createDataFrame([(n,)], f"{quote(t.text)} long"), lowered, count=False)
        if t.kind == "metadata":
            return self._rows(self._metadata(t.plan), lowered)
        if t.kind == "transaction":
            self._transaction(t.plan)
            return Result(kind="transaction")
        if t.kind == "maintenance":
            if t.text == "VACUUM" and self.store is not None:
                if self.in_transaction:
                    raise EngineError("cannot VACUUM from within a transaction")
                self.store.vacuum()
            return Result()
        if t.kind == "query":
            total = None
            if t.count_text:
                try:
                    self._refresh()
                    args = self._args(t, params)
                    total = self._spark_sql(t.count_text, args).first()[0]
                except Exception:  # the count is extra: the query itself tells what is wrong
                    total = None
            out = self._rows(self._query(t, params), lowered, total is None, paged)
            if total is not None:
                self.found_rows = total
            return out
        permit = self.admission.admit(self) if self.admission is not None else None
        try:
            return self._change(t, params, lowered)
        finally:
            if permit is not None and not self.in_transaction:
                self.admission.release(self)

    def _found(self, n: int) -> None:
        self.found_rows = n

    def _rows(self, df: DataFrame, lowered: bool, count: bool = True, paged: bool = False) -> Result:
        out = lower(df) if lowered else df
        if paged:
            rows = Pages(out, self._found if count else lambda n: None)
        else:
            rows = [_plain(r) for r in out.collect()]
            if count:
                self._found(len(rows))
        return Result(list(df.columns), rows, 0, None, "query", [wire_class(f.dataType) for f in df.schema], df)

    def _metadata(self, q: MetadataQuery) -> DataFrame:
        def value(text: str) -> object:
            if text == LAST_ID:
                return str(self.last_insert_id)
            if text == CHANGES:
                return str(self.row_count)
            return None if text.startswith("CAST(NULL") else text.strip("'")

        schema, rows = metadata.answer(q, self.tables(), value)
        return self.spark.createDataFrame(rows, schema)

    def _context(self, args: dict) -> dml.Context:
        return dml.Context(self.spark, self._writable(), self.dialect, lambda text: self._spark_sql(text, args), self.table, self.tables, self._manifest().capture, self._staged)

    def _change(self, t: Translated, params: Sequence | None, lowered: bool) -> Result:
        self._refresh()
        store = self._writable()
        if store.read_only:
            raise ReadOnlyError("attempt to write a readonly database")
        base = self._manifest()
        args = self._args(t, params)
        plans = t.plan if isinstance(t.plan, list) else [t.plan]
        overlay, out = self._overlay.copy(), Result(kind=t.kind)
        kept = self._overlay
        try:
            self._overlay = overlay
            for p in plans:
                out = self._apply(p, args, lowered)
                self._refresh()
        except BaseException:
            self._overlay = kept
            if not self.in_transaction:
                store.unstage(self._staged)
            raise
        if not self.in_transaction:
            written, changes, self._overlay = overlay.tables, overlay.changes, _Overlay()
            if written:
                try:
                    store.commit(base, written, changes, log=lambda m, c: self._log(m, c))
                finally:
                    self._views = {n: v for n, v in self._views.items() if n not in written}
                    store.unstage(self._staged)
        return out

    def _apply(self, p: object, args: dict, lowered: bool) -> Result:
        if isinstance(p, (Insert, Update, Delete)):
            ctx = self._context(args)
            table = self.table(p.table)
            if table.is_view:
                raise ReadOnlyError(f"cannot modify {p.table} because it is a view")
            act = {Insert: dml.insert, Update: dml.update, Delete: dml.delete}[type(p)]
            done = act(ctx, table, p)
            self._overlay.tables[p.table.lower()] = done.table
            self._overlay.changes += done.changes
            self.row_count = done.affected
            if done.last_id is not None:
                self.last_insert_id = done.last_id
            out = Result(affected=done.affected, last_insert_id=done.last_id, kind="dml")
            if p.returning is not None:
                done.rows.select(*[F.col(quote(c.name)) for c in done.table.columns]).createOrReplaceTempView("__returning")
                rows = self._spark_sql(f"SELECT {to_spark(p.returning, self.dialect, named=False).text} FROM __returning", args)
                got = self._rows(rows, lowered, count=False)
                out.columns, out.rows, out.types, out.df = got.columns, got.rows, got.types, got.df
            return out
        self._ddl(p, args)
        return Result(kind="ddl")

    # --- DDL --------------------------------------------------------------------------------------------------------

    def _ddl(self, p: object, args: dict) -> None:
        now = self.tables()
        put = self._overlay.tables
        if isinstance(p, CreateTable):
            if p.name.lower() in now:
                if p.if_not_exists:
                    return
                raise EngineError(f"table {p.name} already exists")
            if p.query is not None:
                self._create_as(p, args)
                return
            seen = set()
            for c in p.columns:
                if c.name.lower() in seen:
                    raise EngineError(f"duplicate column name: {c.name}")
                seen.add(c.name.lower())
            t = Table(p.name, tuple(p.columns), p.sql, tuple(p.primary), tuple(tuple(u) for u in p.unique), tuple(p.checks), tuple(p.foreign), tuple(p.indexes))
            put[p.name.lower()] = t
            self._ddl_change("create", t)
        elif isinstance(p, CreateView):
            if p.name.lower() in now:
                if p.if_not_exists:
                    return
                raise EngineError(f"table {p.name} already exists")
            text = to_spark(p.query, self.dialect, self.options).text
            schema = self._spark_sql(text, args).schema
            cols = tuple(statements.Column(f.name, wire_class(f.dataType), f.dataType.simpleString()) for f in schema)
            put[p.name.lower()] = t = Table(p.name, cols, f"CREATE VIEW {p.name} AS {text_of(p.query)}", view=text)
            self._ddl_change("create", t)
        elif isinstance(p, Index):
            self._create_index(p)
        elif isinstance(p, Drop):
            self._drop(p, now)
        elif isinstance(p, Truncate):
            t = self.table(p.name)
            if self._manifest().capture and t.segments:
                self._overlay.changes.append((dml.DELETED, t.name, dml.deleted(t, self._context(args).frame(t))))
            put[p.name.lower()] = replace(t, segments=(), next_rowid=1)
        elif isinstance(p, Alter):
            self._alter(p)

    def _create_as(self, p: CreateTable, args: dict) -> None:
        df = self._spark_sql(to_spark(p.query, self.dialect, self.options).text, args)
        kinds = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
        df = lower(df)
        cols = tuple(statements.Column(f.name, wire_class(f.dataType), kinds[wire_class(f.dataType)]) for f in df.schema)
        t = Table(p.name, cols, p.sql)
        rows, n = dml.indexed(self._writable(), df, p.name, self._staged)
        rows = rows.select((F.col("__idx") + 1).alias(dml.ROWID), *[F.col(quote(c.name)).cast(c.type) for c in cols])
        self._overlay.tables[p.name.lower()] = made = replace(t, segments=(self.store.write(rows, p.name),), next_rowid=n + 1)
        self._ddl_change("create", t)
        if self._manifest().capture:
            self._overlay.changes.append((dml.INSERTED, t.name, dml.inserted(t, self._context(args).frame(made))))

    def _create_index(self, p: Index) -> None:
        t = self.table(p.table)
        if any(i.name.lower() == p.name.lower() for other in self.tables().values() for i in other.indexes):
            if p.if_not_exists:
                return
            raise EngineError(f"index {p.name} already exists")
        names = {c.name.lower() for c in t.columns}
        for c in p.columns:
            if c.lower() not in names:
                raise EngineError(f"no such column: {c}")
        if p.unique:
            ctx = self._context({})
            dml.check_unique(ctx, t, ctx.frame(t), [tuple(p.columns)])
        self._overlay.tables[p.table.lower()] = t = replace(t, indexes=(*t.indexes, p))
        self._ddl_change("indexes", t)

    def _drop(self, p: Drop, now: dict[str, Table]) -> None:
        if p.what == "index":
            for n, t in now.items():
                rest = tuple(i for i in t.indexes if i.name.lower() != p.name.lower())
                if len(rest) < len(t.indexes):
                    self._overlay.tables[n] = t = replace(t, indexes=rest)
                    self._ddl_change("indexes", t)
                    return
        elif p.name.lower() in now:
            self._ddl_change("drop", self.table(p.name))
            self._overlay.tables[p.name.lower()] = None
            return
        if not p.if_exists:
            raise MissingTable(f"no such {p.what}: {p.name}")

    def _alter(self, p: Alter) -> None:
        t = self.table(p.table)
        key = p.table.lower()
        put = self._overlay.tables
        if p.action == "create_index":
            self._create_index(p.index)
            return
        if p.action == "drop_index":
            put[key] = t = replace(t, indexes=tuple(i for i in t.indexes if i.name.lower() != p.old.lower()))
            self._ddl_change("indexes", t)
            return
        if p.action == "rename_table":
            if p.new.lower() in self.tables():
                raise EngineError(f"there is already another table or index with this name: {p.new}")
            new = replace(t, name=p.new)
            put[key], put[p.new.lower()] = None, replace(new, sql=new.definition())
            self._ddl_change("rename_table", put[p.new.lower()], t.name)
            return
        store, frame = self._writable(), self._context({}).frame(t)
        if p.old and all(x.name.lower() != p.old.lower() for x in t.columns):
            raise EngineError(f"no such column: {p.old}")
        if p.action == "add_column":
            c = p.column
            if any(x.name.lower() == c.name.lower() for x in t.columns):
                raise EngineError(f"duplicate column name: {c.name}")
            if c.not_null and c.default is None:
                raise EngineError("Cannot add a NOT NULL column with default value NULL")
            new = replace(t, columns=(*t.columns, c))
        elif p.action == "drop_column":
            if len(t.columns) < 2 or any(p.old.lower() in map(str.lower, k) for k in t.keys):
                raise EngineError(f"cannot drop column {p.old}")
            new = replace(t, columns=tuple(c for c in t.columns if c.name.lower() != p.old.lower()))
        else:
            turn = lambda names: tuple(p.new if n.lower() == p.old.lower() else n for n in names)
            new = replace(t, columns=tuple(replace(c, name=p.new) if c.name.lower() == p.old.lower() else c for c in t.columns), primary=turn(t.primary), unique=tuple(turn(u) for u in t.unique), indexes=tuple(replace(i, columns=list(turn(i.columns))) for i in t.indexes))
        new = replace(new, sql=new.definition())
        if t.segments:
            new = replace(new, segments=(store.write(dml.reshaped(frame, t, new), t.name),))
        put[key] = new
        self._ddl_change("reshape", new)

    def _ddl_change(self, action: str, t: Table, old: str | None = None) -> None:
        """A schema row for the change log, so that replicas follow: the CREATE text, and the table's parts."""
        if self._manifest().capture:
            kind = dml.DELETED if action == "drop" else dml.INSERTED if action == "create" else dml.UPDATED
            parts = json.dumps({"action": action, "table": replace(t, segments=(), next_rowid=1).to_json()})
            row = (0, old or t.name, None if action == "drop" else t.sql, parts)
            self._overlay.changes.append((kind, "sqlite_schema", self.spark.createDataFrame([row], "id long, before string, after string, updates string")))

    def _log(self, manifest: Manifest, changes: list) -> int:
        from polygate.streaming.cdc import write_log

        return write_log(self.spark, self.store, manifest, changes)

    # --- transactions -----------------------------------------------------------------------------------------------

    @property
    def in_transaction(self) -> bool:
        return self._snapshot is not None

    def _transaction(self, t: Transaction) -> None:
        if t.action == "begin":
            if self.in_transaction:
                raise EngineError("cannot start a transaction within a transaction")
            self._snapshot = self._writable().manifest()
            return
        if not self.in_transaction and t.action == "savepoint":
            self._snapshot = self._writable().manifest()  # a savepoint outside a transaction opens one
        if not self.in_transaction:
            raise EngineError(f"cannot {t.action.replace('_', ' ')} - no transaction is active")
        if t.action == "commit":
            try:
                if self._overlay.tables:
                    self.store.commit(self._snapshot, self._overlay.tables, self._overlay.changes, log=lambda m, c: self._log(m, c))
            except BusyError:
                self._end()
                raise
            self._end()
        elif t.action == "rollback" and not t.name:
            self._end()
        elif t.action == "savepoint":
            self._savepoints.append((t.name, self._overlay.copy()))
        else:
            at = next((i for i in reversed(range(len(self._savepoints))) if self._savepoints[i][0] == t.name), None)
            if at is None:
                raise EngineError(f"no such savepoint: {t.name}")
            if t.action == "release":
                del self._savepoints[at:]
            else:
                self._overlay = self._savepoints[at][1].copy()
                del self._savepoints[at + 1 :]

    def _end(self) -> None:
        self._snapshot, self._overlay, self._savepoints = None, _Overlay(), []
        if self.store is not None:
            self.store.unstage(self._staged)
        if self.admission is not None:
            self.admission.release(self)

    # --- prepared statements ----------------------------------------------------------------------------------------

    def prepare(self, sql: str) -> Prepared:
        """Keeps the first statement of a text; its columns are known without running it."""
        if len(self._prepared) >= PREPARED_CAP:
            raise TooManyPrepared(f"can't create more than {PREPARED_CAP} prepared statements")
        plans = self._plans(sql)
        t = plans[0] if plans else Translated("noop")
        columns = tuple(self.describe(t)) if t.kind == "query" else ()
        p = Prepared(next(self._ids), sql, t, t.n_params, columns)
        self._prepared[p.id] = p
        return p

    def execute_prepared(self, p: Prepared | int, params: Sequence | None = None, lowered: bool = True) -> Result:
        p = self._prepared.get(p if isinstance(p, int) else p.id)
        if p is None:
            raise EngineError("unknown prepared statement")
        if len(params or []) != p.n_params:
            raise SqlSyntaxError(f"{p.n_params} parameters needed, {len(params or [])} given")
        with self._lock:
            return self._run(p.plan, params, lowered)

    def close_prepared(self, p: Prepared | int) -> None:
        self._prepared.pop(p if isinstance(p, int) else p.id, None)

    def describe(self, query: str | Translated) -> list[str]:
        """Column names by analysis alone; placeholders stand for NULL."""
        t = query if isinstance(query, Translated) else self._plans(query)[0]
        return self.schema_of(t).names

    def shape_of(self, t: Translated) -> tuple[list[str], list[str]]:
        """Names and wire classes of a statement's columns, without running it; none where it gives no rows."""
        if t.kind == "found_rows":
            return [t.text], ["INTEGER"]
        if t.kind == "metadata":
            schema = self._metadata(t.plan).schema
        elif t.kind == "query":
            schema = self.schema_of(t)
        elif t.kind == "dml" and t.plan.returning is not None:
            table = self.table(t.plan.table)
            self.spark.createDataFrame([], table.schema(rowid=False)).createOrReplaceTempView("__returning")
            schema = self._spark_sql(f"SELECT {to_spark(t.plan.returning, self.dialect, named=False).text} FROM __returning", {}).schema
        else:
            return [], []
        return schema.names, [wire_class(f.dataType) for f in schema]

    def schema_of(self, t: Translated):
        self._refresh()
        self._information_schema(t.text)
        text = t.text
        for n in sorted(t.params, reverse=True):
            text = text.replace(f"LIMIT :p{n}", "LIMIT 1").replace(f"OFFSET :p{n}", "OFFSET 0").replace(f":p{n}", "NULL")
        return self._spark_sql(text, {LAST_ID[1:]: 0, CHANGES[1:]: 0}).schema

    def translate_sql(self, sql: str) -> str:
        """The Spark SQL of a text's first statement, empty if it needs none."""
        plans = self._plans(sql)
        return plans[0].text if plans and plans[0].kind == "query" else ""

    # --- lifetime ---------------------------------------------------------------------------------------------------

    def reset(self) -> None:
        """Rolls back, forgets prepared statements and counters."""
        self._end()
        self._prepared.clear()
        self.last_insert_id = self.row_count = self.found_rows = 0

    def close(self) -> None:
        self.reset()
        for n in list(self._views):
            self.spark.catalog.dropTempView(n)
        self._views.clear()
        while self._shared:
            self.spark.catalog.dropGlobalTempView(self._shared.pop())
        if self._own_store and self.store is not None:
            self.store.close()


def any_values(tokens: list[Token], dialect: Dialect, options: Options) -> str | None:
    """A grouped query whose plain output columns outside GROUP BY are wrapped in ``any_value``; None if there are none."""
    sig = significant(tokens)
    if not sig or not sig[0].is_("SELECT"):
        return None
    depth, start, end, group = 0, tokens.index(sig[0]) + 1, len(tokens), []
    for i in range(start, len(tokens)):
        t = tokens[i]
        depth += t.op("(") - t.op(")")
        if not depth and t.is_("FROM") and end == len(tokens):
            end = i
        if not depth and t.is_("GROUP"):
            stop = next((j for j in range(i, len(tokens)) if tokens[j].is_("HAVING", "ORDER", "LIMIT")), len(tokens))
            group = [text_of(significant(g)).upper() for g in split_commas([x for x in tokens[i + 1 : stop] if not x.is_("BY")])]
    out, changed = [], False
    for k, item in enumerate(split_commas(tokens[start:end])):
        body = significant(item)
        plain = [t for t in body]
        name = body[-1].value if body else ""
        if len(body) > 2 and body[-2].is_("AS"):
            plain = body[:-2]
        if plain and all(t.kind in ("word", "ident") or t.op(".") for t in plain) and text_of(plain).upper() not in group and plain[-1].value.upper() not in group:
            item = [Token("space", " "), Token("word", "any_value"), Token("op", "("), *plain, Token("op", ")"), Token("word", " AS "), Token("ident", "", name), Token("space", " ")]
            changed = True
        out += ([Token("op", ",")] if k else []) + item
    return to_spark([*tokens[:start], *out, *tokens[end:]], dialect, options).text if changed else None


def open_session(spark: SparkSession, folder: str | os.PathLike, dialect: Dialect = Dialect.MYSQL) -> Session:
    """A session over the Parquet tables of a folder."""
    return Session(spark, dialect).register_parquet(str(folder))
