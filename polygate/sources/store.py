"""A versioned table store on Parquet: snapshots, atomic commits, change capture.

A table is a list of segments (Parquet folders, or single files of one) in a manifest.  Inserts add a segment; updates
and deletes write those files anew that hold a row which they touch.  A commit replaces the manifest in one rename, with all tables of a transaction, the change log's position
and the replication watermark, so readers see all of it or nothing.  The first committer wins: a commit fails if a table
it wrote has changed since the transaction's snapshot.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polygate.errors import BusyError, ReadOnlyError
from polygate.plans.statements import Column, ForeignKey, Index

ROWID = "__rowid"


@dataclass(frozen=True)
class Table:
    """One version of a table."""

    name: str
    columns: tuple[Column, ...] = ()
    sql: str = ""
    primary: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = ()
    segments: tuple[str, ...] = ()
    next_rowid: int = 1
    version: int = 0
    view: str | None = None  # a view's Spark SQL

    @property
    def is_view(self) -> bool:
        return self.view is not None

    @property
    def rowid_alias(self) -> str | None:
        """The column that is the row id: a single integer primary key."""
        if len(self.primary) == 1:
            for c in self.columns:
                if c.name == self.primary[0] and c.decl == "INTEGER":
                    return c.name
        return None

    @property
    def keys(self) -> list[tuple[str, ...]]:
        """All sets of columns that must be unique."""
        out = [self.primary] if self.primary else []
        return [*out, *self.unique, *(tuple(i.columns) for i in self.indexes if i.unique)]

    def schema(self, rowid: bool = True) -> str:
        cols = [f"`{c.name}` {c.type}" for c in self.columns]
        return ", ".join([f"{ROWID} bigint", *cols] if rowid else cols)

    def definition(self) -> str:
        """CREATE text from the parts, for tables that were altered."""
        parts = []
        for c in self.columns:
            words = [f'"{c.name}"', c.decl, "NOT NULL" if c.not_null else "", f"DEFAULT {c.default}" if c.default else ""]
            parts.append(" ".join(w for w in words if w))
        named = lambda names: ", ".join(f'"{n}"' for n in names)
        parts += [f"PRIMARY KEY ({named(self.primary)})"] if self.primary else []
        parts += [f"UNIQUE ({named(u)})" for u in self.unique]
        parts += [f"CHECK ({c})" for c in self.checks]
        for f in self.foreign:
            parent = f' ({named(f.parent_columns)})' if f.parent_columns else ""
            parts.append(f'FOREIGN KEY ({named(f.columns)}) REFERENCES "{f.parent}"{parent}')
        return f'CREATE TABLE "{self.name}" ({", ".join(parts)})'

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, d: dict) -> Table:
        tuples = {"columns": Column, "foreign": ForeignKey, "indexes": Index}
        out = dict(d)
        for k, kind in tuples.items():
            out[k] = tuple(kind(**x) for x in d[k])
        for k in ("primary", "checks", "segments"):
            out[k] = tuple(d[k])
        out["unique"] = tuple(tuple(u) for u in d["unique"])
        return cls(**out)


@dataclass(frozen=True)
class Manifest:
    tables: dict[str, Table] = field(default_factory=dict)
    version: int = 0
    watermark: int = 0  # the last change applied from elsewhere
    next_change: int = 1
    next_txn: int = 1
    capture: bool = False

    def to_json(self) -> str:
        return json.dumps({**{k: getattr(self, k) for k in ("version", "watermark", "next_change", "next_txn", "capture")}, "tables": {k: t.to_json() for k, t in self.tables.items()}})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        d = json.loads(text)
        d["tables"] = {k: Table.from_json(t) for k, t in d["tables"].items()}
        return cls(**d)


class Files:
    """The few file operations a store needs: on local paths, else through Hadoop."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.local = root.removeprefix("file://") if root.startswith("file://") or "://" not in root else None
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str) -> str | None:
        if self.local is not None:
            path = os.path.join(self.local, name)
            if not os.path.exists(path):
                return None
            with open(path, encoding="utf-8") as f:
                return f.read()
        fs, p = self._fs(), self._path(name)
        if not fs.exists(p):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect())

    def replace(self, name: str, text: str) -> None:
        """Writes a file and renames it over the old one."""
        new = f".{name}-{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            path = os.path.join(self.local, new)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.replace(path, os.path.join(self.local, name))
            return
        jvm = self.spark.sparkContext._jvm
        out = self._fs().create(self._path(new), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(new), self._path(name), options)

    def exists(self, name: str) -> bool:
        return os.path.exists(os.path.join(self.local, name)) if self.local is not None else self._fs().exists(self._path(name))

    def remove(self, name: str) -> None:
        if self.local is not None:
            shutil.rmtree(os.path.join(self.local, name), ignore_errors=True)
        else:
            self._fs().delete(self._path(name), True)

    def list(self, name: str) -> list[str]:
        if self.local is not None:
            path = os.path.join(self.local, name)
            return sorted(os.listdir(path)) if os.path.isdir(path) else []
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(p)) if self._fs().exists(p) else []


def temporary_root(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, on a local master else a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/polygate-store-{uuid.uuid4().hex[:12]}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir, or give the store a folder that all executors share")
    return tempfile.mkdtemp(prefix="polygate-store-")


class Store:
    """A folder of tables.  ``Store(spark)`` is a temporary one, removed by :meth:`close`."""

    MANIFEST = "manifest.json"

    def __init__(self, spark: SparkSession, root: str | None = None, read_only: bool = False, busy_timeout: float = 5.0) -> None:
        self.temporary = root is None
        self.spark, self.root = spark, (root or temporary_root(spark)).rstrip("/")
        self.files = Files(spark, self.root)
        self.read_only, self.busy_timeout = read_only, busy_timeout
        self._lock = threading.Lock()
        self._cached: tuple[str, Manifest] | None = None

    def manifest(self) -> Manifest:
        text = self.files.read(self.MANIFEST)
        if text is None:
            return Manifest()
        if self._cached is None or self._cached[0] != text:
            self._cached = (text, Manifest.from_json(text))
        return self._cached[1]

    def segment(self, table: str) -> str:
        """A fresh relative path for a segment."""
        return f"data/{table.lower()}/{uuid.uuid4().hex}"

    def read(self, spark: SparkSession, table: Table) -> DataFrame:
        """A table version's rows with their row ids."""
        if not table.segments:
            return spark.createDataFrame([], table.schema())
        return spark.read.schema(table.schema()).parquet(*[f"{self.root}/{s}" for s in table.segments])

    def touched(self, spark: SparkSession, table: Table, ids: DataFrame) -> tuple[Table, tuple[str, ...]]:
        """The table's files that hold a row of ``ids`` (row ids), as a table, and its other segments as they are.

        Only the row ids are scanned; the driver gets the names of the files touched.
        """
        files_of = lambda s: [s] if s.endswith(".parquet") else [f"{s}/{f}" for f in self.files.list(s) if f.endswith(".parquet")]
        files = {s: files_of(s) for s in table.segments}
        if sum(map(len, files.values())) < 2:
            return table, ()
        name = F.regexp_extract("_metadata.file_path", "([0-9a-f]{32}/[^/]+)$", 1).alias("file")
        scan = spark.read.schema(f"{ROWID} bigint").parquet(*[f"{self.root}/{s}" for s in table.segments]).select(ROWID, name)
        hit = {r.file for r in scan.join(ids.select(ROWID), ROWID, "left_semi").select("file").distinct().collect()}
        mine: list[str] = []
        rest: list[str] = []
        for s, all_ in files.items():
            there = {f for f in all_ if "/".join(f.split("/")[-2:]) in hit}
            mine += sorted(there)
            rest += [f for f in all_ if f not in there] if there else [s]
        return replace(table, segments=tuple(mine)), tuple(rest)

    def stage(self, df: DataFrame, label: str, staged: list[str]) -> DataFrame:
        """Rows written aside and read back, so that they are computed once; the path is added to ``staged``."""
        staged.append(f"stage/{label.lower()}-{uuid.uuid4().hex}")
        path = f"{self.root}/{staged[-1]}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def unstage(self, staged: list[str]) -> None:
        """Removes what was written aside."""
        while staged:
            self.files.remove(staged.pop())

    def write(self, df: DataFrame, table: str) -> str:
        path = self.segment(table)
        df.write.parquet(f"{self.root}/{path}")
        return path

    @contextlib.contextmanager
    def exclusive(self) -> Iterator[None]:
        """One committer at a time, in this process and, on local paths, among processes; waits for the busy timeout."""
        if self.read_only:
            raise ReadOnlyError("attempt to write a readonly database")
        end = time.monotonic() + self.busy_timeout
        if not self._lock.acquire(timeout=self.busy_timeout):
            raise BusyError("database is locked")
        handle = None
        try:
            if self.files.local is not None:
                import fcntl

                os.makedirs(self.files.local, exist_ok=True)
                handle = open(os.path.join(self.files.local, ".lock"), "a")  # noqa: SIM115
                while True:
                    try:
                        fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
                        break
                    except OSError:
                        if time.monotonic() > end:
                            raise BusyError("database is locked") from None
                        time.sleep(0.02)
            yield
        finally:
            if handle is not None:
                handle.close()
            self._lock.release()

    def commit(self, base: Manifest, written: dict[str, Table | None], changes: list[tuple] = (), watermark: int | None = None, capture: bool | None = None, log=None) -> Manifest:
        """Publishes new versions of tables (None drops one); conflicts with later versions raise BusyError.

        changes: (type, table, rows) of the change log, rows being a DataFrame of (id, before, after) or None;
        ``log(manifest, changes)`` writes them and returns the number used.
        """
        with self.exclusive():
            now = self.manifest()
            for name in written:
                was, is_ = base.tables.get(name), now.tables.get(name)
                if (was.version if was else -1) != (is_.version if is_ else -1):
                    raise BusyError(f"database is locked: {name} was changed by another transaction")
            tables = dict(now.tables)
            for name, t in written.items():
                if t is None:
                    tables.pop(name, None)
                else:
                    tables[name] = replace(t, version=now.version + 1)
            new = replace(now, tables=tables, version=now.version + 1)
            if watermark is not None:
                new = replace(new, watermark=watermark)
            if capture is not None:
                new = replace(new, capture=capture)
            if log is not None and now.capture and changes:
                used = log(now, changes)
                new = replace(new, next_change=now.next_change + used, next_txn=now.next_txn + 1)
            self.files.replace(self.MANIFEST, new.to_json())
            return new

    def vacuum(self) -> int:
        """Rewrites tables of many segments as one and removes segments that no table uses; returns how many went."""
        base = self.manifest()
        written = {n: replace(t, segments=(self.write(self.read(self.spark, t), n),)) for n, t in base.tables.items() if len(t.segments) > 1}
        now = self.commit(base, written) if written else base
        used = {"/".join(s.split("/")[:3]) for t in now.tables.values() for s in t.segments}
        gone = 0
        for table in self.files.list("data"):
            for s in self.files.list(f"data/{table}"):
                if f"data/{table}/{s}" not in used:
                    self.files.remove(f"data/{table}/{s}")
                    gone += 1
        return gone

    def close(self) -> None:
        if self.temporary:
            self.files.remove("")
