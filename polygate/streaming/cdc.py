"""Change data capture: a transactional log, a tailer, and an idempotent apply, in batch or as a stream.

With capture on, each commit appends its changes (full rows before and after) and a COMMIT row to the log, under its
transaction's own folder, before the manifest that publishes it; a crash between the two leaves a folder that the next
transaction of that number overwrites and that readers skip, since the manifest doesn't count it.  A replica applies a
transaction's tables and its watermark in one manifest, so applying twice changes nothing.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polygate.dialect import quote
from polygate.errors import EngineError, SqlSyntaxError, UnsupportedError
from polygate.lexer import Dialect, lex, significant, split_statements
from polygate.operators.dml import indexed, reshaped
from polygate.plans import statements
from polygate.sources.store import ROWID, Manifest, Store, Table

INSERT, UPDATE, DELETE, COMMIT = 1, 0, -1, 2
SCHEMA_TABLE = "sqlite_schema"
SCHEMA = "change_id long, change_txn_id long, change_type int, table_name string, id long, before string, after string, updates string"
LOG = "cdc"


def enable_cdc(store: Store, on: bool = True) -> None:
    """Captures all later commits."""
    store.commit(store.manifest(), {}, capture=on)


def write_log(spark: SparkSession, store: Store, manifest: Manifest, changes: list[tuple[int, str, DataFrame]]) -> int:
    """Writes one transaction's changes and its COMMIT row; returns how many change ids it used."""
    base, out = manifest.next_change, None
    staged: list[str] = []
    for kind, table, rows in changes:
        updates = F.col("updates") if "updates" in rows.columns else F.lit(None).cast("string").alias("updates")
        rows = rows.select("id", "before", "after", updates)
        numbered, n = (rows.withColumn("__idx", F.lit(0)), 1) if table == SCHEMA_TABLE else indexed(store, rows, table, staged)  # a schema change is one row
        part = numbered.select(
            (F.lit(base) + F.col("__idx")).alias("change_id"), F.lit(manifest.next_txn).cast("long").alias("change_txn_id"), F.lit(kind).alias("change_type"),
            F.lit(table).alias("table_name"), F.col("id").cast("long").alias("id"), "before", "after", "updates",
        )
        base += n
        out = part if out is None else out.unionByName(part)
    end = spark.createDataFrame([(base, manifest.next_txn, COMMIT, None, None, None, None, None)], SCHEMA)
    out = end if out is None else out.unionByName(end)
    out.write.mode("overwrite").parquet(f"{store.root}/{LOG}/txn={manifest.next_txn:012d}")
    store.unstage(staged)
    return base + 1 - manifest.next_change


@dataclass
class Batch:
    """One transaction: its changes, without the COMMIT row, and that row's change id."""

    changes: DataFrame
    commit_id: int
    txn_id: int


class CdcTailer:
    """Reads a store's log transaction by transaction, after a given change."""

    def __init__(self, spark: SparkSession, store: Store, after: int = 0) -> None:
        self.spark, self.store, self.cursor = spark, store, after
        self.txn: int | None = None  # the transaction to look at next

    def poll_batch(self) -> Batch | None:
        """The next whole transaction, however long; None if there is none yet.  The cursor moves to its end.

        The log is a folder for each transaction, in order: once the cursor's place is known, a poll opens one folder.
        """
        m = self.store.manifest()
        if self.cursor >= m.next_change - 1:
            return None
        if self.txn is None:
            self.txn = self._first(m)
        while self.txn < m.next_txn:
            txn, self.txn = self.txn, self.txn + 1
            if not self.store.files.exists(f"{LOG}/txn={txn:012d}"):
                continue
            log = self.spark.read.schema(SCHEMA).parquet(f"{self.store.root}/{LOG}/txn={txn:012d}")
            newest = txn == m.next_txn - 1  # its COMMIT row is the log's last
            end = m.next_change - 1 if newest else log.where(F.col("change_type") == COMMIT).select("change_id").first().change_id
            if end > self.cursor:
                changes = log.where((F.col("change_id") > self.cursor) & (F.col("change_type") != COMMIT))
                self.cursor = end
                return Batch(changes, end, txn)
        return None

    def _first(self, m: Manifest) -> int:
        """The first transaction that ends after the cursor, by bisection over the folders' COMMIT rows."""
        have = [int(f[4:]) for f in self.store.files.list(LOG) if f.startswith("txn=") and int(f[4:]) < m.next_txn]
        low, high = 0, len(have) if self.cursor else 0
        while low < high:
            mid = (low + high) // 2
            log = self.spark.read.schema(SCHEMA).parquet(f"{self.store.root}/{LOG}/txn={have[mid]:012d}")
            low, high = (mid + 1, high) if log.where(F.col("change_type") == COMMIT).first().change_id <= self.cursor else (low, mid)
        return have[low] if low < len(have) else m.next_txn


def read_watermark(store: Store) -> int:
    """The last change that a replica has applied, 0 for none."""
    return store.manifest().watermark


_ALLOWED = re.compile(r"CREATE (TABLE|UNIQUE INDEX|INDEX|VIEW|TRIGGER)\b")


def classify_replayed_ddl(sql: str) -> str:
    """TABLE, INDEX, VIEW or TRIGGER of a single CREATE statement; anything else is refused."""
    try:
        parts = split_statements(lex(sql, Dialect.SQLITE))
    except SqlSyntaxError as e:
        raise UnsupportedError(f"refused to replay: {e}") from None
    if len(parts) != 1:
        raise UnsupportedError("refused to replay: not a single statement")
    words = " ".join(t.upper for t in significant(parts[0])[:3])
    m = _ALLOWED.match(words)
    if m is None:
        raise UnsupportedError(f"refused to replay: {words}")
    return m.group(1).split()[-1]


def apply_batch(spark: SparkSession, replica: Store, batch: Batch) -> bool:
    """Applies a transaction with its watermark, all or nothing; False if it was applied before.

    Schema changes, which are few, part the transaction: rows before one are applied before it.
    """
    base = replica.manifest()
    if batch.commit_id <= base.watermark:
        return False
    written: dict[str, Table | None] = {}
    now = dict(base.tables)
    data = batch.changes.where(F.col("table_name") != SCHEMA_TABLE)
    last = {r.table_name: r.last for r in batch.changes.groupBy("table_name").agg(F.max("id").alias("last")).collect()}  # tables of one transaction
    at = 0
    schema = batch.changes.where(F.col("table_name") == SCHEMA_TABLE).orderBy("change_id").collect() if SCHEMA_TABLE in last else []  # one row for each DDL statement
    if not schema:
        _apply_rows(spark, replica, data, now, written, last)
    for r in schema:
        if at and r.change_id > at + 1:
            _apply_rows(spark, replica, data.where(F.col("change_id").between(at + 1, r.change_id - 1)), now, written)
        elif not at:
            _apply_rows(spark, replica, data.where(F.col("change_id") < r.change_id), now, written)
        _replay(spark, replica, r, now, written)
        at = r.change_id
    if schema and len(last) > 1:
        _apply_rows(spark, replica, data.where(F.col("change_id") > at), now, written)
    replica.commit(base, written, watermark=batch.commit_id)
    return True


def _apply_rows(spark: SparkSession, replica: Store, data: DataFrame, now: dict[str, Table], written: dict[str, Table | None], last_ids: dict[str, int] | None = None) -> None:
    """The last change of a row decides; inserts and updates replace the row of their id, deletes remove it.

    ``last_ids`` has the largest row id by table, if it's known.
    """
    if last_ids is None:
        last_ids = {r.table_name: r.last for r in data.groupBy("table_name").agg(F.max("id").alias("last")).collect()}
    last = data.withColumn("__r", F.row_number().over(Window.partitionBy("table_name", "id").orderBy(F.col("change_id").desc()))).where("__r = 1")
    for name, most in last_ids.items():
        table = now.get(name.lower())
        if table is None:
            raise EngineError(f"no such table: {name}")
        mine = last.where(F.col("table_name") == name)
        ids = mine.select(F.col("id").alias(ROWID))
        part, rest = replica.touched(spark, table, ids)
        frame = replica.read(spark, part)
        kept = frame.join(ids, ROWID, "left_anti").select(*frame.columns)
        schema = ", ".join(f"{quote(c.name)} {c.type}" for c in table.columns)
        put = mine.where(F.col("change_type") != DELETE).select(F.col("id").alias(ROWID), F.from_json("after", schema).alias("row")).select(ROWID, "row.*")
        alias = table.rowid_alias
        if alias:
            put = put.withColumn(ROWID, F.col(quote(alias)))
        new = kept.unionByName(put.select(*frame.columns))
        now[name.lower()] = written[name.lower()] = replace(table, segments=(*rest, replica.write(new, table.name)), next_rowid=max(table.next_rowid, (most or 0) + 1))


def _replay(spark: SparkSession, replica: Store, r, now: dict[str, Table], written: dict[str, Table | None]) -> None:
    """One schema change: the text of a CREATE statement as it is after, with the table's parts where they were logged."""
    parts = json.loads(r.updates) if r.updates else {}
    if r.change_type == DELETE:
        name = parts["table"]["name"] if parts else json.loads(r.before)["name"] if r.before and r.before.startswith("{") else r.before or ""
        if now.pop(name.lower(), None) is not None:
            written[name.lower()] = None
        return
    if r.after is None:
        return
    what = classify_replayed_ddl(r.after)
    if what == "TRIGGER":
        return
    if parts:
        _follow(spark, replica, parts["action"], Table.from_json(parts["table"]), r.before, now, written)
        return
    p = statements.parse(split_statements(lex(r.after, Dialect.MYSQL if "`" in r.after else Dialect.SQLITE))[0], Dialect.SQLITE)
    if isinstance(p, statements.Index):
        t = now[p.table.lower()]
        if all(i.name != p.name for i in t.indexes):
            now[p.table.lower()] = written[p.table.lower()] = replace(t, indexes=(*t.indexes, p))
    elif isinstance(p, statements.CreateTable) and p.name.lower() not in now:
        t = Table(p.name, tuple(p.columns), p.sql, tuple(p.primary), tuple(tuple(u) for u in p.unique), tuple(p.checks), tuple(p.foreign), tuple(p.indexes))
        now[p.name.lower()] = written[p.name.lower()] = t


def _follow(spark: SparkSession, replica: Store, action: str, new: Table, old: str | None, now: dict[str, Table], written: dict[str, Table | None]) -> None:
    """A logged definition over the replica's own rows."""
    name = new.name.lower()
    have = now.get((old or name).lower())
    if action == "create":
        if name in now:
            return
    elif have is None:
        raise EngineError(f"no such table: {old or name}")
    elif action == "rename_table":
        del now[old.lower()]
        written[old.lower()] = None
        new = replace(new, segments=have.segments, next_rowid=have.next_rowid)
    elif action == "reshape" and have.segments:
        new = replace(new, segments=(replica.write(reshaped(replica.read(spark, have), have, new), name),), next_rowid=have.next_rowid)
    else:
        new = replace(new, segments=have.segments, next_rowid=have.next_rowid)
    now[name] = written[name] = new


def replicate(spark: SparkSession, primary: Store, replica: Store) -> int:
    """Applies all transactions that the replica lacks; returns how many."""
    tailer, n = CdcTailer(spark, primary, read_watermark(replica)), 0
    while (batch := tailer.poll_batch()) is not None:
        n += apply_batch(spark, replica, batch)
    return n


def stream(spark: SparkSession, primary: Store, replica: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follows the log as a stream: each micro-batch wakes the tailer, which applies whole transactions in order.

    The replica's own watermark, not the stream's checkpoint, tells what has been applied, so a batch that runs again
    after a crash changes nothing.
    """
    changes = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{primary.root}/{LOG}")

    def wake(df: DataFrame, epoch: int) -> None:
        replicate(spark, primary, replica)

    writer = changes.writeStream.foreachBatch(wake).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
