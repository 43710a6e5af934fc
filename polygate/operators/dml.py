"""INSERT, UPDATE, DELETE and their kin as DataFrame operators over table versions.

Each returns the table's next version; nothing is published here.  Rows are told apart by a hidden row id.  Conflicts and
constraints are joins and grouped counts, so they hold for a statement of any size; what reaches the driver is a count,
one row for each partition, or one offending row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polygate.dialect import quote, to_spark
from polygate.errors import CheckViolation, EngineError, ForeignKeyViolation, NotNullViolation, SqlSyntaxError, UniqueViolation
from polygate.lexer import Dialect, Token, significant
from polygate.plans.statements import Delete, Insert, Update
from polygate.sources.store import ROWID, Store, Table

INSERTED, UPDATED, DELETED = 1, 0, -1


@dataclass
class Context:
    """What an operator may ask of its session."""

    spark: SparkSession
    store: Store
    dialect: Dialect
    sql: Callable[[str], DataFrame]  # runs Spark SQL with the statement's parameters bound
    table: Callable[[str], Table]
    tables: Callable[[], dict[str, Table]]
    capture: bool = False
    staged: list[str] = field(default_factory=list)  # what the statement wrote aside; it goes when the transaction ends

    def stage(self, df: DataFrame, table: Table) -> DataFrame:
        return self.store.stage(df, table.name, self.staged)

    def expr(self, tokens: list[Token]) -> str:
        return to_spark(tokens, self.dialect, named=False).text

    def frame(self, table: Table) -> DataFrame:
        return self.store.read(self.spark, table)


@dataclass
class Outcome:
    table: Table
    affected: int
    last_id: int | None = None
    changes: list[tuple[int, str, DataFrame]] = field(default_factory=list)
    rows: DataFrame | None = None  # the rows inserted, updated or deleted, for RETURNING


def indexed(store: Store, df: DataFrame, table: str, staged: list[str]) -> tuple[DataFrame, int]:
    """The rows, written once, with a gapless ``__idx`` from 0, and their number: offsets come from partition counts."""
    marked = df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__mono"))
    kept = store.stage(marked, table, staged)
    offsets, total = [], 0
    for r in sorted(kept.groupBy("__part").agg(F.count("*").alias("n"), F.min("__mono").alias("least")).collect()):
        offsets.append((r["__part"], total - r.least))
        total += r.n
    shift = df.sparkSession.createDataFrame(offsets, "__part int, __shift long")
    return kept.join(F.broadcast(shift), "__part").withColumn("__idx", F.col("__mono") + F.col("__shift")).drop("__part", "__mono", "__shift"), total


def _key(columns: tuple[str, ...]) -> list[Column]:
    return [F.col(quote(c)) for c in columns]


def _full(columns: tuple[str, ...]) -> Column:
    """Keys with a null never conflict."""
    out = F.lit(True)
    for c in _key(columns):
        out = out & c.isNotNull()
    return out


def check_unique(ctx: Context, table: Table, rows: DataFrame, keys: list[tuple[str, ...]], new: DataFrame | None = None) -> None:
    """Raises for the first key whose columns repeat in ``rows``; with ``new`` only values of these rows are looked at."""
    for columns in keys:
        mine = rows.where(_full(columns)).select(*_key(columns))
        if new is not None:
            mine = mine.join(new.where(_full(columns)).select(*_key(columns)).distinct(), list(columns), "left_semi")
        bad = mine.groupBy(*_key(columns)).agg(F.count("*").alias("__n")).where("__n > 1").select(*_key(columns)).first()
        if bad is not None:
            raise UniqueViolation("-".join(map(str, bad)), ", ".join(f"{table.name}.{c}" for c in columns))


def check_rows(ctx: Context, table: Table, rows: DataFrame) -> None:
    """NOT NULL, CHECK and foreign keys of new rows."""
    needed = [c.name for c in table.columns if c.not_null]
    counts = [F.count_if(F.col(quote(c)).isNull()).alias(f"n{i}") for i, c in enumerate(needed)]
    counts += [F.count_if(~F.expr(c)).alias(f"c{i}") for i, c in enumerate(table.checks)]
    if counts:
        r = rows.agg(*counts).first()
        for i, c in enumerate(needed):
            if r[f"n{i}"]:
                raise NotNullViolation(f"NOT NULL constraint failed: {table.name}.{c}")
        for i, c in enumerate(table.checks):
            if r[f"c{i}"]:
                raise CheckViolation(f"CHECK constraint failed: {c}")
    for f in table.foreign:
        parent = table if f.parent.lower() == table.name.lower() else ctx.table(f.parent)
        frame = ctx.frame(parent)
        if parent is table:
            frame = frame.unionByName(rows.select(*frame.columns))
        _no_orphans(rows, table, f, frame, parent)


def _no_orphans(children: DataFrame, table: Table, f, parents: DataFrame, parent: Table) -> None:
    theirs = list(f.parent_columns or parent.primary)
    keys = parents.select(*[F.col(quote(c)).alias(f"__k{i}") for i, c in enumerate(theirs)]).distinct()
    mine = children.where(_full(tuple(f.columns)))
    cond = [F.col(quote(c)) == F.col(f"__k{i}") for i, c in enumerate(f.columns)]
    if not mine.join(keys, cond, "left_anti").isEmpty():
        raise ForeignKeyViolation(f"FOREIGN KEY constraint failed: {table.name}({', '.join(f.columns)})")


def check_children(ctx: Context, table: Table, before: DataFrame, after: DataFrame, moved: set[str] | None = None) -> None:
    """No other table refers to a key that rows had before and none has now; with ``moved`` only those columns changed."""
    for other in ctx.tables().values():
        for f in other.foreign:
            theirs = tuple(f.parent_columns or table.primary)
            if f.parent.lower() != table.name.lower() or other.name.lower() == table.name.lower() or moved is not None and not moved & {c.lower() for c in theirs}:
                continue
            gone = before.where(_full(theirs)).select(*_key(theirs)).distinct().join(after.select(*_key(theirs)), list(theirs), "left_anti")
            gone = gone.select(*[c.alias(f"__k{i}") for i, c in enumerate(_key(theirs))])
            cond = [F.col(quote(c)) == F.col(f"__k{i}") for i, c in enumerate(f.columns)]
            if not ctx.frame(other).join(gone, cond, "left_semi").isEmpty():
                raise ForeignKeyViolation(f"FOREIGN KEY constraint failed: {other.name}({', '.join(f.columns)})")


def _json(table: Table, prefix: str = "") -> Column:
    return F.to_json(F.struct(*[F.col(quote(prefix + c.name)).alias(c.name) for c in table.columns]), {"ignoreNullFields": "false"})


def _null() -> Column:
    return F.lit(None).cast("string")


def inserted(table: Table, rows: DataFrame) -> DataFrame:
    """(id, before, after) of new rows, for the change log."""
    return rows.select(F.col(ROWID).alias("id"), _null().alias("before"), _json(table).alias("after"))


def deleted(table: Table, rows: DataFrame) -> DataFrame:
    """(id, before, after) of rows that go."""
    return rows.select(F.col(ROWID).alias("id"), _json(table).alias("before"), _null().alias("after"))


def reshaped(frame: DataFrame, old: Table, new: Table) -> DataFrame:
    """The rows of ``old`` in the columns of ``new``: by name, by place where one was renamed, else the default."""
    have = {c.name.lower(): c.name for c in old.columns}
    out = [F.col(ROWID)]
    for i, c in enumerate(new.columns):
        if c.name.lower() in have:
            out.append(F.col(quote(have[c.name.lower()])).alias(c.name))
        elif len(old.columns) == len(new.columns):
            out.append(F.col(quote(old.columns[i].name)).alias(c.name))
        else:
            out.append(F.expr(f"CAST({c.default or 'NULL'} AS {c.type})").alias(c.name))
    return frame.select(*out)


# --- insert ---------------------------------------------------------------------------------------------------------


def _source(ctx: Context, table: Table, ins: Insert) -> DataFrame:
    """The rows to insert, in the table's columns and types; columns left out get defaults."""
    names = [c.name for c in table.columns]
    by = {n.lower(): c for n, c in zip(names, table.columns)}
    given = [c.lower() for c in (ins.columns if ins.columns is not None else names)]
    for c in given:
        if c not in by:
            raise EngineError(f"table {table.name} has no column named {c}")
    default = {c.name.lower(): f"CAST({c.default or 'NULL'} AS {c.type})" for c in table.columns}
    if ins.rows is not None:
        cells = []
        for row in ins.rows:
            if len(row) != len(given):
                raise SqlSyntaxError(f"{len(row)} values for {len(given)} columns")
            texts = dict(default)
            for c, v in zip(given, row):
                word = significant(v)
                plain = len(word) == 1 and word[0].is_("DEFAULT")
                texts[c] = default[c] if plain else f"CAST({ctx.expr(v)} AS {by[c].type})"
            cells.append([texts[n.lower()] for n in names])
        try:
            values = ", ".join("(" + ", ".join(r) + ")" for r in cells)
            return ctx.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(map(quote, names))})")
        except Exception:
            heads = [", ".join(f"{e} AS {quote(n)}" for e, n in zip(r, names)) for r in cells]
            return ctx.sql(" UNION ALL ".join(f"SELECT {h}" for h in heads))
    query = ctx.sql(to_spark(ins.query, ctx.dialect).text)  # named, else ORDER BY takes the cast of a column for the column
    if len(query.columns) != len(given):
        raise SqlSyntaxError(f"{len(query.columns)} columns for {len(given)}")
    query = query.toDF(*[f"__c{i}" for i in range(len(given))])
    at = {c: i for i, c in enumerate(given)}
    return query.select(*[(F.col(f"__c{at[n.lower()]}").cast(by[n.lower()].type) if n.lower() in at else F.expr(default[n.lower()])).alias(n) for n in names])


def _numbered(ctx: Context, table: Table, df: DataFrame) -> tuple[DataFrame, int]:
    """The rows with row ids and a sequence, and their number."""
    rows, n = indexed(ctx.store, df, table.name, ctx.staged)
    alias = table.rowid_alias
    auto = next((c.name for c in table.columns if c.autoinc), None) or alias
    base = table.next_rowid
    if auto and n:
        most = rows.agg(F.max(quote(auto))).first()[0]
        base = max(base, (most or 0) + 1)
    fresh = F.lit(base) + F.col("__idx")
    if auto:
        rows = rows.withColumn(auto, F.coalesce(F.col(quote(auto)), fresh))
    rows = rows.withColumn(ROWID, F.col(quote(alias)) if alias else fresh)
    return rows.withColumnRenamed("__idx", "__seq"), n


def _first_of(rows: DataFrame, key: tuple[str, ...], last: bool = False) -> DataFrame:
    """The first (or last) row by sequence of each value of a key; rows with a null in it all stay."""
    order = F.col("__seq").desc() if last else F.col("__seq")
    full = rows.where(_full(key)).withColumn("__r", F.row_number().over(Window.partitionBy(*_key(key)).orderBy(order))).where("__r = 1").drop("__r")
    return full.unionByName(rows.where(~_full(key)))


def _clash(existing: DataFrame, new: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """(row id, sequence) of existing and new rows that share a key."""
    out = None
    for key in keys:
        a = existing.where(_full(key)).select(ROWID, *[F.col(quote(c)).alias(f"__k{i}") for i, c in enumerate(key)])
        b = new.where(_full(key)).select("__seq", *[F.col(quote(c)).alias(f"__k{i}") for i, c in enumerate(key)])
        pairs = a.join(b, [f"__k{i}" for i in range(len(key))]).select(ROWID, "__seq")
        out = pairs if out is None else out.union(pairs)
    return out


def insert(ctx: Context, table: Table, ins: Insert) -> Outcome:
    new, n = _numbered(ctx, table, _source(ctx, table, ins))
    cols = [ROWID, *[c.name for c in table.columns]]
    keys = [tuple(k) for k in table.keys]
    existing = ctx.frame(table)
    aimed = [k for k in keys if not ins.target or sorted(c.lower() for c in k) == sorted(c.lower() for c in ins.target)]
    if ins.target and not aimed:
        raise EngineError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint")
    changes: list[tuple[int, str, DataFrame]] = []
    affected, gone = n, None
    if ins.conflict == "update" and aimed:
        return _upsert(ctx, table, ins, new, existing, aimed)
    if ins.conflict == "ignore" and keys:
        for k in aimed:
            new = _first_of(new, k)
        new = new.join(_clash(existing, new, aimed), "__seq", "left_anti")
        new, affected = _kept(ctx, table, new)
    elif ins.conflict == "replace" and keys:
        for k in keys:
            new = _first_of(new, k, last=True)
        gone = ctx.stage(_clash(existing, new, keys).select(ROWID).distinct(), table)
    if ins.conflict not in ("ignore", "replace") or ins.target:
        for k in keys:
            old = existing.select(*_key(k))
            if not new.where(_full(k)).isEmpty():
                touched = old.join(new.select(*_key(k)), list(k), "left_semi")
                check_unique(ctx, table, touched.unionByName(new.select(*_key(k))), [k])
    check_rows(ctx, table, new)
    segments = table.segments
    if gone is not None and not gone.isEmpty():
        if ctx.capture:
            changes.append((DELETED, table.name, deleted(table, existing.join(gone, ROWID, "left_semi"))))
        mine, rest = ctx.store.touched(ctx.spark, table, gone)
        segments = (*rest, ctx.store.write(ctx.frame(mine).join(gone, ROWID, "left_anti").select(*cols), table.name))
    segment = ctx.store.write(new.select(*cols), table.name)
    written = ctx.spark.read.schema(table.schema()).parquet(f"{ctx.store.root}/{segment}")
    r = new.agg(F.max(ROWID).alias("most"), F.max_by(ROWID, "__seq").alias("last")).first()
    if ctx.capture:
        changes.append((INSERTED, table.name, inserted(table, written)))
    out = replace(table, segments=(*segments, segment), next_rowid=max(table.next_rowid, (r.most or 0) + 1))
    return Outcome(out, affected, r.last, changes, written)


def _kept(ctx: Context, table: Table, new: DataFrame) -> tuple[DataFrame, int]:
    new = ctx.stage(new, table)
    return new, new.count()


def _qualified(ctx: Context, table: Table, tokens: list[Token]) -> str:
    """An update's value in an upsert: plain columns mean the existing row, VALUES(c) and excluded.c the new one."""
    names = {c.name.lower() for c in table.columns}
    out: list[Token] = []
    sig = significant(tokens)
    i = 0
    while i < len(sig):
        t = sig[i]
        after = sig[i + 1] if i + 1 < len(sig) else Token("op", ";")
        if t.is_("VALUES") and after.op("(") and i + 3 < len(sig) and sig[i + 3].op(")"):
            out += [Token("word", "excluded"), Token("op", "."), Token("ident", "", sig[i + 2].value)]
            i += 4
            continue
        dotted = i > 0 and sig[i - 1].op(".") or after.op(".")
        if t.kind in ("word", "ident") and not dotted and not after.op("(") and t.value.lower() in names:
            out += [Token("ident", "", table.name), Token("op", "."), Token("ident", "", t.value)]
        else:
            out.append(t)
        i += 1
    glued: list[Token] = []
    for t in out:
        if glued and not t.op(".") and not glued[-1].op("."):
            glued.append(Token("space", " "))
        glued.append(t)
    return ctx.expr(glued)


def _upsert(ctx: Context, table: Table, ins: Insert, new: DataFrame, existing: DataFrame, keys: list[tuple[str, ...]]) -> Outcome:
    """Rows that clash update the row they meet, others are inserted; rows that repeat a key go one after the other.

    With one key that the update leaves alone, the rows of a key are folded into the row they meet, so a key may repeat at
    will; otherwise a round is run for each repeat.
    """
    new, n = _kept(ctx, table, new)
    if not n:
        return Outcome(table, 0)
    names = {c.name.lower(): c for c in table.columns}
    sets = {names[c.lower()].name: f"CAST({_qualified(ctx, table, v)} AS {names[c.lower()].type})" for c, v in ins.updates}
    where = _qualified(ctx, table, ins.where) if ins.where else None
    if len(table.keys) == 1 and not set(sets) & set(keys[0]):
        merged = _folded(ctx, table, new, existing, keys[0], sets, where)
        if merged is not None:
            return _merged(ctx, table, new, n, merged, keys[0], sets)
    return _rounds(ctx, table, new, n, keys, sets, where)


def _folded(ctx: Context, table: Table, new: DataFrame, existing: DataFrame, key: tuple[str, ...], sets: dict[str, str], where: str | None) -> DataFrame | None:
    """(__met, row id, first, was, now) for each value of the key: the row met or else the first new one, and what the others
    make of it.  None if the assignments can't be folded, as those with subqueries.
    """
    t, cols = quote(table.name), [ROWID, *[c.name for c in table.columns]]
    whole = F.struct("__seq", *map(quote, cols)).alias("row")
    by = [F.col(quote(c)).alias(f"__k{i}") for i, c in enumerate(key)]
    rows = new.where(_full(key)).select(*by, whole)
    reads = re.compile(rf"(?<![\w`.])`?{re.escape(table.name)}`?\s*\.", re.IGNORECASE)
    if where is None and not any(reads.search(e) for e in sets.values()):  # the last row alone decides
        least, most = F.min("row").alias("a"), F.max("row").alias("b")
        lists = rows.groupBy(*[f"__k{i}" for i in range(len(key))]).agg(least, most).withColumn("rows", F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).drop("a", "b")
    else:
        lists = rows.groupBy(*[f"__k{i}" for i in range(len(key))]).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    lonely = new.where(~_full(key)).select(*by, F.array(whole).alias("rows"))
    old = existing.where(_full(key)).select(*by, F.struct(*map(quote, cols)).alias("met"))
    joined = lists.join(old, [f"__k{i}" for i in range(len(key))], "left").unionByName(lonely, allowMissingColumns=True)
    plain = lambda row: F.struct(*[row[c].alias(c) for c in cols])
    joined = joined.select("rows", "met", F.coalesce("met", plain(F.col("rows")[0])).alias("was"), F.when(F.col("met").isNull(), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows")).alias("others"))
    made = ", ".join(f"'{c}', {sets.get(c, f'{t}.{quote(c)}')}" for c in cols)
    one = f"named_struct({made})"
    one = one if where is None else f"IF(COALESCE({where}, FALSE), {one}, {t})"
    joined.createOrReplaceTempView("__folds")
    try:
        out = ctx.sql(f"SELECT met.{ROWID} AS __met, was.{ROWID} AS __id, rows[0] AS first, was, aggregate(others, was, ({t}, excluded) -> {one}) AS now FROM __folds")
        return ctx.stage(out, table)
    except Exception as e:
        if isinstance(e, EngineError) or "lambda" not in str(e).lower() and "higher" not in str(e).lower() and "subquery" not in str(e).lower():
            raise
        return None


def _merged(ctx: Context, table: Table, new: DataFrame, n: int, merged: DataFrame, key: tuple[str, ...], sets: dict[str, str]) -> Outcome:
    """Writes what a fold made: files with a row that was met are written anew, the other rows are a new segment."""
    cols = [ROWID, *[c.name for c in table.columns]]
    of = lambda row, where: merged.where(where).select(*[F.col(f"{row}.{quote(c)}").alias(c) for c in cols])
    fresh, met = of("now", "__met IS NULL"), of("now", "__met IS NOT NULL")
    check_rows(ctx, table, of("first", "__met IS NULL"))
    check_rows(ctx, table, fresh.unionByName(met))
    mine, rest = ctx.store.touched(ctx.spark, table, met)
    kept = ctx.frame(mine).join(met, ROWID, "left_anti").select(*cols)
    segment = ctx.store.write(kept.unionByName(met).unionByName(fresh), table.name)
    most = fresh.agg(F.max(ROWID)).first()[0] or 0
    out = replace(table, segments=(*rest, segment), next_rowid=max(table.next_rowid, most + 1))
    check_children(ctx, table, of("was", "__met IS NOT NULL"), ctx.frame(out), {c.lower() for c in sets})
    ids = merged.select("__id", *[F.col(f"now.{quote(c)}").alias(f"__k{i}") for i, c in enumerate(key)])
    end = new.orderBy(F.col("__seq").desc()).limit(1).select(F.col(ROWID).alias("__own"), *[F.col(quote(c)).alias(f"__k{i}") for i, c in enumerate(key)])
    last = end.join(ids, [f"__k{i}" for i in range(len(key))], "left").select(F.coalesce("__id", "__own")).first()[0]
    changes = []
    if ctx.capture:
        text = lambda row: F.to_json(F.struct(*[F.col(f"{row}.{quote(c)}").alias(c) for c in cols[1:]]), {"ignoreNullFields": "false"})
        both = merged.where("__met IS NOT NULL").select(F.col("__met").alias("id"), text("was").alias("before"), text("now").alias("after"))
        changes = [(UPDATED, table.name, both), (INSERTED, table.name, inserted(table, fresh))]
    rows = ctx.spark.read.schema(table.schema()).parquet(f"{ctx.store.root}/{segment}").join(merged.select(F.col("__id").alias(ROWID)), ROWID, "left_semi")
    return Outcome(out, n, last, changes, rows)


def _rounds(ctx: Context, table: Table, new: DataFrame, n: int, keys: list[tuple[str, ...]], sets: dict[str, str], where: str | None) -> Outcome:
    """The n-th rows of each key together, one round after the other."""
    turn = F.lit(1)
    for k in keys:
        turn = F.greatest(turn, F.when(_full(k), F.row_number().over(Window.partitionBy(*_key(k)).orderBy("__seq"))).otherwise(1))
    new = ctx.stage(new.withColumn("__turn", turn), table)
    rounds = new.agg(F.max("__turn")).first()[0]
    cols = [ROWID, *[c.name for c in table.columns]]
    changes: list[tuple[int, str, DataFrame]] = []
    last, touched = None, None
    made, t = ", ".join(f"{e} AS {quote('__n_' + c)}" for c, e in sets.items()), quote(table.name)
    cond = f" WHERE {where}" if where else ""
    for r in range(1, rounds + 1):
        mine = new.where(F.col("__turn") == r).drop("__turn")
        frame = ctx.frame(table)
        met = _clash(frame, mine, keys).groupBy("__seq").agg(F.min(ROWID).alias("__met"))
        mine = ctx.stage(mine.join(met, "__seq", "left"), table)
        frame.createOrReplaceTempView("__existing")
        mine.where("__met is not null").createOrReplaceTempView("__incoming")
        changed = ctx.sql(f"SELECT {t}.{ROWID}, {made} FROM __existing AS {t} JOIN __incoming AS excluded ON {t}.{ROWID} = excluded.__met{cond}")
        changed = ctx.stage(changed.dropDuplicates([ROWID]), table)
        part, rest = ctx.store.touched(ctx.spark, table, changed)
        after, delta = _apply(ctx, table, ctx.frame(part), changed, list(sets))
        fresh = mine.where("__met is null").select(*cols)
        check_rows(ctx, table, fresh)
        if ctx.capture:
            changes += [(UPDATED, table.name, delta), (INSERTED, table.name, inserted(table, fresh))]
        segment = ctx.store.write(after.select(*cols).unionByName(fresh), table.name)
        before = ctx.frame(part).join(changed.select(ROWID), ROWID, "left_semi")
        most = fresh.agg(F.max(ROWID)).first()[0] or 0
        table = replace(table, segments=(*rest, segment), next_rowid=max(table.next_rowid, most + 1))
        check_children(ctx, table, before, ctx.frame(table), {c.lower() for c in sets})
        touched = mine.select(F.coalesce("__met", ROWID).alias(ROWID), "__seq")
        seen = touched.agg(F.max_by(ROWID, "__seq")).first()[0]
        last = seen if seen is not None else last
        written = ctx.frame(table)
        rows = written.join(touched.select(ROWID), ROWID, "left_semi")
        check_unique(ctx, table, written, [tuple(k) for k in table.keys], rows)
        check_rows(ctx, table, rows)
    return Outcome(table, n, last, changes, rows)


# --- update and delete ----------------------------------------------------------------------------------------------


def _apply(ctx: Context, table: Table, frame: DataFrame, changed: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The frame with changed rows (row id, __n_<column>), and (id, before, after) of those."""
    changed = changed.withColumnRenamed(ROWID, "__id")
    joined = frame.join(changed, F.col(ROWID) == F.col("__id"), "left")
    lower = {n.lower() for n in names}
    new = [F.when(F.col("__id").isNotNull(), F.col(quote("__n_" + c.name))).otherwise(F.col(quote(c.name))).alias(c.name) if c.name.lower() in lower else F.col(quote(c.name)) for c in table.columns]
    alias = table.rowid_alias
    rowid = F.coalesce(F.col(quote("__n_" + alias)), F.col(ROWID)).alias(ROWID) if alias and alias.lower() in lower else F.col(ROWID)
    after = [F.col(quote("__n_" + c.name)).alias(c.name) if c.name.lower() in lower else F.col(quote(c.name)).alias(c.name) for c in table.columns]
    delta = joined.where("__id is not null").select(F.col("__id").alias("id"), _json(table).alias("before"), F.to_json(F.struct(*after), {"ignoreNullFields": "false"}).alias("after"))
    return joined.select(rowid, *new), delta


def _target(ctx: Context, table: Table, alias: str | None) -> str:
    ctx.frame(table).createOrReplaceTempView("__target")
    return f"__target AS {quote(alias or table.name)}"


def update(ctx: Context, table: Table, u: Update) -> Outcome:
    types = {c.name.lower(): c for c in table.columns}
    for c, _ in u.sets:
        if c.lower() not in types:
            raise EngineError(f"no such column: {c}")
    sets = ", ".join(f"CAST({ctx.expr(v)} AS {types[c.lower()].type}) AS {quote('__n_' + types[c.lower()].name)}" for c, v in u.sets)
    where = f" WHERE {ctx.expr(u.where)}" if u.where else ""
    changed = ctx.sql(f"SELECT {ROWID}, {sets} FROM {_target(ctx, table, u.alias)}{where}")
    changed = ctx.stage(changed, table)
    n = changed.count()
    if not n:
        return Outcome(table, 0, rows=ctx.frame(table).limit(0))
    names = [types[c.lower()].name for c, _ in u.sets]
    mine, rest = ctx.store.touched(ctx.spark, table, changed)
    frame, delta = _apply(ctx, table, ctx.frame(mine), changed, names)
    out = replace(table, segments=(*rest, ctx.store.write(frame, table.name)))
    written = ctx.frame(out)
    moved = {x.lower() for x in names}
    keys = [tuple(k) for k in table.keys if moved & {c.lower() for c in k}]
    alias = table.rowid_alias
    ids = changed.select(F.coalesce(F.col(quote("__n_" + alias)), F.col(ROWID)).alias(ROWID)) if alias and alias.lower() in moved else changed.select(ROWID)
    rows = written.join(ids, ROWID, "left_semi")
    check_unique(ctx, table, written, keys, rows)
    check_rows(ctx, table, rows)
    if alias and alias.lower() in moved:
        out = replace(out, next_rowid=max(table.next_rowid, (rows.agg(F.max(ROWID)).first()[0] or 0) + 1))
    check_children(ctx, table, ctx.frame(mine).join(changed.select(ROWID), ROWID, "left_semi"), written, moved)
    return Outcome(out, n, None, [(UPDATED, table.name, delta)] if ctx.capture else [], rows)


def delete(ctx: Context, table: Table, d: Delete) -> Outcome:
    where = f" WHERE {ctx.expr(d.where)}" if d.where else ""
    ids = ctx.sql(f"SELECT {ROWID} FROM {_target(ctx, table, d.alias)}{where}")
    ids = ctx.stage(ids, table)
    n = ids.count()
    if not n:
        return Outcome(table, 0, rows=ctx.frame(table).limit(0))
    if d.where is None:
        out, rows = replace(table, segments=()), ctx.frame(table)
    else:
        mine, rest = ctx.store.touched(ctx.spark, table, ids)
        frame = ctx.frame(mine)
        rows = frame.join(ids, ROWID, "left_semi")
        out = replace(table, segments=(*rest, ctx.store.write(frame.join(ids, ROWID, "left_anti").select(*frame.columns), table.name)))
    check_children(ctx, table, rows, ctx.frame(out))
    changes = [(DELETED, table.name, deleted(table, rows))] if ctx.capture else []
    return Outcome(out, n, None, changes, rows)


__all__ = ["Context", "Outcome", "delete", "indexed", "insert", "update"]
