"""Change capture: replicas equal their primary, replays change nothing, what isn't committed isn't seen."""

import pytest

from polygate import Dialect, Session, Store
from polygate.errors import UnsupportedError
from polygate.streaming import cdc
from polygate.streaming.windows import tumbling

MY = Dialect.MYSQL


@pytest.fixture
def pair(spark):
    a, b = Store(spark), Store(spark)
    cdc.enable_cdc(a)
    yield a, b
    a.close()
    b.close()


def content(spark, store, table="t"):
    return sorted(Session(spark, MY, store).query(f"SELECT * FROM {table}").rows)


def run(s, *statements):
    for sql in statements:
        s.query(sql)


def test_replica_follows(spark, pair):
    a, b = pair
    s = Session(spark, MY, a)
    run(s, "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT NOT NULL)", "INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')", "UPDATE t SET v = 'B' WHERE id = 2", "DELETE FROM t WHERE id = 1")
    assert cdc.replicate(spark, a, b) == 4
    assert content(spark, b) == content(spark, a) == [(2, "B"), (3, "c")]
    assert cdc.replicate(spark, a, b) == 0
    run(s, "REPLACE INTO t VALUES (3, 'z')", "INSERT INTO t VALUES (2, 'q') ON DUPLICATE KEY UPDATE v = CONCAT(v, VALUES(v))")
    cdc.replicate(spark, a, b)
    assert content(spark, b) == [(2, "Bq"), (3, "z")]


def test_tailers_start_after_any_change(spark, pair):
    a, _ = pair
    s = Session(spark, MY, a)
    run(s, "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)", *(f"INSERT INTO t VALUES ({i}, 'a'), ({i + 50}, 'b')" for i in range(5)))
    whole, t = [], cdc.CdcTailer(spark, a)
    while (b := t.poll_batch()) is not None:
        whole.append((b.txn_id, b.commit_id))
    assert len(whole) == 6 and t.poll_batch() is None
    for i, (_, end) in enumerate(whole):
        t = cdc.CdcTailer(spark, a, end)
        b = t.poll_batch()
        assert (b and (b.txn_id, b.commit_id)) == (whole[i + 1] if i + 1 < len(whole) else None)
    run(s, "DELETE FROM t WHERE id = 1")
    b = t.poll_batch()  # one that had nothing to read before
    assert b.changes.count() == 1 and b.txn_id == whole[-1][0] + 1


def test_a_transaction_is_one_batch_and_withheld_until_commit(spark, pair):
    a, b = pair
    s = Session(spark, MY, a)
    run(s, "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)", "BEGIN", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t VALUES (2, 'b')", "UPDATE t SET v = 'x'")
    assert cdc.replicate(spark, a, b) == 1
    assert content(spark, b) == []
    run(s, "COMMIT")
    tailer = cdc.CdcTailer(spark, a, cdc.read_watermark(b))
    batch = tailer.poll_batch()
    assert batch.changes.count() == 4
    assert tailer.poll_batch() is None
    assert cdc.apply_batch(spark, b, batch)
    assert not cdc.apply_batch(spark, b, batch)
    assert cdc.read_watermark(b) == batch.commit_id == tailer.cursor
    assert content(spark, b) == [(1, "x"), (2, "x")]


def test_long_transactions_are_one_batch(spark, pair):
    a, b = pair
    s = Session(spark, MY, a)
    s.register("src", spark.range(5000).selectExpr("id", "CAST(id AS STRING) AS v"))
    run(s, "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)", "INSERT INTO t SELECT id, v FROM src")
    assert cdc.replicate(spark, a, b) == 2
    assert len(content(spark, b)) == 5000


def test_rolled_back_changes_leave_no_trace(spark, pair):
    a, b = pair
    s = Session(spark, MY, a)
    run(s, "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)", "BEGIN", "INSERT INTO t VALUES (1, 'a')", "ROLLBACK", "INSERT INTO t VALUES (2, 'b')")
    cdc.replicate(spark, a, b)
    assert content(spark, b) == [(2, "b")]


def test_schema_changes_replicate(spark, pair):
    a, b = pair
    s = Session(spark, MY, a)
    run(s, "CREATE TABLE posts (id INTEGER PRIMARY KEY, title TEXT)", "CREATE UNIQUE INDEX i ON posts (title)", "CREATE TABLE gone (x INT)", "DROP TABLE gone", "INSERT INTO posts VALUES (1, 'p')", "ALTER TABLE posts ADD COLUMN n INT", "UPDATE posts SET n = 5", "CREATE VIEW v AS SELECT title FROM posts")
    cdc.replicate(spark, a, b)
    assert content(spark, b, "posts") == [(1, "p", 5)]
    t = b.manifest().tables
    assert "gone" not in t
    assert [i.name for i in t["posts"].indexes] == ["i"]
    assert content(spark, b, "v") == [("p",)]


def test_tables_without_a_key_replicate(spark, pair):
    a, b = pair
    s = Session(spark, MY, a)
    run(s, "CREATE TABLE t (v TEXT)", "INSERT INTO t VALUES ('a'), ('a'), (NULL)", "TRUNCATE t", "INSERT INTO t VALUES ('b')")
    cdc.replicate(spark, a, b)
    assert content(spark, b) == [("b",)]


def test_no_log_yet(spark):
    a = Store(spark)
    assert cdc.CdcTailer(spark, a).poll_batch() is None
    assert cdc.read_watermark(a) == 0
    a.close()


@pytest.mark.parametrize("sql", ["CREATE TABLE t (a INT)", "create unique index i on t (a)", "CREATE VIEW v AS SELECT ';'", "CREATE TRIGGER x", "/* c */ CREATE INDEX i ON t (a);"])
def test_ddl_that_may_be_replayed(sql):
    assert cdc.classify_replayed_ddl(sql) in {"TABLE", "INDEX", "VIEW", "TRIGGER"}


@pytest.mark.parametrize("sql", ["DROP TABLE t", "CREATE TABLE t (a INT); DROP TABLE u", "ATTACH 'x' AS y", "", "CREATE TABLE t (a TEXT DEFAULT 'x", "INSERT INTO t VALUES (1)"])
def test_ddl_that_is_refused(sql):
    with pytest.raises(UnsupportedError):
        cdc.classify_replayed_ddl(sql)


def test_stream(spark, pair, tmp_path):
    a, b = pair
    s = Session(spark, MY, a)
    run(s, "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)", "INSERT INTO t VALUES (1, 'a')")
    cdc.stream(spark, a, b, str(tmp_path / "cp")).awaitTermination()
    assert content(spark, b) == [(1, "a")]
    run(s, "INSERT INTO t VALUES (2, 'b')", "DELETE FROM t WHERE id = 1")
    cdc.stream(spark, a, b, str(tmp_path / "cp")).awaitTermination()
    assert content(spark, b) == [(2, "b")]


def test_event_windows_as_a_stream(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value").write.parquet(src)
    batch = tumbling(spark.read.parquet(src), "1 day")
    live = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = tumbling(live, "1 day", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("windows_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("windows_out").select("window_start", "event_type", "n").collect()) == sorted(batch.select("window_start", "event_type", "n").collect())


def test_schema_changes_between_rows_of_one_transaction(spark, pair):
    a, b = pair
    s = Session(spark, MY, a)
    run(s, "CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)", "INSERT INTO t VALUES (1, 'a')", "BEGIN", "INSERT INTO t VALUES (2, 'b')", "ALTER TABLE t ADD COLUMN n INT DEFAULT 3", "INSERT INTO t VALUES (3, 'c', 4)", "ALTER TABLE t RENAME TO u", "UPDATE u SET v = 'z' WHERE id = 1", "ALTER TABLE u RENAME COLUMN v TO w", "CREATE TABLE made AS SELECT id FROM u", "COMMIT")
    cdc.replicate(spark, a, b)
    assert content(spark, b, "u") == content(spark, a, "u") == [(1, "z", 3), (2, "b", 3), (3, "c", 4)]
    assert content(spark, b, "made") == [(1,), (2,), (3,)]
    assert [c.name for c in b.manifest().tables["u"].columns] == ["id", "w", "n"]
    assert "t" not in b.manifest().tables
