"""Queries about behaviour: what statements come to, step by step, beside what they should come to.

Each runs statements in one session and returns a row for each row that a step gave: (step, row, said).  A change says
how many rows it touched, an error its codes.  The SQL beside it lists the expected rows, with counts taken from the
tables themselves.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from polygate.errors import classify
from polygate.frontends.clients import MySqlClient, PostgresClient, TdsClient
from polygate.gateway import Gateway
from polygate.guard import AuthRequest, ConnectionLimiter, SessionPool, WriteAdmission, authenticate, leaves_traces, native_response, password_hash, screen_sql, screened, verify
from polygate.lexer import Dialect, lex, split_statements
from polygate.plans.statements import affinity
from polygate.plans.statements import classify as kind_of
from polygate.plans.translate import TranslateCache
from polygate.session import PREPARED_CAP, Session
from polygate.sources import hrana, sqlite_record
from polygate.sources.store import Store, temporary_root
from polygate.streaming import cdc

MY, PG, TS, LITE = Dialect.MYSQL, Dialect.POSTGRES, Dialect.TSQL, Dialect.SQLITE
SCHEMA = "step int, row int, said string"
Step = str | tuple[str, list]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Sql(str):
    """An expected value that DuckDB computes."""


def _text(v: object) -> str:
    return "NULL" if v is None else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else f"{v:g}" if isinstance(v, float) else str(v)


def _expected(rows: Iterable[tuple[int, int, str]]) -> str:
    cells = ", ".join(f"({k}, {i}, {said if isinstance(said, Sql) else "'" + said.replace("'", "''") + "'"})" for k, i, said in rows)
    return f"SELECT CAST(step AS INTEGER) AS step, CAST(row AS INTEGER) AS row, said FROM (VALUES {cells}) AS t(step, row, said)"


def said_by(session: Session, step: Step) -> list[str]:
    """What one step comes to."""
    sql, params = step if isinstance(step, tuple) else (step, None)
    try:
        r = session.query(sql, params)
    except Exception as e:
        m = classify(e, session.dialect.value)
        return [f"error {m.code} {m.sqlstate}"]
    if r.columns:
        return ["|".join(map(_text, row)) for row in r.rows]
    return [f"{r.affected} rows"] if r.kind == "dml" else []


def _steps(key: str, dialect: Dialect, tables: list[str], steps: list[tuple[Step, list[str]]]) -> None:
    """Registers steps, each with the rows that it should give."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session(spark, dialect).register_parquet(sf_dir, tables)
        got = [(k, i, said) for k, (step, _) in enumerate(steps, 1) for i, said in enumerate(said_by(s, step))]
        return spark.createDataFrame(got, SCHEMA)

    run.__name__ = key
    QUERIES[key] = run
    ORACLE_SQL[key] = _expected((k, i, w) for k, (_, want) in enumerate(steps, 1) for i, w in enumerate(want))


def _rows(key: str, make: Callable[[SparkSession, str], list[str]], want: list[str]) -> None:
    """Registers a function that gives lines, and the lines it should give."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(1, i, said) for i, said in enumerate(make(spark, sf_dir))], SCHEMA)

    run.__name__ = key
    QUERIES[key] = run
    ORACLE_SQL[key] = _expected((1, i, w) for i, w in enumerate(want))


def _count(of: str, suffix: str = "") -> Sql:
    return Sql(f"(SELECT CAST(COUNT(*) AS VARCHAR) || '{suffix}' FROM {of})")


# --- A, G, H: sources and functions ---------------------------------------------------------------------------------
_steps("A17_pragma", LITE, [], [
    ("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT NOT NULL DEFAULT 'x', n REAL UNIQUE)", []),
    ("PRAGMA table_info(t)", ["0|id|INTEGER|0|NULL|1", "1|v|TEXT|1|'x'|0", "2|n|REAL|0|NULL|0"]),
    ("PRAGMA index_list('t')", ["0|sqlite_autoindex_t_1|1|u|0"]),
])
_steps("A19_vacuum", LITE, ["nation", "supplier"], [
    ("CREATE TABLE n AS SELECT n_nationkey AS k FROM nation", []),
    ("INSERT INTO n SELECT s_suppkey FROM supplier", [_count("supplier", " rows")]),
    ("VACUUM", []),
    ("SELECT COUNT(*) FROM n", [Sql("(SELECT CAST((SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM supplier) AS VARCHAR))")]),
])
_steps("G7_several_statements", MY, ["orders"], [
    ("CREATE TABLE a (x INT); INSERT INTO a VALUES (1), (2); SELECT COUNT(*) FROM a", ["2"]),
    ("INSERT INTO a VALUES (3); INSERT INTO nope VALUES (1); INSERT INTO a VALUES (4)", ["error 1146 42S02"]),
    ("SELECT COUNT(*) FROM a; ", ["3"]),
    ("SELECT ';' AS s; SELECT COUNT(*) FROM orders", [_count("orders")]),
    (("SELECT ?; SELECT 1", [1]), ["error 1064 42000"]),
])
_steps("H1_clock", MY, [], [
    ("SELECT LENGTH(NOW()), LENGTH(CURRENT_TIMESTAMP), LENGTH(CURRENT_TIMESTAMP())", ["19|19|19"]),
    ("SELECT LENGTH(CURDATE()), LENGTH(CURRENT_DATE), LEFT(NOW(), 10) >= CURDATE()", ["10|10|1"]),
    ("SELECT UNIX_TIMESTAMP() > '1700000000', UNIX_TIMESTAMP('1970-01-02 00:00:00')", ["1|86400"]),
])
_steps("H5_counters", MY, ["region"], [
    ("CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, v TEXT)", []),
    ("INSERT INTO t (v) SELECT r_name FROM region", [_count("region", " rows")]),
    ("SELECT LAST_INSERT_ID(), ROW_COUNT()", [Sql("(SELECT COUNT(*) || '|' || COUNT(*) FROM region)")]),
    ("UPDATE t SET v = 'x' WHERE id <= 2", ["2 rows"]),
    ("SELECT ROW_COUNT() + 0 AS n, FOUND_ROWS() + 0 AS f, CONNECTION_ID() AS c", ["2|0|0"]),
    ("SELECT LAST_INSERT_ID(9)", ["error 1064 42000"]),
])
_steps("H13_tsql_variables", TS, [], [
    ("CREATE TABLE t (id INT IDENTITY(1, 1) PRIMARY KEY, v NVARCHAR(10))", []),
    ("INSERT INTO t (v) VALUES (N'a'), (N'b'), (N'c')", ["3 rows"]),
    ("SELECT @@IDENTITY + 0, @@ROWCOUNT + 0 FROM t WHERE id = 1", ["3|3"]),
    ("SELECT LEN(NEWID()), LEN(GETDATE()), LEN(GETUTCDATE())", ["32|19|19"]),
])

# --- I: changes -----------------------------------------------------------------------------------------------------
_steps("I1_insert_values", PG, [], [
    ("CREATE TABLE t (id SERIAL PRIMARY KEY, v TEXT, n DOUBLE PRECISION DEFAULT 2.5)", []),
    ("INSERT INTO t (v) VALUES ('a'), ('it''s'), (NULL)", ["3 rows"]),
    (("INSERT INTO t (v, n) VALUES ($1, $2), ($1, DEFAULT)", ["é", -1.0]), ["2 rows"]),
    ("SELECT id, v, n FROM t ORDER BY id", ["1|a|2.5", "2|it's|2.5", "3|NULL|2.5", "4|é|-1", "5|é|2.5"]),
    ("INSERT INTO t (v) VALUES (1, 2)", ["error 0 XX000"]),
])
_steps("I3_default_values", LITE, [], [
    ("CREATE TABLE d (id INTEGER PRIMARY KEY, v TEXT DEFAULT 'x', w INT)", []),
    ("INSERT INTO d DEFAULT VALUES", ["1 rows"]),
    ("INSERT INTO d DEFAULT VALUES", ["1 rows"]),
    ("SELECT * FROM d ORDER BY id", ["1|x|NULL", "2|x|NULL"]),
])
_steps("I4_returning", PG, [], [
    ("CREATE TABLE r (id SERIAL PRIMARY KEY, v INT)", []),
    ("INSERT INTO r (v) VALUES (5) RETURNING id, v * 2", ["1|10"]),
    ("UPDATE r SET v = v + 1 WHERE id = 1 RETURNING v", ["6"]),
    ("DELETE FROM r WHERE v = 6 RETURNING id", ["1"]),
])
_steps("I11_constraints", MY, [], [
    ("CREATE TABLE p (id INTEGER PRIMARY KEY, e VARCHAR(9) UNIQUE)", []),
    ("CREATE TABLE c (id INTEGER PRIMARY KEY, p INT NOT NULL, n INT, CHECK (n > 0), FOREIGN KEY (p) REFERENCES p (id))", []),
    ("INSERT INTO p VALUES (1, 'a'), (2, NULL), (3, NULL)", ["3 rows"]),
    ("INSERT INTO p VALUES (1, 'z')", ["error 1062 23000"]),
    ("INSERT INTO p VALUES (4, 'a')", ["error 1062 23000"]),
    ("UPDATE p SET e = 'a' WHERE id = 2", ["error 1062 23000"]),
    ("INSERT INTO c VALUES (1, 9, 1)", ["error 1452 23000"]),
    ("INSERT INTO c VALUES (1, NULL, 1)", ["error 1105 HY000"]),
    ("INSERT INTO c VALUES (1, 1, 0)", ["error 1105 HY000"]),
    ("INSERT INTO c VALUES (1, 1, NULL)", ["1 rows"]),
    ("DELETE FROM p WHERE id = 1", ["error 1452 23000"]),
    ("DELETE FROM p WHERE id > 1", ["2 rows"]),
])

# --- J: definitions and transactions --------------------------------------------------------------------------------
_steps("J1_create_table", MY, [], [
    ("CREATE TABLE IF NOT EXISTS `m` (`id` bigint(20) unsigned NOT NULL AUTO_INCREMENT, `k` varchar(191) NOT NULL DEFAULT '', `d` datetime, `f` decimal(10,2), `b` tinyint(1), `x` longblob, PRIMARY KEY (`id`), UNIQUE KEY `u` (`k`(100)), KEY `i` (`d`), FULLTEXT KEY f (`k`)) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4", []),
    ("CREATE TABLE IF NOT EXISTS m (z INT)", []),
    ("CREATE TABLE m (z INT)", ["error 1105 HY000"]),
    ("INSERT INTO m (k, d, f, b) VALUES ('a', '2024-03-17 10:00:00', 1.25, TRUE)", ["1 rows"]),
    ("SELECT * FROM m", ["1|a|2024-03-17 10:00:00|1.25|1|NULL"]),
    ("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'm' ORDER BY ordinal_position", ["id|INTEGER", "k|TEXT", "d|TEXT", "f|REAL", "b|INTEGER", "x|BLOB"]),
])
_steps("J7_alter_and_indexes", MY, ["nation"], [
    ("CREATE TABLE t AS SELECT n_nationkey AS id, n_name AS v FROM nation", []),
    ("ALTER TABLE t ADD KEY a (v(10)), ADD UNIQUE KEY b (id), ADD FULLTEXT KEY c (v), ADD COLUMN n INT DEFAULT 7", []),
    ("SHOW INDEX FROM t", ["0|a|0|c|0", "1|b|1|c|0"]),
    ("SELECT COUNT(*), SUM(n) FROM t", [Sql("(SELECT COUNT(*) || '|' || COUNT(*) * 7 FROM nation)")]),
    ("INSERT INTO t VALUES (1, 'again', 0)", ["error 1062 23000"]),
    ("CREATE INDEX IF NOT EXISTS a ON t (v)", []),
    ("CREATE UNIQUE INDEX d ON t (n)", ["error 1062 23000"]),
    ("DROP INDEX b", []),
    ("INSERT INTO t VALUES (1, 'again', 0)", ["1 rows"]),
    ("ALTER TABLE t RENAME COLUMN v TO w", []),
    ("ALTER TABLE t DROP COLUMN n", []),
    ("ALTER TABLE t RENAME TO u", []),
    ("SELECT COUNT(w) FROM u", [_count("(SELECT n_name FROM nation UNION ALL SELECT 'again')")]),
    ("SELECT * FROM t", ["error 1146 42S02"]),
    ("TRUNCATE TABLE u", []),
    ("SELECT COUNT(*) FROM u", ["0"]),
    ("DROP TABLE u", []),
    ("DROP TABLE IF EXISTS u", []),
    ("DROP TABLE u", ["error 1146 42S02"]),
])
_steps("J11_transactions", TS, [], [
    ("CREATE TABLE t (v INT)", []),
    ("BEGIN TRANSACTION tx", []),
    ("INSERT INTO t VALUES (1)", ["1 rows"]),
    ("SAVE TRANSACTION a", []),
    ("INSERT INTO t VALUES (2)", ["1 rows"]),
    ("SELECT COUNT(*) FROM t", ["2"]),
    ("ROLLBACK TRANSACTION TO a", []),
    ("BEGIN TRANSACTION", ["error 50000 S0001"]),
    ("COMMIT TRANSACTION tx", []),
    ("COMMIT", ["error 50000 S0001"]),
    ("BEGIN TRANSACTION", []),
    ("DELETE FROM t", ["1 rows"]),
    ("ROLLBACK TRANSACTION", []),
    ("SELECT v FROM t", ["1"]),
])
_steps("J17_no_effect", MY, [], [
    ("SET NAMES utf8mb4", []),
    ("SET autocommit = 1", []),
    ("SET SESSION TRANSACTION ISOLATION LEVEL READ COMMITTED", []),
    ("SET @@session.sql_mode = ''", []),
    ("USE anything", []),
    ("LOCK TABLES t WRITE", []),
    ("UNLOCK TABLES", []),
    ("SELECT @@autocommit", ["1"]),
])


def _isolation(spark: SparkSession, sf_dir: str) -> list[str]:
    store = Store(spark)
    a, b = Session(spark, MY, store), Session(spark, PG, store)
    out = []
    for s, sql in ((a, "CREATE TABLE t (id INTEGER PRIMARY KEY)"), (a, "BEGIN"), (a, "INSERT INTO t VALUES (1)"), (b, "SELECT COUNT(*) FROM t"), (b, "BEGIN"), (b, "INSERT INTO t VALUES (2)"), (a, "COMMIT"), (b, "SELECT id FROM t"), (b, "COMMIT"), (b, "SELECT id FROM t")):
        out += said_by(s, sql)
    store.close()
    return out


_rows("J16_isolation", _isolation, ["1 rows", "0", "1 rows", "2", "error 0 55P03", "1"])
_rows("J20_classes_of_statements", lambda spark, sf_dir: [kind_of(split_statements(lex(q, LITE))[0]).value for q in ("SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "replace INTO t VALUES (1)", "TRUNCATE t", "BEGIN", "-- c\nDROP TABLE t", "GRANT x")], ["query", "query", "query", "mutation", "mutation", "ddl", "transaction", "ddl", "other"])
_rows("J1_affinity", lambda spark, sf_dir: [f"{n}={affinity(n)[0]}" for n in ("BIGINT", "bool", "SERIAL", "bit", "Numeric", "MONEY", "NVARCHAR", "uuid", "INTERVAL", "datetime", "bytea", "IMAGE", "point")], ["BIGINT=INTEGER", "bool=INTEGER", "SERIAL=INTEGER", "bit=INTEGER", "Numeric=REAL", "MONEY=REAL", "NVARCHAR=TEXT", "uuid=TEXT", "INTERVAL=TEXT", "datetime=TEXT", "bytea=BLOB", "IMAGE=BLOB", "point=POINT"])

# --- K: metadata ----------------------------------------------------------------------------------------------------
_T = "CREATE TABLE t (id INTEGER PRIMARY KEY, v VARCHAR(9) NOT NULL, n DOUBLE DEFAULT 1.5, UNIQUE KEY u (v), KEY k (n))"
_SHOWN = ["id|bigint|YES|PRI|NULL||NULL|select,insert,update,references|", "v|longtext|NO||NULL||utf8mb4_unicode_ci|select,insert,update,references|", "n|double|YES||1.5||NULL|select,insert,update,references|"]
_steps("K1_show", MY, ["region"], [
    (_T, []),
    ("SHOW TABLES", ["region", "t"]),
    ("SHOW TABLES LIKE 'reg%';", ["region"]),
    ("SHOW DATABASES", ["main"]),
    ("SHOW FULL COLUMNS FROM `t`", _SHOWN),
    ("DESCRIBE t", _SHOWN),
    ("SHOW CREATE TABLE t", [_T]),
    ("SHOW KEYS FROM t", ["0|k|0|c|0", "1|sqlite_autoindex_t_1|1|u|0"]),
    ("SHOW VARIABLES LIKE 'autocommit'", ["autocommit|1"]),
])
_steps("K6_information_schema", MY, ["region"], [
    (_T, []),
    ("SELECT EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = 'region' AND table_schema = 'main')", ["1"]),
    ("SELECT EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = 'no')", ["0"]),
    ("SELECT column_name, is_nullable, data_type, column_default, ordinal_position FROM information_schema.columns WHERE table_name = 't' ORDER BY 5", ["id|YES|INTEGER|NULL|0", "v|NO|TEXT|NULL|1", "n|YES|REAL|1.5|2"]),
    ("SELECT schema_name, catalog_name FROM information_schema.schemata", ["main|main"]),
    ("SELECT COUNT(*) FROM information_schema.tables t JOIN information_schema.columns c ON t.table_name = c.table_name WHERE t.table_name = 't'", ["3"]),
    ("SELECT 'INFORMATION_SCHEMA.TABLES' AS s", ["INFORMATION_SCHEMA.TABLES"]),
])
_steps("K11_pg_catalog", PG, [], [
    ("CREATE TABLE t (id SERIAL PRIMARY KEY, v TEXT NOT NULL)", []),
    ("SELECT * FROM pg_catalog.pg_tables", ["t|public"]),
    ("SELECT relname FROM pg_class", ["t|public"]),
    ("SELECT * FROM pg_catalog.pg_attribute", ["t|id|INTEGER|YES|NULL", "t|v|TEXT|NO|NULL"]),
])
_steps("K13_sys_tables", TS, [], [
    ("CREATE TABLE [t] (id INT IDENTITY PRIMARY KEY, v NVARCHAR(5) NOT NULL)", []),
    ("SELECT name FROM sys.tables", ["t|U"]),
    ("EXEC sp_tables", ["t|U"]),
    ("EXEC sp_columns t", ["id|INTEGER|1", "v|TEXT|0"]),
    ("SELECT * FROM sys.columns", ["id|INTEGER|1", "v|TEXT|0"]),
])

# --- L: sessions ----------------------------------------------------------------------------------------------------
_steps("L4_found_rows", MY, ["orders"], [
    ("SELECT FOUND_ROWS()", ["0"]),
    ("SELECT FOUND_ROWS()", ["1"]),
    ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1", [Sql("(SELECT CAST(MIN(o_orderkey) AS VARCHAR) FROM orders)")]),
    ("SELECT SQL_CALC_FOUND_ROWS COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderstatus LIMIT 3", [_count("orders WHERE o_orderstatus = 'O'")]),
    ("SELECT FOUND_ROWS() AS total", ["1"]),
    (("SELECT SQL_CALC_FOUND_ROWS MIN(o_orderkey) FROM orders WHERE o_custkey > ? GROUP BY o_orderstatus HAVING COUNT(*) < 0 LIMIT 2", [0]), []),
    ("SELECT FOUND_ROWS()", ["0"]),
])


def _prepared(spark: SparkSession, sf_dir: str) -> list[str]:
    s = Session(spark, MY).register_parquet(sf_dir, ["nation"])
    p = s.prepare("SELECT COUNT(*) AS n, MAX(n_nationkey) AS m FROM nation WHERE n_regionkey = ? AND n_name LIKE ?")
    out = [f"{p.n_params} parameters", ",".join(p.columns)]
    for region in (0, 1):
        out += ["|".join(map(_text, r)) for r in s.execute_prepared(p, [region, "NATION\\_%"]).rows]
    for params in ([1], [1, "x", 2]):
        try:
            s.execute_prepared(p, params)
        except Exception as e:
            out.append(f"error {classify(e).code}")
    out.append(s.translate_sql("SELECT `a` FROM `t` LIMIT 1, 2"))
    q = s.prepare("CREATE TABLE x (a INT)")
    s.execute_prepared(q)
    i = s.prepare("INSERT INTO x VALUES (?)")
    out += [f"{s.execute_prepared(i, [k]).affected} rows" for k in (1, 2)]
    s.query("BEGIN")
    s.query("DELETE FROM x")
    s.reset()
    out += said_by(s, "SELECT SUM(a) FROM x")
    return out


_rows("L6_prepared", _prepared, ["2 parameters", "n,m", *(Sql(f"(SELECT COUNT(*) || '|' || MAX(n_nationkey) FROM nation WHERE n_regionkey = {k})") for k in (0, 1)), "error 1064", "error 1064", "SELECT `a` FROM `t` LIMIT 2 OFFSET 1", "1 rows", "1 rows", "3"])


# --- M: error codes -------------------------------------------------------------------------------------------------


def _codes(spark: SparkSession, sf_dir: str) -> list[str]:
    store, out = Store(spark), []
    Session(spark, MY, store).query("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT NOT NULL, n INT, CHECK (n > 0)); CREATE TABLE c (t INT REFERENCES t (id)); INSERT INTO t VALUES (1, 'a', 1)")
    for d in (MY, PG, TS):
        s = Session(spark, d, store).register_parquet(sf_dir, ["region"])
        for sql in ("INSERT INTO t VALUES (1, 'b', 1)", "SELECT * FROM nope", "INSERT INTO c VALUES (5)", "INSERT INTO t VALUES (2, NULL, 1)", "INSERT INTO t VALUES (2, 'b', 0)", "DELETE FROM region", "SELEC 1", "SELECT nope FROM t"):
            out += said_by(s, sql)
    store.close()
    return out


_rows("M_error_codes", _codes, [
    "error 1062 23000", "error 1146 42S02", "error 1452 23000", "error 1105 HY000", "error 1105 HY000", "error 1290 HY000", "error 1064 42000", "error 1105 HY000",
    "error 0 23505", "error 0 XX000", "error 0 23503", "error 0 23502", "error 0 23514", "error 0 25006", "error 0 XX000", "error 0 XX000",
    *(["error 50000 S0001"] * 8),
])


# --- N: replication -------------------------------------------------------------------------------------------------


def _tailing(spark: SparkSession, sf_dir: str) -> list[str]:
    a, b = Store(spark), Store(spark)
    cdc.enable_cdc(a)
    tailer, out = cdc.CdcTailer(spark, a), []
    out.append(f"cold: {tailer.poll_batch()}")
    s = Session(spark, MY, a).register_parquet(sf_dir, ["supplier"])
    for sql in ("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)", "BEGIN", "INSERT INTO t SELECT s_suppkey, s_name FROM supplier", "DELETE FROM t WHERE id > 5"):
        s.query(sql)
    first = tailer.poll_batch()
    out.append(f"{first.changes.count()} changes to commit {first.commit_id}")
    out.append(f"uncommitted: {tailer.poll_batch()}")
    s.query("COMMIT")
    second = tailer.poll_batch()
    out.append(str(second.changes.count()))
    for batch in (first, second, first, second):
        out.append(f"applied {cdc.apply_batch(spark, b, batch)}")
    out.append(f"watermark at the end {cdc.read_watermark(b) == second.commit_id}")
    out += said_by(Session(spark, MY, b), "SELECT COUNT(*), SUM(id) FROM t")
    a.close()
    b.close()
    return out


_rows("N3_tail_and_apply", _tailing, ["cold: None", "1 changes to commit 2", "uncommitted: None", Sql("(SELECT CAST(COUNT(*) + COUNT(*) FILTER (s_suppkey > 5) AS VARCHAR) FROM supplier)"), "applied True", "applied True", "applied False", "applied False", "watermark at the end True", Sql("(SELECT COUNT(*) || '|' || SUM(s_suppkey) FROM supplier WHERE s_suppkey <= 5)")])


def _replayed(spark: SparkSession, sf_dir: str) -> list[str]:
    out = []
    for sql in ("CREATE TABLE t (a INT)", "create unique index i on t (a)", "CREATE VIEW v AS SELECT ';'", "CREATE TRIGGER x", "DROP TABLE t", "CREATE TABLE t (a INT); DROP TABLE u", "ATTACH 'x' AS y"):
        try:
            out.append(cdc.classify_replayed_ddl(sql))
        except Exception:
            out.append("refused")
    return out


_rows("N8_replayed_ddl", _replayed, ["TABLE", "INDEX", "VIEW", "TRIGGER", "refused", "refused", "refused"])


def _ddl_capture(spark: SparkSession, sf_dir: str) -> list[str]:
    a, b = Store(spark), Store(spark)
    cdc.enable_cdc(a)
    s = Session(spark, MY, a).register_parquet(sf_dir, ["nation"])
    for sql in ("CREATE TABLE n AS SELECT n_nationkey AS id, n_name AS v FROM nation", "CREATE UNIQUE INDEX i ON n (id)", "ALTER TABLE n ADD COLUMN k INT DEFAULT 4", "UPDATE n SET k = 5 WHERE id < 3", "CREATE TABLE gone (a INT)", "DROP TABLE gone", "ALTER TABLE n RENAME TO m"):
        s.query(sql)
    out = [f"{cdc.replicate(spark, a, b)} transactions", f"{cdc.replicate(spark, a, b)} transactions"]
    r = Session(spark, MY, b)
    for sql in ("SHOW TABLES", "SHOW INDEX FROM m", "SELECT COUNT(*), SUM(k) FROM m"):
        out += said_by(r, sql)
    a.close()
    b.close()
    return out


_rows("N7_schema_changes", _ddl_capture, ["7 transactions", "0 transactions", "m", "0|i|1|c|0", Sql("(SELECT COUNT(*) || '|' || COUNT(*) * 4 + 3 FROM nation)")])


# --- O, A: guards and the HTTP pipeline -----------------------------------------------------------------------------
_SCREENED = ("ATTACH 'x' AS y", "/* c */ detach y", "EXPLAIN QUERY PLAN ATTACH 'x' AS y", "VACUUM INTO 'f'", "VACUUM", "PRAGMA writable_schema = 1", "SELECT 'ATTACH'", "SELECT * FROM parquet.`/etc`", "SELECT 1; ADD JAR 'x'", "SELECT 'open")


def _screen(spark: SparkSession, sf_dir: str) -> list[str]:
    out = []
    for sql in _SCREENED:
        try:
            screen_sql(sql)
            out.append("passes")
        except Exception as e:
            out.append(f"error {classify(e).code}")
    return out


_rows("O1_tenant_screen", _screen, ["error 1045", "error 1045", "error 1045", "error 1045", "passes", "error 1045", "passes", "error 1045", "error 1045", "error 1064"])


def _guards(spark: SparkSession, sf_dir: str) -> list[str]:
    salt, stored = bytes(range(20)), password_hash(b"secret")
    out = [f"login {verify(stored, salt, native_response(w, salt))}" for w in (b"secret", b"wrong", b"")]
    try:
        authenticate(lambda r: None, AuthRequest("eve"))
    except Exception as e:
        out.append(f"error {classify(e).code}")
    limit = ConnectionLimiter(1)
    with limit.acquire():
        try:
            limit.acquire()
        except Exception as e:
            out.append(f"error {classify(e).code}")
    out.append(f"{limit.used} used")
    store, gate = Store(spark), WriteAdmission(1, 0.1)
    a, b = (Session(spark, MY, store, admission=gate) for _ in range(2))
    for s, sql in ((a, "CREATE TABLE t (v INT)"), (a, "BEGIN"), (a, "INSERT INTO t VALUES (1)"), (b, "SELECT COUNT(*) FROM t"), (b, "INSERT INTO t VALUES (2)"), (a, "COMMIT"), (b, "INSERT INTO t VALUES (2)"), (a, "SELECT COUNT(*) FROM t")):
        out += said_by(s, sql)
    store.close()
    return out


_rows("O4_guards", _guards, ["login True", "login False", "login False", "error 1045", "error 1040", "0 used", "1 rows", "0", "error 1205 HY000", "1 rows", "2"])


def _http(spark: SparkSession, sf_dir: str) -> list[str]:
    store = Store(spark)
    server = hrana.HranaServer(lambda: Session(spark, LITE, store).register_parquet(sf_dir, ["region"])).start()
    try:
        c = hrana.HranaClient(server.url)
        out = [f"healthy {c.health_check()}"]
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT, b BLOB)")
        r = c.execute("INSERT INTO t VALUES (?, ?, ?)", [7, "é", b"\x00\xff"])
        out.append(f"{r['affected_row_count']} rows, last {r['last_insert_rowid']}")
        out += ["|".join(map(_text, row)) for row in c.execute("SELECT * FROM t")["rows"]]
        out += ["|".join(map(_text, row)) for row in c.execute("SELECT COUNT(*), MAX(r_name) FROM region")["rows"]]
        out += [x["type"] for x in c.pipeline([{"type": "execute", "stmt": {"sql": "SELEC"}}, {"type": "execute", "stmt": {"sql": "SELECT 1"}}, {"type": "close"}])]
    finally:
        server.close()
        store.close()
    return out


_rows("A11_http_pipeline", _http, ["healthy True", "1 rows, last 7", "7|é|00ff", Sql("(SELECT COUNT(*) || '|' || MAX(r_name) FROM region)"), "error", "ok", "ok"])


# --- A: stores by path, front ends, the command line ------------------------------------------------------------------
def _stored(spark: SparkSession, sf_dir: str) -> list[str]:
    path, out = temporary_root(spark), []
    for steps, read_only in ((["CREATE TABLE n (k INT PRIMARY KEY, v TEXT)", "INSERT INTO n SELECT n_nationkey, n_name FROM nation"], False), (["UPDATE n SET v = 'x' WHERE k < 5"], False), (["SELECT COUNT(*), COUNT(DISTINCT v) FROM n", "DELETE FROM n"], True)):
        session = Session(spark, LITE, Store(spark, path, read_only)).register_parquet(sf_dir, ["nation"])
        for sql in steps:
            out += said_by(session, sql)
        session.close()
    Store(spark, path).files.remove("")
    return out


_rows("A6_store_by_path", _stored, [_count("nation", " rows"), "5 rows", Sql("(SELECT COUNT(*) || '|' || (COUNT(*) - 4) FROM nation)"), "error 1290 HY000"])


@contextlib.contextmanager
def _served(spark: SparkSession, sf_dir: str, kind: str):
    gateway = Gateway(spark).memory().table("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    getattr(gateway, kind)().serve()
    try:
        yield gateway.servers[0]
    finally:
        gateway.close()


def _mysql(spark: SparkSession, sf_dir: str) -> list[str]:
    with _served(spark, sf_dir, "mysql") as server, MySqlClient(server) as c:
        say = lambda r: [f"{r[0]} {r[1]}"] if isinstance(r[0], str) else ["|".join("NULL" if v is None else v.decode() for v in row) for row in r[1]]
        out = []
        for sql in ("CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, v VARCHAR(9))", "INSERT INTO t (v) VALUES ('é'), (NULL)", "SELECT * FROM t ORDER BY id", "SELECT `o_orderstatus`, COUNT(*) FROM `orders` GROUP BY 1 ORDER BY 1 LIMIT 0, 1", "INSERT INTO t VALUES (1, 'again')", "SELECT * FROM nope"):
            out += say(c.query(sql))
        key, _ = c.prepare("SELECT COUNT(*) FROM orders WHERE o_orderkey <= ?")
        return [*out, *(str(v) for (v,) in c.execute(key, [100])[1])]


_status = "(SELECT o_orderstatus || '|' || COUNT(*) FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus LIMIT 1)"
_rows("A12_mysql_front_end", _mysql, ["ok 0", "ok 2", "1|é", "2|NULL", Sql(_status), "error 1062", "error 1146", _count("orders WHERE o_orderkey <= 100")])


def _postgres(spark: SparkSession, sf_dir: str) -> list[str]:
    with _served(spark, sf_dir, "postgres") as server, PostgresClient(server) as c:
        out = []
        for sql in ("CREATE TABLE t (id SERIAL PRIMARY KEY, v TEXT); INSERT INTO t (v) VALUES ('é'), (NULL) RETURNING id", "SELECT id::text, v FROM t ORDER BY id", 'SELECT "o_orderstatus", COUNT(*) FROM "orders" GROUP BY 1 ORDER BY 1 LIMIT 1', "INSERT INTO t VALUES (1, 'again')", "BEGIN", "ROLLBACK"):
            out += [x if isinstance(x, str) else "|".join("NULL" if v is None else v.decode() for v in x) for x in c.query(sql)]
        got = c.extended("SELECT COUNT(*) FROM orders WHERE o_orderkey <= $1", [b"100"], oids=[20])
        return [*out, *(c.row(body)[0].decode() for kind, body in got if kind == b"D")]


_rows("A13_postgres_front_end", _postgres, ["CREATE TABLE", "1", "2", "INSERT 0 2", "1|é", "2|NULL", "SELECT 2", Sql(_status), "SELECT 1", "error 23505", "BEGIN", "ROLLBACK", _count("orders WHERE o_orderkey <= 100")])


def _tds(spark: SparkSession, sf_dir: str) -> list[str]:
    with _served(spark, sf_dir, "tds") as server, TdsClient(server) as c:
        out = []
        for sql in ("CREATE TABLE [t] (id INT IDENTITY(1, 1) PRIMARY KEY, v NVARCHAR(9)); INSERT INTO t (v) VALUES (N'é'), (NULL)", "SELECT TOP 2 * FROM [t] ORDER BY [id]", "SELECT TOP 1 [o_orderstatus], COUNT(*) AS n FROM [orders] GROUP BY o_orderstatus ORDER BY 1", "SELECT * FROM nope"):
            for x in c.query(sql):
                out.append(f"{x[0]} {x[-1]}" if x[0] == "done" else f"error {x[1]}" if x[0] == "error" else ",".join(x[1]) if x[0] == "columns" else "|".join(map(_text, x)))
        return out


_rows("A14_tds_front_end", _tds, ["done 0", "done 2", "id,v", "1|é", "2|NULL", "done 2", "o_orderstatus,n", Sql(_status), "done 1", "error 50000", "done 0"])


def _command_line(spark: SparkSession, sf_dir: str) -> list[str]:
    from polygate.__main__ import main

    path, out = temporary_root(spark), []
    for args in (["CREATE TABLE n (k INT PRIMARY KEY); INSERT INTO n SELECT n_nationkey FROM nation"], ["--dialect", "tsql", "SELECT TOP 1 [k] AS [least] FROM [n] ORDER BY k"], ["--dialect", "postgres", "SELECT * FROM nope"]):
        said, wrong = io.StringIO(), io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(wrong):
            code = main(["--db", path, "--tables", sf_dir, *args], spark)
        out += [f"exit {code}", *said.getvalue().splitlines(), *(x.split(":")[0] for x in wrong.getvalue().splitlines() if x.startswith("error"))]
    Store(spark, path).files.remove("")
    return out


_rows("A15_command_line", _command_line, ["exit 0", _count("nation", " rows affected"), "exit 0", "least", Sql("(SELECT CAST(MIN(n_nationkey) AS VARCHAR) FROM nation)"), "exit 1", "error 0 (XX000)"])


def _builder(spark: SparkSession, sf_dir: str) -> list[str]:
    gateway = Gateway(spark).memory().max_connections(2).write_permits(1, 0.1).tenant_screen().table("region", spark.read.parquet(f"{sf_dir}/region.parquet"))
    a, b = gateway.connect(MY), gateway.connect(PG)
    out = []
    for s, sql in ((a, "CREATE TABLE t AS SELECT r_name FROM region"), (b, 'SELECT COUNT(*) FROM "t"'), (a, "ATTACH 'x' AS y")):
        out += said_by(s, sql)
    try:
        gateway.connect(TS)
    except Exception as e:
        out.append(f"error {classify(e).code}")
    b.close()
    out += said_by(gateway.connect(TS), "SELECT TOP 1 [r_name] FROM [t] ORDER BY 1")
    gateway.close()
    return out


_rows("A16_builder", _builder, [_count("region"), "error 1045 28000", "error 1040", Sql("(SELECT MIN(r_name) FROM region)")])


def _explained(spark: SparkSession, sf_dir: str) -> list[str]:
    s = Session(spark, MY).register_parquet(sf_dir, ["orders"])
    text = "\n".join(str(r[0]) for r in s.query("EXPLAIN SELECT `o_orderkey` FROM `orders` WHERE o_custkey = 7 LIMIT 0, 5").rows)
    return [f"{word}: {word in text}" for word in ("Physical Plan", "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]", "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>")]


_rows("A18_explain", _explained, ["Physical Plan: True", "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]: True", "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>: True"])


# --- L, N, O: limits, caches, pools ------------------------------------------------------------------------------------
def _prepared_cap(spark: SparkSession, sf_dir: str) -> list[str]:
    s = Session(spark, MY)
    kept = [s.prepare("SET NAMES utf8") for _ in range(PREPARED_CAP)]
    out = [f"{len(kept)} kept"]
    try:
        s.prepare("SELECT 2")
    except Exception as e:
        out.append(f"error {classify(e).code}")
    s.close_prepared(kept[0])
    again = s.prepare("SELECT 2")
    return [*out, *(str(v) for (v,) in s.execute_prepared(again, []).rows)]


_rows("L9_prepared_cap", _prepared_cap, ["1024 kept", "error 1461", "2"])


def _cached(spark: SparkSession, sf_dir: str) -> list[str]:
    cache = TranslateCache(2)
    a, b = (Session(spark, d, cache=cache).register_parquet(sf_dir, ["region"]) for d in (MY, PG))
    out = []
    for s, sql in ((a, "SELECT COUNT(*) FROM region"), (a, "SELECT COUNT(*) FROM region"), (b, "SELECT COUNT(*) FROM region"), (b, "SELECT 2"), (a, "SELECT COUNT(*) FROM region")):
        out += [f"{said}, {cache.hits} hits, {cache.misses} misses, {len(cache)} kept" for said in said_by(s, sql)]
    return out


_region = "(SELECT COUNT(*) || ', {} hits, {} misses, {} kept' FROM region)"
_rows("L13_translate_cache", _cached, [*(Sql(_region.format(*x)) for x in ((0, 1, 1), (1, 1, 1), (1, 2, 2))), "2, 1 hits, 3 misses, 2 kept", Sql(_region.format(1, 4, 2))])


def _raw(spark: SparkSession, sf_dir: str) -> list[str]:
    s = Session(spark, MY).register_parquet(sf_dir, ["region"])
    s.query("CREATE TABLE t (v INT)")
    s.query("INSERT INTO t VALUES (4)")
    s.query("SELECT * FROM t")
    return [str(r[0]) for r in s.spark.sql("SELECT COUNT(*) FROM region UNION ALL SELECT SUM(v) FROM t").collect()]


_rows("N10_raw_connection", _raw, [_count("region"), "4"])


def _screened(spark: SparkSession, sf_dir: str) -> list[str]:
    s = Session(spark, LITE, screen=screened(LITE)).register_parquet(sf_dir, ["region"])
    out: list[str] = []
    for sql in ("SELECT COUNT(*) FROM region", "ATTACH 'other' AS o", "SELECT 1; DETACH o", "SELECT 'ATTACH x'", "VACUUM INTO 'x'"):
        out += said_by(s, sql)
    return out


_rows("O2_screened_session", _screened, [_count("region"), "error 1045 28000", "error 1045 28000", "ATTACH x", "error 1045 28000"])


def _pooled(spark: SparkSession, sf_dir: str) -> list[str]:
    store = Store(spark)
    pool = SessionPool(lambda: Session(spark, MY, store), 1)
    a = pool.checkout()
    out = said_by(a, "SELECT 1")
    out.append(f"kept {pool.park(a)}")
    b = pool.checkout()
    out.append(f"the same {a is b}")
    said_by(b, "BEGIN")
    out.append(f"kept in a transaction {pool.park(b)}")
    c = pool.checkout()
    c.spark.conf.set("spark.sql.ansi.enabled", "false" if c.spark.conf.get("spark.sql.ansi.enabled") == "true" else "true")
    out.append(f"kept with other settings {pool.park(c)}")
    d = pool.checkout()
    said_by(d, "SET NAMES utf8")
    out.append(f"kept after a statement that may leave traces {pool.park(d)}")
    store.close()
    return out


_rows("O7_session_pool", _pooled, ["1", "kept True", "the same True", "kept in a transaction False", "kept with other settings False", "kept after a statement that may leave traces False"])


def _dirty(spark: SparkSession, sf_dir: str) -> list[str]:
    return [str(leaves_traces(sql, LITE)) for sql in ("SELECT 1", "ATTACH 'x' AS y", "SELECT 1; PRAGMA foreign_keys = 1", "CREATE TABLE t (a)", "CREATE TEMP TABLE t (a)", "SELECT 'SET x'", "/* SET */ INSERT INTO t VALUES (1)", "SELECT 'open")]


_rows("O8_statements_with_traces", _dirty, ["False", "True", "True", "False", "True", "False", "False", "True"])


def _records(spark: SparkSession, sf_dir: str) -> list[str]:
    records = ["02 00", "03 08 09", "07 01 02 03 04 05 06 80 7fff 800000 7fffffff 800000000000 7fffffffffffffff", "03 07 13 3ff8000000000000 c3a96f", "03 10 0d 00ff", "0a 00 00 00 00 00 00 00 00 08", None]
    rows = [(i, None if r is None else bytearray.fromhex(r)) for i, r in enumerate(records)]
    got = sqlite_record.decoded(spark.createDataFrame(rows, "n int, record binary"), "n", "record").orderBy("n").collect()
    out = ["NULL" if r.columns is None else "|".join(_text(c[c.kind] if c.kind != "null" else None) for c in r.columns) for r in got]
    for bad in ("02 0a", "02 0b", "02 06", "05 00", "81"):
        try:
            sqlite_record.decode(bytes.fromhex(bad))
        except ValueError as e:
            out.append(str(e))
    return out


_rows("N9_sqlite_records", _records, ["NULL", "0|1", "-128|32767|-8388608|2147483647|-140737488355328|9223372036854775807", "1.5|éo", "00ff|", "NULL|NULL|NULL|NULL|NULL|NULL|NULL|NULL|0", "NULL", "serial type 10 is reserved", "serial type 11 is reserved", "a record is cut short", "a record's header is longer than the record", "a record ends within its header"])
