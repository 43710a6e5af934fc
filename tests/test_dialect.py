"""Text in, Spark SQL out: one case for each rewrite."""

import pytest

from polygate.dialect import Options, like_pattern, to_spark
from polygate.errors import SqlSyntaxError, UnsupportedError
from polygate.lexer import Dialect, lex, significant, split_statements
from polygate.plans.statements import Kind, affinity, classify, parse
from polygate.plans.translate import TranslateCache, noop, translate

MY, PG, TS, LITE = Dialect.MYSQL, Dialect.POSTGRES, Dialect.TSQL, Dialect.SQLITE


def spark_text(sql, dialect=MY, **kw):
    return to_spark(lex(sql, dialect), dialect, named=False, **kw).text


@pytest.mark.parametrize(
    ("dialect", "sql", "want"),
    [
        (MY, "SELECT `a b` FROM `t`", "SELECT `a b` FROM `t`"),
        (PG, 'SELECT "a`b" FROM t', "SELECT `a``b` FROM t"),
        (TS, "SELECT [a]]b] FROM [t]", "SELECT `a]b` FROM `t`"),
        (MY, r"SELECT 'it''s', 'a\\b', 'x\ny'", "SELECT 'it\\'s', 'a\\\\b', 'x\ny'"),
        (PG, r"SELECT 'a\b'", r"SELECT 'a\\b'"),
        (PG, "SELECT $$it's$$", r"SELECT 'it\'s'"),
        (TS, "SELECT N'é'", "SELECT 'é'"),
        (MY, "SELECT a FROM t LIMIT 5, 10", "SELECT a FROM t LIMIT 10 OFFSET 5"),
        (MY, "SELECT (SELECT b FROM u LIMIT 1, 2) FROM t", "SELECT (SELECT b FROM u LIMIT 2 OFFSET 1) FROM t"),
        (TS, "SELECT TOP 3 a FROM t ORDER BY a", "SELECT  a FROM t ORDER BY a LIMIT 3"),
        (TS, "SELECT DISTINCT TOP (3) a FROM t", "SELECT DISTINCT  a FROM t LIMIT (3)"),
        (TS, "SELECT ISNULL(a, 0) FROM t", "SELECT ifnull(a, 0) FROM t"),
        (MY, "SELECT SQL_NO_CACHE SQL_BIG_RESULT a FROM t", "SELECT   a FROM t"),
        (MY, "SELECT 'SQL_NO_CACHE' FROM t", "SELECT 'SQL_NO_CACHE' FROM t"),
        (MY, "SELECT YEAR(MONTH(d))", "SELECT CAST(year(CAST(month(d) AS BIGINT)) AS BIGINT)"),
        (PG, "SELECT a::varchar(10) FROM t WHERE b = $1", "SELECT a::STRING FROM t WHERE b = :p1"),
        (MY, "SELECT 1 FROM dual", "SELECT 1"),
        (MY, "a REGEXP 'x' AND b NOT RLIKE 'y'", "a RLIKE 'x' AND b NOT RLIKE 'y'"),
        (MY, r"a LIKE 'x\%y'", r"a LIKE 'x\\%y'"),
        (PG, r"a LIKE 'x\%y'", "a LIKE 'x\\\\%y' ESCAPE '\x01'"),
        (TS, "a LIKE 'x|%' ESCAPE '|'", "a LIKE 'x|%' ESCAPE '|'"),
        (MY, "SELECT VERSION(), DATABASE(), CONNECTION_ID()", "SELECT '8.0.36-polygate', 'main', 0"),
        (MY, "SELECT LAST_INSERT_ID(), ROW_COUNT()", "SELECT :__last_insert_id, :__row_count"),
        (TS, "SELECT @@IDENTITY, @@ROWCOUNT", "SELECT :__last_insert_id, :__row_count"),
        (TS, "SELECT NEWID()", "SELECT replace(uuid(), '-', '')"),
        (MY, "SELECT GROUP_CONCAT(DISTINCT a ORDER BY a SEPARATOR '-') FROM t", "SELECT listagg(DISTINCT CAST(a AS STRING), '-') WITHIN GROUP (ORDER BY a) FROM t"),
        (MY, "SELECT /* c */ a -- x\nFROM t # y", "SELECT   a  \nFROM t"),
    ],
)
def test_rewrites(dialect, sql, want):
    assert " ".join(spark_text(sql, dialect).split()) == " ".join(want.split())


def test_case_insensitive_like_is_an_option():
    assert spark_text("a LIKE 'x'", options=Options(like_ci=True)) == "a ILIKE 'x'"


@pytest.mark.parametrize(("p", "want"), [(r"a\xb", "axb"), (r"a\%", r"a\%"), ("a\\", "a\\\\"), (r"a\\b", r"a\\b"), ("", "")])
def test_like_patterns_that_spark_takes(p, want):
    assert like_pattern(p) == want


@pytest.mark.parametrize("sql", ["SELECT TOP 5 PERCENT a FROM t", "SELECT TOP (5) WITH TIES a FROM t ORDER BY a"])
def test_top_that_is_refused(sql):
    with pytest.raises(UnsupportedError):
        translate(sql, TS)


@pytest.mark.parametrize("sql", ["SELECT WEEK(d) FROM t", "SELECT LAST_INSERT_ID(5)"])
def test_functions_that_would_mean_something_else_are_refused(sql):
    with pytest.raises(UnsupportedError):
        translate(sql, MY)


@pytest.mark.parametrize("sql", ["SELECT 'a", 'SELECT "a', "SELECT /* a", "SELECT (1", "INSERT INTO t"])
def test_broken_text(sql):
    with pytest.raises((SqlSyntaxError, UnsupportedError)):
        translate(sql, PG)


def test_placeholders_keep_their_numbers_when_moved():
    t = translate("SELECT a FROM t WHERE b = ? LIMIT ?, ?", MY)[0]
    assert t.n_params == 3
    assert t.text.endswith("LIMIT :p3 OFFSET :p2")
    assert translate("SELECT '?' FROM t WHERE a = ?", MY)[0].n_params == 1
    assert translate("SELECT $2, $1, $2", PG)[0].n_params == 2
    with pytest.raises(SqlSyntaxError):
        translate("SELECT $0", PG)


def test_outputs_without_alias_are_named_by_their_text():
    assert "`COUNT(*)`" in translate("SELECT COUNT(*) FROM t", MY)[0].text
    assert translate("SELECT a, t.b, a AS c, a d FROM t", MY)[0].text == "SELECT a, t.b, a AS c, a d FROM t"
    assert "`1 + 2`" in translate("SELECT 1 + 2", MY)[0].text


@pytest.mark.parametrize(
    ("sql", "kind"),
    [
        ("SELECT 1", Kind.QUERY), ("WITH a AS (SELECT 1) SELECT * FROM a", Kind.QUERY), ("(SELECT 1)", Kind.QUERY), ("VALUES (1)", Kind.QUERY), ("EXPLAIN SELECT 1", Kind.QUERY),
        ("WITH a AS (SELECT 1) DELETE FROM t", Kind.MUTATION), ("insert into t values (1)", Kind.MUTATION), ("REPLACE INTO t VALUES (1)", Kind.MUTATION),
        ("CREATE TABLE t (a INT)", Kind.DDL), ("TRUNCATE t", Kind.DDL), ("BEGIN", Kind.TRANSACTION), ("ROLLBACK TO a", Kind.TRANSACTION), ("GRANT x", Kind.OTHER),
    ],
)
def test_classes_of_statements(sql, kind):
    assert classify(lex(sql, LITE)) is kind


@pytest.mark.parametrize(
    ("sql", "action", "name"),
    [
        ("BEGIN", "begin", ""), ("START TRANSACTION READ WRITE", "begin", ""), ("BEGIN TRANSACTION tx", "begin", ""), ("BEGIN WORK", "begin", ""),
        ("COMMIT WORK", "commit", ""), ("COMMIT TRANSACTION tx", "commit", ""), ("END", "commit", ""),
        ("ROLLBACK", "rollback", ""), ("ROLLBACK WORK", "rollback", ""), ("ROLLBACK TRANSACTION TO SAVEPOINT a", "rollback_to", "a"), ("ROLLBACK TO a", "rollback_to", "a"),
        ("SAVEPOINT a", "savepoint", "a"), ("RELEASE SAVEPOINT a", "release", "a"), ("RELEASE a", "release", "a"),
    ],
)
def test_transaction_control(sql, action, name):
    t = translate(sql, MY)[0]
    assert t.kind == "transaction"
    assert (t.plan.action, t.plan.name) == (action, name)


@pytest.mark.parametrize(
    ("dialect", "sql"),
    [
        (MY, "SET NAMES utf8mb4"), (MY, "SET autocommit=1"), (MY, "SET SESSION sql_mode = ''"), (MY, "SET @@session.wait_timeout = 5"), (MY, "SET TRANSACTION ISOLATION LEVEL READ COMMITTED"),
        (MY, "LOCK TABLES a READ"), (MY, "UNLOCK TABLES"), (MY, "USE db"), (TS, "SET NOCOUNT ON"), (TS, "SET ANSI_NULLS OFF"),
    ],
)
def test_statements_without_effect(dialect, sql):
    assert translate(sql, dialect)[0].kind == "noop"


def test_autocommit_off_warns(caplog):
    noop(significant(lex("SET autocommit = 0", MY)))
    assert "autocommit" in caplog.text


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("bigint", "INTEGER"), ("BOOLEAN", "INTEGER"), ("bit", "INTEGER"), ("SERIAL", "INTEGER"), ("Decimal", "REAL"), ("money", "REAL"), ("varchar", "TEXT"), ("ENUM", "TEXT"), ("datetime", "TEXT"),
        ("jsonb", "TEXT"), ("UNIQUEIDENTIFIER", "TEXT"), ("bytea", "BLOB"), ("IMAGE", "BLOB"), ("geometry", "GEOMETRY"),
    ],
)
def test_affinity(name, want):
    assert affinity(name)[0] == want


def statement(sql, dialect=MY):
    return parse(split_statements(lex(sql, dialect))[0], dialect)


def test_create_table_parts():
    t = statement("""CREATE TABLE IF NOT EXISTS `wp_x` (
        `id` bigint(20) unsigned NOT NULL AUTO_INCREMENT, `k` varchar(191) NOT NULL DEFAULT '', `v` longtext, n DECIMAL(10, 2) DEFAULT -1.5,
        PRIMARY KEY (`id`), UNIQUE KEY `k_u` (`k`(100)), KEY `v_i` (`v`(50)), FULLTEXT KEY f (v), CHECK (n < 5), CONSTRAINT fk FOREIGN KEY (n) REFERENCES p (id) ON DELETE CASCADE
    ) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4 COLLATE utf8mb4_unicode_520_ci""")
    assert [(c.name, c.decl, c.type, c.not_null, c.autoinc) for c in t.columns] == [
        ("id", "INTEGER", "bigint", True, True), ("k", "TEXT", "string", True, False), ("v", "TEXT", "string", False, False), ("n", "REAL", "double", False, False),
    ]
    assert (t.primary, t.unique, [i.name for i in t.indexes], t.if_not_exists) == (["id"], [["k"]], ["v_i"], True)
    assert [c.default for c in t.columns] == [None, "''", None, "- 1.5"]
    assert t.foreign[0].parent == "p"
    assert len(t.checks) == 1


def test_alter_table_puts_indexes_last():
    a = statement("ALTER TABLE t ADD KEY i (a(10)), ADD COLUMN b INT, ADD UNIQUE u (c), ADD FULLTEXT KEY f (a), DROP COLUMN d")
    assert [x.action for x in a] == ["add_column", "drop_column", "create_index", "create_index"]
    assert [x.index.unique for x in a if x.index] == [False, True]


def test_upsert_parts():
    i = statement("INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y') ON DUPLICATE KEY UPDATE b = VALUES(b)")
    assert (i.conflict, len(i.rows), i.updates[0][0]) == ("update", 2, "b")
    i = statement("INSERT INTO t (a) SELECT x FROM u JOIN v ON u.i = v.i ON CONFLICT (a) DO NOTHING RETURNING a", PG)
    assert (i.conflict, i.target) == ("ignore", ["a"])
    assert i.returning is not None


def test_non_ascii_text_survives():
    assert "'日本 é (20)'" in translate("SELECT SQL_NO_CACHE '日本 é (20)' AS s", MY)[0].text


def test_cache_is_by_dialect_and_bounded():
    cache = TranslateCache(2)
    cache.translate("SELECT 1", MY)
    cache.translate("SELECT 1", MY)
    assert (cache.hits, cache.misses) == (1, 1)
    cache.translate("SELECT 1", PG)
    cache.translate("SELECT 2", PG)
    assert len(cache) == 2
    with pytest.raises(SqlSyntaxError):
        cache.translate("SELECT 'x", PG)
    assert len(cache) == 2


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a FROM t ORDER BY a OFFSET 2 ROWS FETCH NEXT 3 ROWS ONLY", "SELECT a FROM t ORDER BY a LIMIT 3 OFFSET 2"),
        ("SELECT a FROM t FETCH FIRST ROW ONLY", "SELECT a FROM t LIMIT 1"),
        ("SELECT a FROM t ORDER BY a OFFSET 1 ROW", "SELECT a FROM t ORDER BY a OFFSET 1"),
        ("SELECT a FROM t LIMIT 1 OFFSET 2", "SELECT a FROM t LIMIT 1 OFFSET 2"),
        ("SELECT SUM(a) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "SELECT SUM(a) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t"),
        ("SELECT public.t.a, main.b FROM public.t JOIN main.u main ON t.a = main.a", "SELECT t.a, main.b FROM t JOIN u main ON t.a = main.a"),
    ],
)
def test_fetch_and_schemas(sql, want):
    assert " ".join(spark_text(sql, PG).split()) == want


def test_fetch_with_ties_is_refused():
    with pytest.raises(UnsupportedError):
        translate("SELECT a FROM t ORDER BY a FETCH FIRST 2 ROWS WITH TIES", PG)


def test_top_is_no_part_of_a_column_name():
    for sql, want in (("SELECT TOP 2 * FROM [t]", "SELECT * FROM `t` LIMIT 2"), ("SELECT DISTINCT TOP (3) a + 1 FROM t", "SELECT DISTINCT a + 1 AS `a + 1` FROM t LIMIT (3)"), ("SELECT TOP 1 t.* FROM t", "SELECT t.* FROM t LIMIT 1")):
        assert " ".join(translate(sql, Dialect.TSQL)[0].text.split()) == want
