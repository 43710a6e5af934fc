"""Questions about the catalog in each dialect's words."""

import pytest

from polygate import Dialect, Session

MY, PG, TS, LITE = Dialect.MYSQL, Dialect.POSTGRES, Dialect.TSQL, Dialect.SQLITE


@pytest.fixture(scope="module")
def s(spark):
    out = Session(spark, MY)
    out.query("CREATE TABLE beta (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL, price DOUBLE DEFAULT 1.5, b BLOB, UNIQUE KEY u (name), KEY k (price))")
    out.query("CREATE TABLE alpha (x INT)")
    yield out
    out.close()


def rows(s, sql):
    return s.query(sql).rows


@pytest.mark.parametrize("sql", ["SHOW TABLES", "show tables;", "SHOW FULL TABLES FROM main"])
def test_show_tables(s, sql):
    r = s.query(sql)
    assert (r.columns, r.rows) == (["Tables_in_database"], [("alpha",), ("beta",)])


def test_show_tables_like(s):
    assert rows(s, "SHOW TABLES LIKE 'al%'") == [("alpha",)]
    assert rows(s, "SHOW DATABASES") == [("main",)]


@pytest.mark.parametrize("sql", ["SHOW COLUMNS FROM beta", "SHOW FULL FIELDS FROM `beta`", "DESCRIBE beta", "DESC beta"])
def test_columns(s, sql):
    r = s.query(sql)
    assert r.columns == ["Field", "Type", "Null", "Key", "Default", "Extra", "Collation", "Privileges", "Comment"]
    assert [x[:5] for x in r.rows] == [("id", "bigint", "YES", "PRI", None), ("name", "longtext", "NO", "", None), ("price", "double", "YES", "", "1.5"), ("b", "longblob", "YES", "", None)]


def test_create_and_indexes(s):
    assert rows(s, "SHOW CREATE TABLE beta")[0][0].startswith("CREATE TABLE beta (")
    r = s.query("SHOW INDEX FROM beta")
    assert r.columns == ["seq", "name", "unique", "origin", "partial"]
    assert {(x[1], x[2]) for x in r.rows} == {("k", 0), ("sqlite_autoindex_beta_1", 1)}


def test_information_schema(s):
    assert rows(s, "SELECT EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = 'beta')") == [(1,)]
    assert rows(s, "SELECT EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = 'none') ") == [(0,)]
    assert rows(s, "SELECT table_name FROM information_schema.tables WHERE table_schema = 'main' ORDER BY 1 DESC") == [("beta",), ("alpha",)]
    got = rows(s, "SELECT column_name, data_type, is_nullable, ordinal_position FROM information_schema.columns WHERE table_name = 'beta' ORDER BY ordinal_position")
    assert got == [("id", "INTEGER", "YES", 0), ("name", "TEXT", "NO", 1), ("price", "REAL", "YES", 2), ("b", "BLOB", "YES", 3)]
    assert rows(s, "SELECT schema_name FROM information_schema.schemata") == [("main",)]
    assert rows(s, "SELECT 'information_schema.tables' AS t") == [("information_schema.tables",)]


def test_variables(s):
    r = s.query("SELECT @@version_comment, @@session.autocommit, @@nothing")
    assert r.columns == ["@@version_comment", "@@session.autocommit", "@@nothing"]
    assert r.rows == [("polygate", "1", None)]
    assert ("autocommit", "1") in rows(s, "SHOW VARIABLES LIKE 'auto%'")


@pytest.mark.parametrize(
    ("dialect", "sql", "columns", "first"),
    [
        (PG, "SELECT tablename FROM pg_catalog.pg_tables", ["tablename", "schemaname"], ("alpha", "public")),
        (PG, "SELECT * FROM pg_class", ["tablename", "schemaname"], ("alpha", "public")),
        (PG, "SELECT * FROM pg_catalog.pg_attribute", ["table_name", "column_name", "data_type", "is_nullable", "column_default"], ("alpha", "x", "INTEGER", "YES", None)),
        (TS, "SELECT name FROM sys.tables", ["name", "type"], ("alpha", "U")),
        (TS, "SELECT * FROM sysobjects", ["name", "type"], ("alpha", "U")),
        (TS, "EXEC sp_tables", ["name", "type"], ("alpha", "U")),
        (TS, "EXEC sp_columns alpha", ["COLUMN_NAME", "DATA_TYPE", "is_nullable"], ("x", "INTEGER", 1)),
        (TS, "SELECT * FROM sys.columns", ["COLUMN_NAME", "DATA_TYPE", "is_nullable"], ("x", "INTEGER", 1)),
        (LITE, "PRAGMA table_info(alpha)", ["cid", "name", "type", "notnull", "dflt_value", "pk"], (0, "x", "INTEGER", 0, None, 0)),
        (LITE, "PRAGMA index_list(beta)", ["seq", "name", "unique", "origin", "partial"], (0, "k", 0, "c", 0)),
    ],
)
def test_other_dialects(spark, s, dialect, sql, columns, first):
    other = Session(spark, dialect, s.store)
    r = other.query(sql)
    assert (r.columns, r.rows[0]) == (columns, first)


def test_explain(s):
    assert "Physical Plan" in rows(s, "EXPLAIN SELECT * FROM alpha")[0][0]


def test_names_with_quotes_do_not_break_out(s):
    assert rows(s, "SELECT EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = 'a''; DROP TABLE beta')") == [(0,)]
    assert rows(s, "SHOW TABLES") == [("alpha",), ("beta",)]
