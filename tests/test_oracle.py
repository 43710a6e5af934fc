"""Each registered query of the engine gives the rows that its SQL gives in DuckDB."""

import math
import os

import duckdb
import pytest

from polygate.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("POLYGATE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET threads TO 2")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows_as_duckdb(spark, duck, key):
    df = QUERIES[key](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLE_SQL[key])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["n_name", "o_year", "n_orders", "revenue"]
    assert 0 < df.count() <= 10
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("key, table, kept", [("B17_cast", "orders", "TRUE"), ("B3_arithmetic", "lineitem", "l_quantity <> 10"), ("F1_order_by", "customer", "TRUE"), ("F2_order_by_expr", "part", "TRUE")])
def test_whole_tables(spark, duck, key, table, kept):
    assert QUERIES[key](spark, SF).count() == duck.execute(f"SELECT COUNT(*) FROM {table} WHERE {kept}").fetchone()[0]


def test_order_of_all_rows(spark, duck):
    for key in ("F1_order_by", "F2_order_by_expr"):
        assert [r[0] for r in QUERIES[key](spark, SF).collect()] == [r[0] for r in duck.execute(ORACLE_SQL[key]).fetchall()]
