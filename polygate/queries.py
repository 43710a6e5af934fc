"""Queries over the test tables, one for each kind of operator, each in a dialect; beside each the same in DuckDB's SQL.

A key is the operator's number in the survey and a name.  Queries that change tables do so in a store of their own, on
copies of whole tables, and return what is then there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polygate import session_queries
from polygate.lexer import Dialect
from polygate.session import Session
from polygate.sources.store import Store
from polygate.streaming import cdc, windows

MY, PG, TS, LITE = Dialect.MYSQL, Dialect.POSTGRES, Dialect.TSQL, Dialect.SQLITE
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = dict(session_queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(session_queries.ORACLE_SQL)
#: Tables of the test data that dialect queries may name.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _named(sql: str) -> list[str]:
    words = {w.lower() for w in sql.replace("(", " ").replace(")", " ").replace(",", " ").replace("[", " ").replace("]", " ").replace('"', " ").replace("`", " ").replace(".", " ").split()}
    return [t for t in TABLES if t in words]


def _add(key: str, dialect: Dialect, sql: str, oracle: str | None = None, params: list | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Session(spark, dialect).register_parquet(sf_dir, _named(sql)).sql(sql, params)

    run.__name__ = key
    QUERIES[key] = run
    ORACLE_SQL[key] = oracle or sql


FLAGSHIP = """
SELECT SQL_NO_CACHE n_name, YEAR(o_orderdate) AS o_year, COUNT(DISTINCT o_orderkey) AS n_orders,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
     JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') AND l_returnflag = 'R'
GROUP BY n_name, YEAR(o_orderdate) HAVING COUNT(*) > 5
ORDER BY revenue DESC, n_name, o_year LIMIT 0, 10
"""
_add("A1_flagship_mysql", MY, FLAGSHIP, FLAGSHIP.replace("SQL_NO_CACHE ", "").replace("LIMIT 0, 10", "LIMIT 10 OFFSET 0"))

# --- A: sources -----------------------------------------------------------------------------------------------------
_add("A1_table_scan", LITE, "SELECT * FROM nation")
_add("A2_no_table", MY, "SELECT CAST(1 + 2 AS SIGNED) AS three, 'a\\\\b' AS s", "SELECT CAST(3 AS BIGINT) AS three, 'a\\b' AS s")
_add("A3_comma_source", PG, "WITH a AS (SELECT r_name FROM region), b AS (SELECT n_name FROM nation WHERE n_regionkey = 1) SELECT r_name, n_name FROM a, b")
_add("A4_derived_table", MY, "SELECT t.k, t.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t WHERE t.n > 12")
_add("A5_values", PG, "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) AS v(i, s)")

# --- B: projection and predicates -----------------------------------------------------------------------------------
_add("B1_project_alias", TS, "SELECT [c_custkey] AS [key], c_acctbal * 2 AS twice FROM [customer]", "SELECT c_custkey AS key, c_acctbal * 2 AS twice FROM customer")
_add("B2_filter", MY, "SELECT `o_orderkey` FROM `orders` WHERE (o_orderstatus = \"F\" AND o_totalprice > 1000) OR o_custkey = 7", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 1000) OR o_custkey = 7")
_add("B3_arithmetic", PG, "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity - 1 AS q, l_orderkey % 7 AS m FROM lineitem WHERE l_quantity <> 10")
_add("B4_between", MY, "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 0 AND 900")
_add("B5_is_null", PG, "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL AND c_name IS NOT NULL")
_add("B6_in_list", TS, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment NOT IN (N'BUILDING')", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment NOT IN ('BUILDING')")
_add("B7_like_mysql_escape", MY, "SELECT n_name FROM nation WHERE n_name LIKE 'NATION\\_1%' AND n_name NOT LIKE 'NATION\\_%5'", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION\\_1%' ESCAPE '\\' AND n_name NOT LIKE 'NATION\\_%5' ESCAPE '\\'")
_add("B8_like_no_escape", PG, "SELECT n_name, n_name LIKE 'NATION\\_1%' AS escaped FROM nation WHERE n_name LIKE 'NATION_1%'", "SELECT n_name, FALSE AS escaped FROM nation WHERE n_name LIKE 'NATION_1%'")
_add("B9_like_escape", TS, "SELECT n_name FROM nation WHERE n_name LIKE 'NATION|_1_' ESCAPE '|'")
_add("B10_ilike", PG, "SELECT n_name FROM nation WHERE n_name ILIKE 'nation_2%'")
_add("B11_regexp", MY, "SELECT n_name FROM nation WHERE n_name REGEXP '_1[0-5]$' AND n_name NOT REGEXP '3'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '_1[0-5]$') AND NOT regexp_matches(n_name, '3')")
_add("B12_case", MY, "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS size, COALESCE(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END, 0) AS st FROM orders")
_add("B13_scalar_subquery", PG, "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
_add("B14_in_subquery", MY, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))")
_add("B15_exists", TS, "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
_add("B16_booleans", PG, "SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders WHERE TRUE AND NOT FALSE AND (o_orderstatus = 'F') = TRUE")
_add("B17_cast", PG, "SELECT o_orderkey::text AS k, CAST(o_totalprice AS INT8) AS whole FROM orders", "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
_add("B18_placeholders", PG, "SELECT o_orderkey FROM orders WHERE o_orderstatus = $2 AND o_custkey > $1 AND o_orderkey > $1", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 20 AND o_orderkey > 20", [20, "O"])
_add("B19_quoting", LITE, 'SELECT "r_name" AS "the name", [r_regionkey] AS `the key` FROM "region"', 'SELECT r_name AS "the name", r_regionkey AS "the key" FROM region')

# --- C: joins -------------------------------------------------------------------------------------------------------
_add("C1_inner", MY, "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
_add("C2_left", PG, "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
_add("C3_right", TS, "SELECT n_name, COUNT(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
_add("C4_cross", MY, "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b")
_add("C5_multi_way", PG, "SELECT r_name, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_add("C6_self", MY, "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("C7_join_cte", PG, "WITH best AS (SELECT o_custkey AS k, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c_name, top FROM customer JOIN best ON c_custkey = k")
_add("C8_anti_not_exists", MY, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add("C8_anti_not_in", PG, "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
_add("C9_theta", TS, "SELECT a.s_suppkey AS a, b.r_regionkey AS b FROM supplier a JOIN region b ON a.s_nationkey < b.r_regionkey * 3")
_add("C10_full_using_natural", PG, "SELECT COALESCE(c_custkey, -1) AS c, COALESCE(s_suppkey, -1) AS s FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey")
_add("C10_natural", LITE, "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) AS x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) AS y")
_add("C10_lateral", PG, "SELECT r_name, t.n FROM region, LATERAL (SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = r_regionkey) AS t")
_add("C10_using", PG, "SELECT k, n_name, x FROM (SELECT n_nationkey AS k, n_name FROM nation) AS t JOIN (SELECT c_nationkey AS k, COUNT(*) AS x FROM customer GROUP BY c_nationkey) AS u USING (k)")

# --- D, E: aggregates and windows -----------------------------------------------------------------------------------
_add("D1_count", MY, "SELECT COUNT(*) AS n, COUNT(o_orderkey) AS m FROM orders")
_add("D2_sum_avg_min_max", PG, "SELECT l_returnflag, SUM(l_quantity) AS q, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, ROUND(AVG(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag")
_add("D3_count_distinct", MY, "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_returnflag")
_add("D4_group_by_many", TS, "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("D5_having", MY, "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14 AND MAX(o_totalprice) > 1000")
_add("D5_having_global", PG, "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 10")
_add("D6_distinct", MY, "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_add("D7_derived_total", MY, "SELECT COUNT(*) AS total FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS q")
_add("D8_group_concat", MY, "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_add("D9_bare_columns", MY, "SELECT n_regionkey, r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT n_regionkey, any_value(r_name) AS r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
_add("D10_rollup", PG, "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_add("E1_ranking", PG, "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk FROM orders", "SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS rk FROM orders")
_add("E1_frames", MY, "SELECT o_custkey, o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, LAG(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders")

# --- F, G: order, limits, sets, CTEs --------------------------------------------------------------------------------
_add("F1_order_by", PG, "SELECT c_custkey, c_name FROM customer ORDER BY c_mktsegment DESC, c_custkey ASC")
_add("F2_order_by_expr", MY, "SELECT p_partkey FROM part ORDER BY p_size * -1, LOWER(p_name), p_partkey")
_add("F3_limit_offset", PG, "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_add("F4_limit_comma", MY, "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_add("F5_top", TS, "SELECT TOP (7) o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
_add("F6_limit_placeholder", MY, "SELECT o_orderkey FROM orders WHERE o_custkey > ? ORDER BY o_orderkey LIMIT ?, ?", "SELECT o_orderkey FROM orders WHERE o_custkey > 30 ORDER BY o_orderkey LIMIT 8 OFFSET 4", [30, 4, 8])
_add("G1_union", PG, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
_add("G2_union_all", MY, "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_add("G3_intersect", PG, "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_add("G4_except", PG, "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_add("G5_ctes", MY, "WITH a AS (SELECT o_custkey AS k, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE t > 500000) SELECT c_name FROM customer JOIN b ON c_custkey = k")
_add("G6_recursive_cte", PG, "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r")

# --- H: functions ---------------------------------------------------------------------------------------------------
_add("H4_isnull", TS, "SELECT c_custkey, ISNULL(o_orderkey, 0) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey, ifnull(o_orderkey, 0) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
_add("H7_session_functions", MY, "SELECT DATABASE() AS db, VERSION() AS v, USER() AS u, CONNECTION_ID() AS c", "SELECT 'main' AS db, '8.0.36-polygate' AS v, 'root@localhost' AS u, 0 AS c")
_add("H14_date_parts", MY, "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DAYOFMONTH(o_orderdate) AS dm FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, day(o_orderdate) AS dm FROM orders")
_add("H14_nested_in_join_and_order", MY, "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND YEAR(l_shipdate) = YEAR(o_orderdate) GROUP BY YEAR(o_orderdate) ORDER BY YEAR(o_orderdate)")
_add("H15_day_numbers", MY, "SELECT o_orderkey, DAYOFWEEK(o_orderdate) AS w, DAYOFYEAR(o_orderdate) AS y FROM orders", "SELECT o_orderkey, dayofweek(o_orderdate) + 1 AS w, dayofyear(o_orderdate) AS y FROM orders")
_add("H16_coalesce", LITE, "SELECT c_custkey, COALESCE(NULL, c_mktsegment, 'x') AS s, IFNULL(NULL, 5) AS i FROM customer", "SELECT c_custkey, COALESCE(NULL, c_mktsegment, 'x') AS s, ifnull(NULL, 5) AS i FROM customer")
_add("H18_regexp_function", LITE, "SELECT n_name, regexp('_1[0-4]$', n_name) AS hit FROM nation", "SELECT n_name, regexp_matches(n_name, '_1[0-4]$') AS hit FROM nation")
_add("H20_strings_and_math", LITE, "SELECT p_partkey, UPPER(p_name) AS u, LENGTH(p_brand) AS l, ABS(-p_size) AS a, ROUND(p_retailprice, 1) AS r, SUBSTR(p_type, 1, 3) AS s, TRIM('  x ') AS t, REPLACE(p_brand, '#', '-') AS b FROM part", "SELECT p_partkey, UPPER(p_name) AS u, CAST(LENGTH(p_brand) AS INTEGER) AS l, ABS(-p_size) AS a, ROUND(p_retailprice, 1) AS r, SUBSTR(p_type, 1, 3) AS s, TRIM('  x ') AS t, REPLACE(p_brand, '#', '-') AS b FROM part")
_add("H21_json", PG, "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")

# --- K: metadata ----------------------------------------------------------------------------------------------------
_add("K10_variables", MY, "SELECT @@autocommit, @@version, @@no_such_thing", "SELECT '1' AS \"@@autocommit\", '8.0.36-polygate' AS \"@@version\", CAST(NULL AS VARCHAR) AS \"@@no_such_thing\"")


def _k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, PG).register_parquet(sf_dir, ["region", "nation"]).sql("SELECT table_name, table_type FROM information_schema.tables")


QUERIES["K7_information_schema"] = _k7
ORACLE_SQL["K7_information_schema"] = "SELECT * FROM (VALUES ('nation', 'BASE TABLE'), ('region', 'BASE TABLE')) AS t(table_name, table_type)"


# --- I, J, L, N: changes, transactions, sessions, replication -------------------------------------------------------


def _script(key: str, dialect: Dialect, source: str, statements: list[str], result: str, oracle: str) -> None:
    """Copies ``source`` into a store, runs statements, returns a query's rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session(spark, dialect).register_parquet(sf_dir, _named(" ".join([source, *statements])))
        s.query(source)
        for sql in statements:
            s.query(sql)
        return s.sql(result)

    run.__name__ = key
    QUERIES[key], ORACLE_SQL[key] = run, oracle


_ORDERS = "CREATE TABLE o AS SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_script("I2_insert_select", MY, _ORDERS, ["INSERT INTO o SELECT o_orderkey + 1000000, o_custkey, 'N', 0 FROM orders WHERE o_orderstatus = 'P'"], "SELECT * FROM o", f"{_O} UNION ALL SELECT o_orderkey + 1000000, o_custkey, 'N', 0 FROM orders WHERE o_orderstatus = 'P'")
_script("I7_update", MY, _ORDERS, ["UPDATE o SET o.o_totalprice = o_totalprice * 2, o_orderstatus = 'U' WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"], "SELECT * FROM o", "SELECT o_orderkey, o_custkey, CASE WHEN c_nationkey = 3 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN c_nationkey = 3 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
_script("I9_delete", PG, _ORDERS, ["DELETE FROM o WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)"], "SELECT * FROM o", f"{_O} WHERE NOT (o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12))")
_PART = "CREATE TABLE p (p_partkey BIGINT, p_name VARCHAR(80), p_size INT, PRIMARY KEY (p_partkey))"
_FILL = "INSERT INTO p SELECT p_partkey, p_name, p_size FROM part"
_script("I5_upsert", MY, _PART, [_FILL, "INSERT INTO p (p_partkey, p_name, p_size) SELECT p_partkey * 3, 'new', 1 FROM part ON DUPLICATE KEY UPDATE p_name = CONCAT(VALUES(p_name), '!'), p_size = p_size + VALUES(p_size)"], "SELECT * FROM p",
        "WITH n AS (SELECT p_partkey * 3 AS k FROM part) SELECT COALESCE(p_partkey, k) AS p_partkey, CASE WHEN p_partkey IS NULL THEN 'new' WHEN k IS NULL THEN p_name ELSE 'new!' END AS p_name, CAST(CASE WHEN p_partkey IS NULL THEN 1 WHEN k IS NULL THEN p_size ELSE p_size + 1 END AS BIGINT) AS p_size FROM part FULL JOIN n ON p_partkey = k")
_script("I6_replace", MY, _PART, [_FILL, "REPLACE INTO p SELECT p_partkey * 3, 'new', 1 FROM part"], "SELECT * FROM p",
        "WITH n AS (SELECT p_partkey * 3 AS k FROM part) SELECT COALESCE(k, p_partkey) AS p_partkey, CASE WHEN k IS NULL THEN p_name ELSE 'new' END AS p_name, CAST(CASE WHEN k IS NULL THEN p_size ELSE 1 END AS BIGINT) AS p_size FROM part FULL JOIN n ON p_partkey = k")
_script("J_savepoints", PG, _ORDERS, ["START TRANSACTION", "DELETE FROM o WHERE o_orderstatus = 'P'", "SAVEPOINT a", "DELETE FROM o", "ROLLBACK TO SAVEPOINT a", "COMMIT WORK", "BEGIN", "DELETE FROM o", "ROLLBACK"], "SELECT * FROM o", f"{_O} WHERE o_orderstatus <> 'P'")


def l3_found_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, MY).register_parquet(sf_dir, ["orders"])
    s.query("SELECT SQL_CALC_FOUND_ROWS o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5, 10")
    return s.query("SELECT FOUND_ROWS() AS total").df


def n6_cdc_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica of a table after a bulk insert, an update and a delete, by way of the change log."""
    primary, replica = Store(spark), Store(spark)
    cdc.enable_cdc(primary)
    s = Session(spark, MY, primary).register_parquet(sf_dir, ["part"])
    for sql in (_PART, _FILL, "UPDATE p SET p_size = p_size + 100 WHERE p_size > 25", "DELETE FROM p WHERE p_size < 5"):
        s.query(sql)
    cdc.replicate(spark, primary, replica)
    cdc.replicate(spark, primary, replica)  # changes nothing
    return Session(spark, MY, replica).sql("SELECT * FROM p")


QUERIES |= {"L3_found_rows": l3_found_rows, "N6_cdc_replica": n6_cdc_replica}
ORACLE_SQL |= {
    "L3_found_rows": "SELECT COUNT(*) AS total FROM orders WHERE o_orderstatus = 'F'",
    "N6_cdc_replica": "SELECT p_partkey, p_name, CAST(CASE WHEN p_size > 25 THEN p_size + 100 ELSE p_size END AS BIGINT) AS p_size FROM part WHERE p_size >= 5",
}


# --- event time, beyond the dialects --------------------------------------------------------------------------------


def x_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")
    return out.selectExpr("CAST(window_start AS timestamp_ntz) AS window_start", "event_type", "n", "round(total, 4) AS total")


def x_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "30 minutes")
    return out.selectExpr("user_id", "CAST(session_start AS timestamp_ntz) AS session_start", "n")


QUERIES |= {"X1_tumbling_window": x_tumbling, "X2_session_window": x_sessions}
ORACLE_SQL |= {
    "X1_tumbling_window": "SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY ALL",
    "X2_session_window": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, k
""",
}
