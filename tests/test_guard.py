"""Screens, logins, connections, write permits, pools, the HTTP pipeline and the command line."""

import threading
import time
import urllib.request

import pytest

from polygate import Dialect, Gateway, Session, Store
from polygate.__main__ import main
from polygate.errors import AccessDenied, BusyError, EngineError, SqlSyntaxError, TooManyConnections, classify
from polygate.guard import AuthRequest, ConnectionLimiter, SessionPool, WriteAdmission, native_response, password_hash, screen_sql, verify
from polygate.sources import hrana

MY, LITE = Dialect.MYSQL, Dialect.SQLITE


@pytest.mark.parametrize(
    "sql",
    [
        "ATTACH 'x' AS y", "DETACH y", "/* */ attach 'x' as y", "SELECT 1; ATTACH 'x' AS y", "EXPLAIN QUERY PLAN ATTACH 'x' AS y", "VACUUM INTO 'f'", "PRAGMA writable_schema = 1", 'PRAGMA main."temp_store_directory" = x',
        "SELECT * FROM parquet.`/etc`", "SELECT * FROM csv.`/etc/passwd`", "CREATE TABLE t (a INT) LOCATION '/x'", "ADD JAR 'x'", "CREATE FUNCTION f AS 'x' USING JAR 'y'", "SET spark.x = 1", "SELECT reflect('a', 'b')", "INSERT OVERWRITE DIRECTORY '/x' SELECT 1",
    ],
)
def test_screen_refuses(sql):
    with pytest.raises(AccessDenied):
        screen_sql(sql)


@pytest.mark.parametrize("sql", ["SELECT 'ATTACH'", "SELECT attach FROM t", "VACUUM", "PRAGMA table_info(t)", "SET NAMES utf8", "SELECT parquet.a FROM parquet", "CREATE TABLE location (a INT)"])
def test_screen_lets_pass(sql):
    screen_sql(sql, MY if sql.startswith("SET") else LITE)


def test_screen_of_broken_text():
    with pytest.raises(SqlSyntaxError):
        screen_sql("SELECT 'a")


def test_native_password():
    salt = bytes(range(20))
    stored = password_hash(b"secret")
    assert verify(stored, salt, native_response(b"secret", salt))
    assert not verify(stored, salt, native_response(b"wrong", salt))
    assert not verify(stored, salt, b"")
    assert verify(password_hash(b""), salt, b"")


def test_limiter():
    limit = ConnectionLimiter(1)
    with limit.acquire() as slot:
        assert limit.try_acquire() is None
        with pytest.raises(TooManyConnections) as e:
            limit.acquire()
        assert classify(e.value).code == 1040
        slot.release()
        slot.release()
    assert limit.used == 0
    assert ConnectionLimiter(0).try_acquire() is not None


def test_write_admission_is_first_come_first_served():
    gate, order = WriteAdmission(1, 5), []
    first = object()
    gate.admit(first)
    assert gate.admit(first) is gate

    def wait(n):
        me = object()
        gate.admit(me)
        order.append(n)
        gate.release(me)

    threads = []
    for n in range(3):
        threads.append(threading.Thread(target=wait, args=(n,)))
        threads[-1].start()
        time.sleep(0.05)
    gate.release(first)
    for t in threads:
        t.join()
    assert order == [0, 1, 2]
    short = WriteAdmission(1, 0.05)
    short.admit(first)
    with pytest.raises(BusyError):
        short.admit(object())
    short.release(first)
    short.admit(object())


def test_writers_wait_and_readers_do_not(spark):
    store, gate = Store(spark), WriteAdmission(1, 0.2)
    a, b = (Session(spark, MY, store, admission=gate) for _ in range(2))
    a.query("CREATE TABLE t (v INT)")
    a.query("BEGIN")
    a.query("INSERT INTO t VALUES (1)")
    assert b.query("SELECT COUNT(*) FROM t").rows == [(0,)]
    with pytest.raises(BusyError):
        b.query("INSERT INTO t VALUES (2)")
    a.query("COMMIT")
    b.query("INSERT INTO t VALUES (2)")
    assert a.query("SELECT COUNT(*) FROM t").rows == [(2,)]
    store.close()


def test_pool_keeps_clean_sessions(spark):
    pool = SessionPool(lambda: Session(spark, MY), 1)
    s = pool.checkout()
    assert pool.park(s)
    assert pool.checkout() is s
    s.spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert not pool.park(s)
    t = pool.checkout()
    assert t is not s
    t.query("CREATE TABLE x (a INT)")
    t.query("BEGIN")
    assert not pool.park(t)


def test_tenants_see_their_own_tables(spark):
    salt, users = b"s" * 20, {}
    for name in ("ann", "bob"):
        g = Gateway(spark).memory().tenant_screen()
        g.session(MY).query(f"CREATE TABLE secrets AS SELECT '{name}' AS owner")
        users[name] = (password_hash(name.encode()), g)

    def authenticator(r):
        stored, g = users.get(r.user, (b"", None))
        return g.session if g and verify(stored, salt, r.response) else None

    gate = Gateway(spark).with_authenticator(authenticator).max_connections(2)
    for name in users:
        c = gate.connect(MY, AuthRequest(name, salt, native_response(name.encode(), salt)))
        assert c.query("SELECT owner FROM secrets").rows == [(name,)]
        with pytest.raises(AccessDenied):
            c.query("SELECT * FROM parquet.`/`")
        c.close()
    for user, word in (("ann", b"bob"), ("eve", b"eve")):
        with pytest.raises(AccessDenied) as e:
            gate.connect(MY, AuthRequest(user, salt, native_response(word, salt)))
        assert classify(e.value).code == 1045
    assert gate.limiter.used == 0
    with pytest.raises(ValueError):
        gate.hrana()


# --- the HTTP pipeline ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def server(spark):
    g = Gateway(spark).memory().hrana().serve()
    yield g.servers[0]
    g.close()


def test_pipeline_round_trip(spark, server):
    c = hrana.HranaClient(server.url)
    assert c.health_check()
    assert urllib.request.urlopen(f"{server.url}/version").read().startswith(b"polygate/")
    c.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, label TEXT, price REAL, b BLOB)")
    r = c.execute("INSERT INTO items VALUES (?, ?, ?, ?)", [1, "é", 2.5, b"\x00\xff"])
    assert (r["affected_row_count"], r["last_insert_rowid"]) == (1, "1")
    c.execute("INSERT INTO items VALUES (2, NULL, NULL, NULL)")
    r = c.execute("SELECT * FROM items ORDER BY id")
    assert [x["name"] for x in r["cols"]] == ["id", "label", "price", "b"]
    assert r["rows"] == [(1, "é", 2.5, b"\x00\xff"), (2, None, None, None)]
    with pytest.raises(EngineError):
        c.execute("SELECT * FROM missing")
    got = c.pipeline([{"type": "execute", "stmt": {"sql": "SELEC"}}, {"type": "execute", "stmt": {"sql": "SELECT 1"}}, {"type": "close"}])
    assert [x["type"] for x in got] == ["error", "ok", "ok"]


def test_remote_reader(spark, server):
    c = hrana.HranaClient(server.url)
    c.execute("CREATE TABLE nums AS SELECT id FROM range(10)")
    df = hrana.read(spark, server.url, "SELECT id FROM nums WHERE id >= ? AND id < ?", "id long", slices=[(0, 5), (5, 10)])
    assert sorted(r.id for r in df.collect()) == list(range(10))


def test_wire_values():
    for v in (None, 0, -(2**63), 1.5, "x", b"\x01"):
        assert hrana.from_wire(hrana.to_wire(v)) == v
    assert hrana.to_wire(True) == {"type": "integer", "value": "1"}
    assert hrana.from_wire({"type": "integer", "value": "x"}) == 0
    assert hrana.from_wire({"type": "blob", "base64": "!"}) == b""


def test_unreachable_server():
    c = hrana.HranaClient("http://127.0.0.1:9", timeout=1)
    assert not c.health_check()
    with pytest.raises(EngineError):
        c.execute("SELECT 1")


def test_command_line(spark, tmp_path, capsys):
    db = str(tmp_path / "db")
    assert main(["--db", db, "CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2)"], spark) == 0
    assert main(["--db", db, "SELECT a FROM t ORDER BY a"], spark) == 0
    assert capsys.readouterr().out.splitlines()[-3:] == ["a", "1", "2"]
    assert main(["--db", db, "--dialect", "postgres", "SELECT * FROM nope"], spark) == 1
    assert main(["--tables", "/root/testdata/sf0.001", "--dialect", "tsql", "SELECT TOP 1 r_name FROM region ORDER BY r_name"], spark) == 0
