"""One object that holds a store, guards and front ends, for embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polygate.dialect import Options
from polygate.frontends.mysql import MySqlServer
from polygate.frontends.postgres import PostgresServer
from polygate.frontends.tds import TdsServer
from polygate.frontends.wire import WireServer
from polygate.guard import AuthRequest, ConnectionLimiter, WriteAdmission, authenticate, screened
from polygate.lexer import Dialect
from polygate.session import Session
from polygate.sources.hrana import HranaServer
from polygate.sources.store import Store


class Gateway:
    """``Gateway(spark).open(path).max_connections(50).mysql(port=3306).serve()``; sessions of any dialect by connect()."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.store = spark, None
        self.options, self.limiter, self.admission = Options(), ConnectionLimiter(0), None
        self._authenticator: Callable[[AuthRequest], Callable[[Dialect], Session] | None] | None = None
        self._screen, self._external = False, {}
        self._listen: list[tuple[str, str, int]] = []
        self.servers: list[HranaServer | WireServer] = []

    def open(self, path: str, read_only: bool = False) -> Gateway:
        self.store = Store(self.spark, path, read_only)
        return self

    def memory(self) -> Gateway:
        self.store = Store(self.spark)
        return self

    def table(self, name: str, df: DataFrame) -> Gateway:
        """A read-only table that all sessions see."""
        self._external[name] = df
        return self

    def with_options(self, options: Options) -> Gateway:
        self.options = options
        return self

    def with_authenticator(self, authenticator) -> Gateway:
        self._authenticator = authenticator
        return self

    def max_connections(self, n: int) -> Gateway:
        self.limiter = ConnectionLimiter(n)
        return self

    def write_permits(self, n: int, timeout: float = 30.0) -> Gateway:
        self.admission = WriteAdmission(n, timeout) if n else None
        return self

    def tenant_screen(self, on: bool = True) -> Gateway:
        self._screen = on
        return self

    def mysql(self, host: str = "127.0.0.1", port: int = 0) -> Gateway:
        self._listen.append(("mysql", host, port))
        return self

    def postgres(self, host: str = "127.0.0.1", port: int = 0) -> Gateway:
        return self._open_to_all("postgres", host, port)

    def tds(self, host: str = "127.0.0.1", port: int = 0) -> Gateway:
        return self._open_to_all("tds", host, port)

    def hrana(self, host: str = "127.0.0.1", port: int = 0) -> Gateway:
        return self._open_to_all("hrana", host, port)

    def _open_to_all(self, kind: str, host: str, port: int) -> Gateway:
        """Front ends without logins: they can't be offered beside an authenticator."""
        if self._authenticator is not None:
            raise ValueError(f"{kind} has no logins here: it can't be offered with an authenticator")
        self._listen.append((kind, host, port))
        return self

    def session(self, dialect: Dialect) -> Session:
        if self.store is None:
            self.memory()
        out = Session(self.spark, dialect, self.store, self.options, admission=self.admission, screen=screened(dialect) if self._screen else None)
        for name, df in self._external.items():
            out.register(name, df)
        return out

    def connect(self, dialect: Dialect = Dialect.MYSQL, request: AuthRequest | None = None) -> Session:
        """A session within the limit of connections, of the user's own tables where there is an authenticator."""
        slot = self.limiter.acquire()
        try:
            if self._authenticator is not None:
                out = authenticate(self._authenticator, request or AuthRequest(""))(dialect)
            else:
                out = self.session(dialect)
        except BaseException:
            slot.release()
            raise
        close = out.close

        def closing() -> None:
            close()
            slot.release()

        out.close = closing
        return out

    def serve(self) -> Gateway:
        """Starts the front ends; they run until :meth:`close`."""
        for kind, host, port in self._listen:
            if kind != "mysql" and self._authenticator is not None:
                raise ValueError(f"{kind} has no logins here: it can't be offered with an authenticator")
            if kind == "hrana":
                server = HranaServer(lambda: self.session(Dialect.SQLITE), host, port, self.limiter)
            elif kind == "mysql":
                server = MySqlServer(self.connect, host, port)
            else:
                server = {"postgres": PostgresServer, "tds": TdsServer}[kind](lambda dialect, user: self.connect(dialect, AuthRequest(user)), host, port)
            self.servers.append(server.start())
        self._listen.clear()
        return self

    def close(self) -> None:
        for s in self.servers:
            s.close()
        self.servers.clear()
        if self.store is not None:
            self.store.close()
