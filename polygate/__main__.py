"""``python -m polygate [--db PATH] [--tables FOLDER] [--dialect mysql] [--mysql-listen HOST:PORT] [--postgres-listen ...] [--tds-listen ...] [--hrana-listen ...] [SQL]``"""

from __future__ import annotations

import argparse
import sys
import threading

from pyspark.sql import SparkSession

from polygate.errors import classify
from polygate.gateway import Gateway
from polygate.lexer import Dialect
from polygate.session import Session

FRONT_ENDS = ("mysql", "postgres", "tds", "hrana")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs statements, from the command line or standard input, or serves front ends."""
    p = argparse.ArgumentParser(prog="polygate", description=__doc__)
    p.add_argument("--db", help="folder of the table store; a temporary one if not given")
    p.add_argument("--tables", help="folder of Parquet tables, read-only")
    p.add_argument("--dialect", choices=[d.value for d in Dialect], default="mysql")
    for kind in FRONT_ENDS:
        p.add_argument(f"--{kind}-listen", metavar="HOST:PORT", help=f"serve the {'HTTP pipeline' if kind == 'hrana' else f'{kind} protocol'}")
    p.add_argument("sql", nargs="?", help="statements; - for standard input")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("polygate").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    gateway = Gateway(spark)
    if a.db:
        gateway.open(a.db)
    if a.tables:
        for name in Session(spark).register_parquet(a.tables).external:
            gateway.table(name, spark.read.parquet(f"{a.tables}/{name}.parquet"))
    where = {kind: at for kind in FRONT_ENDS if (at := getattr(a, f"{kind}_listen"))}
    for kind, at in where.items():
        host, _, port = at.rpartition(":")
        getattr(gateway, kind)(host or "127.0.0.1", int(port))
    if where:
        for kind, server in zip(where, gateway.serve().servers, strict=True):
            print(f"{kind}: listening on {server.host}:{server.port}", flush=True)
        if a.sql is None:
            threading.Event().wait()
    if a.sql is None:
        p.error("a statement or a front end is needed")
    session = gateway.session(Dialect(a.dialect))
    try:
        out = session.query(sys.stdin.read() if a.sql == "-" else a.sql)
    except Exception as e:
        m = classify(e, a.dialect)
        print(f"error {m.code} ({m.sqlstate}): {m.message}", file=sys.stderr)
        return 1
    finally:
        session.close()
        gateway.close()
    if out.columns:
        print("\t".join(out.columns))
        for row in out.rows:
            print("\t".join("NULL" if v is None else str(v) for v in row))
    else:
        print(f"{out.affected} rows affected")
    return 0


if __name__ == "__main__":
    sys.exit(main())
