"""SQLite's record format, as change logs of SQLite-like engines hold rows: for importing such logs.

A record is a header (its length and a serial type for each column, as variable-length integers) and the columns' values one
after the other.  Decoding is by batches of a table, each record to an array of columns.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Fixed values of the format: bytes of an integer by serial type.
_SIZES = {1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 8}
COLUMN = "struct<kind:string,integer:bigint,real:double,text:string,blob:binary>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("integer", pa.int64()), ("real", pa.float64()), ("text", pa.string()), ("blob", pa.binary())]))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer: up to eight bytes of seven bits, and a ninth of eight."""
    n = 0
    for i in range(9):
        if at + i >= len(data):
            raise ValueError("a record ends within its header")
        b = data[at + i]
        if i == 8:
            return n << 8 | b, at + 9
        n = n << 7 | b & 0x7F
        if not b & 0x80:
            return n, at + i + 1
    raise AssertionError


def decode(data: bytes) -> list[int | float | str | bytes | None]:
    """The columns of one record.  Reserved types, and records that are cut short, raise ValueError."""
    head, at = _varint(data, 0)
    if head > len(data) or head < at:
        raise ValueError("a record's header is longer than the record")
    kinds = []
    while at < head:
        kind, at = _varint(data, at)
        kinds.append(kind)
    if at != head:
        raise ValueError("a record's header is cut short")
    out: list[int | float | str | bytes | None] = []
    for kind in kinds:
        if kind in (10, 11):
            raise ValueError(f"serial type {kind} is reserved")
        size = 8 if kind == 7 else _SIZES.get(kind, 0) if kind < 12 else (kind - 12) // 2
        value = data[at : at + size]
        if len(value) < size:
            raise ValueError("a record is cut short")
        at += size
        if kind == 0:
            out.append(None)
        elif kind in _SIZES:
            out.append(int.from_bytes(value, "big", signed=True))
        elif kind == 7:
            out.append(struct.unpack(">d", value)[0])
        elif kind in (8, 9):
            out.append(kind - 8)
        else:
            out.append(value.decode("utf-8", "replace") if kind % 2 else value)
    return out


def _column(v: int | float | str | bytes | None) -> dict:
    kind = {int: "integer", float: "real", str: "text", bytes: "blob", type(None): "null"}[type(v)]
    return {"kind": kind} | ({} if v is None else {kind: v})


def decoded(df: DataFrame, key: str, record: str) -> DataFrame:
    """(``key``, columns): the records of a binary column, each as an array of columns; a null record has null columns."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if r is None else [_column(v) for v in decode(r)] for r in batch.column(record).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, _TYPE)], names=[key, "columns"])

    return df.select(key, record).mapInArrow(run, f"`{key}` {kind}, columns array<{COLUMN}>")
