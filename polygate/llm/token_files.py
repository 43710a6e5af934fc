"""Token ids as flat binary files with document offsets, memory-mapped on reading.

Part p of a corpus has three files: ``p.ids`` (unsigned integers, 16 bits if all ids of the vocabulary fit, else 32),
``p.off`` (unsigned 64-bit offsets: where each document of the part begins, counted from the part's own start, and
the part's length at the end) and ``p.doc`` (signed 64-bit doc_ids).  ``index.json`` lists the parts in order, each with
its base: the ids of all parts before it, a prefix sum over part lengths.  So parts are written in parallel, before any
base is known, and a document's global start is its part's base plus its offset.

A part is written under a name of its own attempt and then renamed, so a retried or doubled task leaves the same file.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polygate.llm import bpe
from polygate.llm.common import documents, map_arrow, scratch

#: Bytes of text that a part holds, about.
PART_BYTES = 256 << 20
_ROWS = 256
_COPY = 4 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _writer(folder: str, content, lexicon: str | None, kind: str, end_id: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes the rows of a partition, which are in order, and writes them as one part; returns its name and sizes."""
    tail = np.array([] if end_id is None else [end_id], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = bpe.encoder(content.value, lexicon)
        out, root = _open(folder)
        mine = uuid.uuid4().hex
        names = {e: (f"{root}/.{part:06d}-{mine}.{e}", f"{root}/{part:06d}.{e}") for e in ("ids", "off", "doc")}
        streams, at, n_docs, n_null = {}, 0, 0, 0
        for whole in batches:
            for batch in (whole.slice(i, _ROWS) for i in range(0, whole.num_rows, _ROWS)):
                if not streams:
                    streams = {e: out.open_output_stream(a, buffer_size=1 << 20) for e, (a, _) in names.items()}
                n = np.empty(batch.num_rows, np.uint64)
                for i, ids in enumerate(enc.batch(batch.column("text").to_pylist())):
                    streams["ids"].write(ids.astype(kind).tobytes() + tail.tobytes())
                    n[i] = len(ids) + len(tail)
                streams["off"].write((np.uint64(at) + np.cumsum(n) - n).astype("<u8").tobytes())
                at += int(n.sum())
                n_null += batch.column("doc_id").null_count
                streams["doc"].write(batch.column("doc_id").fill_null(0).to_numpy().astype("<i8").tobytes())
                n_docs += batch.num_rows
        if streams:
            streams["off"].write(np.array([at], "<u8").tobytes())
            for e, s in streams.items():
                s.close()
                out.move(*names[e])
            cols = [pa.array([x], pa.int64()) for x in (part, n_docs, n_null, at)]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "n_docs", "n_null", "n_ids"])

    return run


def write(spark: SparkSession, docs: DataFrame, path: str, folder: str, end_id: int | None = None, lexicon_words: int = 0) -> dict:
    """Encodes ``docs`` (doc_id, text) with the tokenizer file ``path`` and writes them in ascending doc_id order.

    Null texts count as empty; null ids come first; rows that repeat an id are ordered by their texts.  Returns the
    index.  Texts, not ids, are dealt by ranges of doc_id, and the task that writes a part encodes it: each text is
    moved once, and nothing is staged.
    """
    with open(path, encoding="utf-8") as f:
        content = f.read()
    most = max(len(bpe.vocabulary_of(content).tokens) - 1, end_id or 0)
    kind = "<u2" if most < 1 << 16 else "<u4"
    lexicon = bpe.compile_lexicon(spark, docs, content, lexicon_words) if lexicon_words else None
    sent = spark.sparkContext.broadcast(content)  # a tokenizer file: some megabytes
    rows = documents(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    first = F.col("doc_id").asc_nulls_first()
    placed = rows.repartitionByRange(parts, first, F.xxhash64("text").asc()).sortWithinPartitions(first, F.xxhash64("text"), "text")
    out, root = _open(folder)
    out.create_dir(root)
    written = map_arrow(placed, _writer(folder, sent, lexicon, kind, end_id), "part long, n_docs long, n_null long, n_ids long").collect()  # a row for each part
    base, listed = 0, []
    for r in sorted(written):
        listed.append({"part": r.part, "n_docs": r.n_docs, "n_null": r.n_null, "n_ids": r.n_ids, "base": base})
        base += r.n_ids
    index = {"kind": kind, "n_ids": base, "parts": listed}
    with out.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps(index).encode())
    return index


class Part:
    """One part, memory-mapped where the file system is local, else read in ranges."""

    def __init__(self, folder: str, part: int, kind: str) -> None:
        self.fs, root = _open(folder)
        self.base, self.kind = f"{root}/{part:06d}", kind
        self.local = isinstance(self.fs, fs.LocalFileSystem)
        self.maps: dict[str, np.ndarray] = {}

    def load(self, end: str, kind: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        path, size = f"{self.base}.{end}", np.dtype(kind).itemsize
        if self.local:
            if end not in self.maps:
                self.maps[end] = np.memmap(path, kind, "r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, kind)
            return self.maps[end][start:stop]
        with self.fs.open_input_file(path) as f:
            stop = f.size() // size if stop is None else stop
            return np.frombuffer(f.read_at((stop - start) * size, start * size), kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return self.load("ids", self.kind, start, stop)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts all ids before it.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    files, root = _open(folder)
    with files.open_input_file(f"{root}/index.json") as f:
        index = json.loads(f.read())
    rows = [(p["part"], p["base"], p["n_docs"], p["n_null"]) for p in index["parts"]]
    kind = index["kind"]
    parts = spark.createDataFrame(rows, "part long, base long, n_docs long, n_null long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                part = Part(folder, p["part"], kind)
                off, doc = part.load("off", "<u8").astype(np.int64), part.load("doc", "<i8")
                for at in range(0, p["n_docs"], 4096):
                    to = min(at + 4096, p["n_docs"])
                    crc = []
                    for i in range(at, to):
                        c = 0
                        for j in range(off[i], off[i + 1], _COPY):
                            c = zlib.crc32(part.ids(j, min(j + _COPY, int(off[i + 1]))).astype("<u4"), c)
                        crc.append(c)
                    ids = pa.array(doc[at:to], mask=np.arange(at, to) < p["n_null"])
                    cols = [ids, pa.array(off[at:to] + p["base"]), pa.array(np.diff(off[at : to + 1])), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(parts, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame, path: str, end_id: int | None = 2) -> DataFrame:
    """Writes to a fresh path of the shared folder and reads it back.

    A row for each row of ``docs``: null texts have the end id alone, null ids come first, rows that repeat an id follow one
    another.  Very long texts are written whole.  An empty table gives an empty one.
    """
    folder = scratch(spark, "tokens")
    write(spark, docs, path, folder, end_id)
    return read(spark, folder)
