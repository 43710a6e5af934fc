"""What the operators share: the shared folder, staged tables and small Arrow helpers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where that is unset (a local session, as in tests) a temporary folder is made and set.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="polygate-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path of the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_tops: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's part of the shared folder, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _tops:
        top = f"{shared_dir(spark)}/polygate-{app}-{uuid.uuid4().hex[:6]}"
        files, p = _hadoop(spark, top)
        files.mkdirs(p)
        files.deleteOnExit(p)
        _tops[app] = top
    return f"{_tops[app]}/{label}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, through Hadoop's file system."""
    files, p = _hadoop(spark, path)
    files.delete(p, True)


def publish(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes one file below a fresh path of the shared folder, through Hadoop's file system; returns its path."""
    path = f"{scratch(spark, 'file')}/{name}"
    files, p = _hadoop(spark, path)
    out = files.create(p)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when the action ends: for what is written and read back from there."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before is None:  # a Spark without it keeps them until its own cleaner comes
        yield
        return
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Staged:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a rerun.

    Those that a lazy result still reads stay until the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch(self.spark, label)
        with tidy(self.spark):
            df.write.parquet(path)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """For tables that no later step reads."""
        for label in labels:
            if label in self.paths:
                remove(self.spark, self.paths.pop(label))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that no executor needs it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(publish(spark, "polygate.zip", data.getvalue()))
    _shipped.add(app)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with the package sent along."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return map_arrow(df, run, schema)


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, at): ``at`` finds a text again, also where ids are null or repeat."""
    return documents(docs).withColumn("at", F.xxhash64("doc_id", "text"))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the text operators need, so that others, whatever their names, never clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_U = np.uint64
#: Multipliers of two families of ranks, independent of one another.
_PAIR = ((_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)), (_U(0xC2B2AE3D27D4EB4F), _U(0xFF51AFD7ED558CCD)))


def pair(left: np.ndarray, right: np.ndarray, family: int = 0) -> np.ndarray:
    """The rank (a 64-bit name) of each pair of ranks."""
    a, b = _PAIR[family]
    out = left * a
    out += right
    out ^= out >> _U(32)
    out *= b
    out ^= out >> _U(29)
    return out


def doubled(rank: np.ndarray, lengths: tuple[int, ...], family: int = 0) -> list[np.ndarray]:
    """For each of the lengths, which ascend, the ranks of all stretches of that length, by prefix doubling."""
    h, out = 1, []
    for length in lengths:
        while 2 * h <= length:
            rank, h = pair(rank[: max(0, len(rank) - h)], rank[h:], family), 2 * h
        more = length - h  # a pair at this offset overlaps and reaches the length
        out.append(pair(rank[: max(0, len(rank) - more)], rank[more:], family) if more else rank)
    return out
