"""Exact top-k by inner product over a pivot-distance index.

Vectors are rounded down to integers (``floor(scale * x)``).  Each is keyed by its nearest pivot and its distance to
it.  Ranges of (pivot, distance, id) deal the rows into even partitions, whatever pivot or vector is common, and a
partition's rows of a pivot are cut into annuli.  A query at distance ``d`` from the pivot of an annulus ``[a, b]`` is
at least ``gap = max(0, d - b, a - d)`` away from all of it (triangle inequality), so no inner product there exceeds
``(|q|^2 + |x|^2 - gap^2) / 2``, nor ``<q, p> + |q| b``.

The search prunes before it moves anything.  A query's own annulus and its neighbours, which lie in the same partition,
are searched where the index is cut; the k-th score found there is a floor for the query.  A query is then sent only to
annuli whose bound reaches its floor (ties included, so they go to the smaller id, exactly), and an annulus is copied
only as often as the queries that reach it need tasks of bounded size.  Within a task, annuli are visited by falling
bound and the search stops where the bound is below each query's k-th score.

What executors hold of the whole index is a row of five numbers for each annulus, of which there are at most about
``ANNULI`` and one for each pivot and partition: with the rows an annulus grows, not their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polygate.llm.common import Staged, map_arrow, ship

PIVOTS = 64
BLOCK = 2048  # rows of a block, several of which make an annulus in large tables
ANNULI = 16_384  # annuli that hold BLOCK rows or more, at most
PARTS = 8192  # partitions of the index at most
QUERY_CELL = 32_768  # queries that a task compares with an annulus, about
_SIGN = np.uint64(1 << 63)
_LEAST = -(1 << 63)


def _matrix(batch: pa.RecordBatch, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of the rows that take part; shorter vectors are filled with zeros."""
    lists = batch.column("embedding")
    values = lists.flatten()
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.zeros(batch.num_rows, bool)
    bad[row[~np.isfinite(x)]] = True
    bad |= np.asarray(lists.is_null()) | np.asarray(batch.column("vec_id").is_null())
    good = ~bad[row]
    with np.errstate(over="ignore"):
        whole = np.floor(x[good] * scale)
    if len(whole) and not float(np.abs(whole).max()) < 2.0**63:
        raise OverflowError(f"a component times {scale} is beyond 64-bit integers")
    out = np.zeros((batch.num_rows, dim), np.int64)
    out[row[good], at[good]] = whole.astype(np.int64)
    ids = batch.column("vec_id").fill_null(0).to_numpy()
    return ids[~bad], out[~bad]


def _packed(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes that sort like the vectors."""
    return [r.tobytes() for r in (np.ascontiguousarray(x).view(np.uint64) ^ _SIGN).astype(">u8")]


def _unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    return (np.frombuffer(b"".join(rows), ">u8").astype(np.uint64) ^ _SIGN).view(np.int64).reshape(len(rows), dim)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T))


def _slack(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray | float:
    """Above any rounding of a distance between vectors whose squares are at most ``a`` and ``b``."""
    return 1e-3 + 1e-6 * (np.sqrt(a) + np.sqrt(b))


def _products(q: np.ndarray, x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats where all sums fit 53 bits, else by integers.

    Above 64 bits it's an error, save for ``own``, pairs that don't count; what lies below is held at the smallest number.
    """
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    exact = np.where(own, 0, q.astype(object) @ x.astype(object).T)
    if exact.size and exact.max() >= 1 << 63:
        raise OverflowError("an inner product is beyond 64-bit integers")
    return np.maximum(exact, _LEAST).astype(np.int64)


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        n = len(ids)
        self.own, self.k = ids, k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, rows: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Compares some queries (rows, with vectors q) with the vectors x of ``ids``."""
        own = ids == self.own[rows][:, None]  # an id may repeat, so a query may leave out several
        scores = _products(q, x, own)
        least = self.floor()[rows]
        spare = self.k + int(own.sum(1).max(initial=0))
        if scores.shape[1] > spare:
            least = np.maximum(least, np.partition(scores, -spare, axis=1)[:, -spare])
        i, j = np.nonzero((scores >= least[:, None]) & ~own)
        touched = np.unique(i)
        if not len(touched):
            return
        query = np.concatenate([i, np.repeat(touched, self.k)])
        score = np.concatenate([scores[i, j], self.score[rows[touched]].ravel()])
        ident = np.concatenate([ids[j], self.id[rows[touched]].ravel()])
        order = np.lexsort((ident, ~score, query))
        query, score, ident = query[order], score[order], ident[order]
        begin = np.concatenate([[True], query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(begin, np.arange(len(query)), 0))
        top = place < self.k
        self.score[rows[query[top]], place[top]] = score[top]
        self.id[rows[query[top]], place[top]] = ident[top]


class Rings:
    """What is known of some annuli or blocks: pivot, nearest and farthest distance to it, and largest square."""

    def __init__(self, pivots: np.ndarray, pivot: list, near: list, far: list, norm: list) -> None:
        self.points, self.pivot = pivots, np.array(pivot, np.int64)
        self.near, self.far, self.norm = (np.array(c, np.float64) for c in (near, far, norm))
        self.centre = _squares(pivots)[self.pivot]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and ring, a number that no inner product there exceeds."""
        square = _squares(q)[:, None]
        d = _distances(q, self.points)[:, self.pivot]
        gap = np.maximum(0.0, np.maximum(d - self.far, self.near - d) - _slack(square, self.centre))
        along = q.astype(np.float64) @ self.points.astype(np.float64).T
        bound = np.minimum((square + self.norm - gap * gap) / 2, along[:, self.pivot] + np.sqrt(square) * self.far)
        return np.maximum(bound + 2.0 + 1e-9 * (square + self.norm + self.centre), float(_LEAST))


def search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, blocks: list[dict], pivots: np.ndarray, k: int, step: int = 512) -> tuple[pd.DataFrame, int]:
    """Top k of each query over some blocks (pivot, near, far, norm, ids, x), and how many products that took.

    Scores below a query's floor may be left out.
    """
    out, spent = [], 0
    rings = Rings(pivots, *([b[c] for b in blocks] for c in ("pivot", "near", "far", "norm")))
    order = np.lexsort((q_ids, _distances(q, pivots).argmin(1))) if len(q) else np.empty(0, int)
    for at in range(0, len(q), step):
        mine = order[at : at + step]
        x, best = q[mine], _Best(q_ids[mine], k)
        bound = rings.bounds(x)
        for b in np.argsort(-bound.max(0), kind="stable"):
            todo = np.flatnonzero(bound[:, b] >= np.maximum(best.floor(), floor[mine]))
            if len(todo):
                best.add(todo, x[todo], blocks[b]["x"], blocks[b]["ids"])
                spent += len(todo) * len(blocks[b]["ids"])
        real = best.id != np.iinfo(np.int64).max
        if (best.score[real] == _LEAST).any():
            raise OverflowError("an inner product is beyond 64-bit integers")
        i, _ = np.nonzero(real)
        out.append(pd.DataFrame({"query_id": q_ids[mine][i], "vec_id": best.id[real], "score": best.score[real]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}), spent


def _blocks(batches: Iterator[pa.RecordBatch], points: np.ndarray, rows: int) -> Iterator[dict]:
    """Sorted rows (pivot, distance, vec_id, x) cut into blocks of one pivot and at most ``rows`` rows."""
    held: list[tuple] = []  # columns that belong to one pivot
    dim = points.shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        pivot, distance, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "distance", "vec_id"))
        x = _unpacked(batch.column("x").to_pylist(), dim)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and held[0][0] != pivot[a]:
                yield _block(held, points)
                held = []
            while a < b:
                take = min(b - a, rows - sum(len(h[2]) for h in held))
                held.append((pivot[a], distance[a : a + take], ids[a : a + take], x[a : a + take]))
                a += take
                if sum(len(h[2]) for h in held) >= rows:
                    yield _block(held, points)
                    held = []
    if held:
        yield _block(held, points)


def _block(held: list[tuple], points: np.ndarray) -> dict:
    distance, ids, x = (np.concatenate(c) for c in zip(*(h[1:] for h in held)))
    norm = float(_squares(x).max())
    slack = _slack(norm, float(_squares(points[held[0][0]][None])[0]))
    return {"pivot": int(held[0][0]), "near": float(distance[0]) - slack, "far": float(distance[-1]) + slack, "norm": norm, "ids": ids, "x": x}


def _keyed(rows: DataFrame, points: np.ndarray, dim: int, scale: float) -> DataFrame:
    """(pivot, distance, vec_id, x) of the rows that take part."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _matrix(batch, dim, scale)
            if len(ids):
                d = _distances(x, points)
                near = d.argmin(1)
                cols = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(ids)), near]), pa.array(ids), pa.array(_packed(x), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["pivot", "distance", "vec_id", "x"])

    return map_arrow(rows, key, "pivot int, distance double, vec_id long, x binary")


_INDEX = "annulus long, pivot int, near double, far double, norm double, n long, ids binary, x binary, q_ids binary, q_floor binary"


def index(spark: SparkSession, vectors: DataFrame, k: int, scale: float, every: int, stage: Staged, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, int]:
    """The staged blocks, the pivots, and the dimension.

    A block has its annulus, the pivot, the distances and largest square, its rows, and of the queries among these the
    ids and floors: a score that the k-th is sure to reach, from the block and its neighbours.  All rows are indexed but
    null vectors, those with null or non-finite components and those without an id.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    shape = rows.agg(F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n")).first()
    dim, n = max(shape.dim or 0, 1), shape.n
    sample = rows.where("embedding is not null and vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    points = np.zeros((1, dim), np.int64)
    for b in sample.combine_chunks().to_batches():
        points = np.concatenate([points, _matrix(b, dim, scale)[1]])
    points = np.unique(points, axis=0)
    keyed = stage.save(_keyed(rows, points, dim, scale), "keyed")
    parts = min(PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * dim * 8 >> 27))
    order = ["pivot", "distance", "vec_id"]
    keyed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    together = -(-n // (ANNULI * BLOCK)) or 1  # blocks of an annulus

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, size = TaskContext.get().partitionId(), -1, 0
        near: list[dict] = []  # up to three blocks in a row

        def done(b: dict) -> pa.RecordBatch:
            nonlocal number, size, last
            if size == together or b["pivot"] != last:
                number, size = number + 1, 0
            size, last = size + 1, b["pivot"]
            at = np.flatnonzero(b["ids"] % every == 0)
            best = _Best(b["ids"][at], k)
            for other in near if len(at) else []:
                if other["pivot"] == b["pivot"]:
                    best.add(np.arange(len(at)), b["x"][at], other["x"], other["ids"])
            cols = ([part << 32 | number], [b["pivot"]], [b["near"]], [b["far"]], [b["norm"]], [len(b["ids"])], [b["ids"].astype("<i8").tobytes()], [b["x"].astype("<i8").tobytes()], [b["ids"][at].astype("<i8").tobytes()], [best.floor().astype("<i8").tobytes()])
            types = (pa.int64(), pa.int32(), *[pa.float64()] * 3, pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in _INDEX.split(", ")])

        last = -1
        for block in _blocks(batches, points, BLOCK):
            near = [*near[-2:], block]
            if len(near) > 1:
                yield done(near[-2])
        if near:
            near = near[-2:]
            yield done(near[-1])

    blocks = stage.save(map_arrow(keyed, cut, _INDEX), "blocks")
    stage.drop("keyed")
    return blocks, points, dim


def _reached(spark: SparkSession, blocks: DataFrame, points: np.ndarray, dim: int) -> DataFrame:
    """(annulus, query_id, q, floor): each query with each annulus whose bound reaches the query's floor.

    Of rows that repeat a query's id the smallest vector is the query.
    """
    rings = blocks.groupBy("annulus").agg(F.first("pivot").alias("pivot"), F.min("near").alias("near"), F.max("far").alias("far"), F.max("norm").alias("norm")).toArrow()  # a bounded number of annuli
    known = spark.sparkContext.broadcast({c: rings.column(c).to_numpy() for c in rings.column_names})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, q_ids, floor in zip(*(batch.column(c).to_pylist() for c in ("ids", "x", "q_ids", "q_floor"))):
                if q_ids:
                    ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                    q = np.frombuffer(x, "<i8").reshape(-1, dim)[np.isin(ids, q_ids)]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(_packed(q), pa.binary()), pa.array(np.frombuffer(floor, "<i8"))], names=["query_id", "q", "floor"])

    queries = map_arrow(blocks.select("ids", "x", "q_ids", "q_floor"), pick, "query_id long, q binary, floor long")
    queries = queries.groupBy("query_id").agg(F.min(F.struct("q", "floor")).alias("s")).select("query_id", "s.q", "s.floor")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = known.value
        rings = Rings(points, *(r[c] for c in ("pivot", "near", "far", "norm")))
        for whole in batches:
            for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                q, floor = _unpacked(batch.column("q").to_pylist(), dim), batch.column("floor").to_numpy()
                i, j = np.nonzero(rings.bounds(q) >= floor[:, None])
                for a in range(0, len(i), 4096):
                    some = pa.array(i[a : a + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(r["annulus"][j[a : a + 4096]]), *(batch.column(c).take(some) for c in ("query_id", "q", "floor"))], names=["annulus", "query_id", "q", "floor"])

    return map_arrow(queries, reach, "annulus long, query_id long, q binary, floor long")


def _searched(spark: SparkSession, vectors: DataFrame, k: int, scale: float, every: int) -> DataFrame:
    """(query_id, vec_id, score, spent): up to k rows for each query and annulus; spent, the products that a task took,
    stands on its first row."""
    stage = Staged(spark)
    blocks, points, dim = index(spark, vectors, k, scale, every, stage)
    reached = stage.save(_reached(spark, blocks, points, dim), "reached")
    cells = stage.save(reached.groupBy("annulus").agg(F.ceil(F.count("*") / QUERY_CELL).cast("int").alias("cells")), "cells")  # a row for each annulus
    dealt = reached.join(cells, "annulus").select("annulus", F.pmod(F.xxhash64("query_id"), F.col("cells")).cast("int").alias("cell"), "query_id", "q", "floor")
    copies = cells.select("annulus", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    rows = blocks.select("annulus", "pivot", "near", "far", "norm", "ids", "x").join(copies, "annulus")
    ship(spark)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score", "spent"]
        if not len(left) or not len(right):
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names=names)
        blocks = [{**b, "ids": np.frombuffer(b["ids"], "<i8"), "x": np.frombuffer(b["x"], "<i8").reshape(-1, dim)} for b in right.select(["pivot", "near", "far", "norm", "ids", "x"]).to_pylist()]
        found, spent = search(left.column("query_id").to_numpy(), _unpacked(left.column("q").to_pylist(), dim), left.column("floor").to_numpy(), blocks, points, k)
        cols = [found[c].to_numpy().astype(np.int64) for c in names[:3]]
        return pa.Table.from_arrays([pa.array(c) for c in (*cols, np.where(np.arange(len(found)) == 0, spent, 0))], names=names)

    by = ["annulus", "cell"]
    return dealt.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(cell, "query_id long, vec_id long, score long, spent long")


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 5, scale: float = 256.0, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id is divisible by ``every``, the k best other rows.

    Ties go to the smaller vec_id.  Vectors that are null or hold null or non-finite components, and rows without an
    id, take no part.  Shorter vectors count as filled with zeros.  vec_id is a key: of rows that repeat one, the
    smallest vector is the query, none is its candidate, and each is a candidate of other queries.  A component that a
    64-bit integer can't hold is an error, as is an inner product among the k best; there are no wrong scores.  An empty table gives an empty one.
    """
    found = _searched(spark, vectors, k, scale, every)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
