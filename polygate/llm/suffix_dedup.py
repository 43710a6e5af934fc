"""Removal of repeated byte strings by distributed prefix doubling.

The rank of a string of 2h bytes is made from the pair of ranks at a position and h bytes further on: from single bytes
on, offsets double (1, 2, 4, ... 32), and a last pair that overlaps reaches any length, as 64 bytes at offsets 0 and 36
reach 100.  A rank is a 64-bit name of its content, equal wherever the string stands, so the second rank of a pair is at
hand where the first is: no round joins neighbours back in.  What needs the cluster is which ranks are unique.  Each
round sorts (rank, content, document, position) rows by Spark, drops positions whose rank is unique, and reranks the
others at a greater length until that reaches the threshold L (100 bytes).

Ranks of a few bytes are hardly ever unique, and rows for every byte would move some thirty bytes for each byte of text
and round.  So sorting begins at L/4 bytes, over a synchronising set of positions, as in sparse suffix sorting: of each
window of L bytes the place with the smallest rank of L/4 bytes is marked, about one byte in 38.  Equal windows mark the
same place, so whatever repeats over L bytes holds an equally ranked pair.  Windows in a row with the same mark form a
*run*.

* Round 1 sorts the marks' ranks at L/4 bytes.  A unique rank drops out: none of its run's windows repeats.  Where ranks
  tie, the run's content is compared, the pair of ranks of its first and last window: of equal runs all but the first are
  repeats in full.
* Round 2 reranks what still ties, in pieces of L/10 windows, at the 9 L/10 bytes that a piece's windows share.
* Round 3 reranks the rest window by window, at L bytes: the threshold.

Before the shuffle a task keeps the first of its equal rows, so a passage that many documents share has at most a row for
each task; a rank that ties very often within a task is passed on to the next round without the sort, and one row tells
the others of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polygate.llm.common import Staged, doubled, map_arrow, pair

#: Bytes of text for each partition of a sort, and partitions at most: beyond, a sort spills.
PART_BYTES, MOST_PARTS = 64 << 20, 50_000
_BITS = 20
_CHUNK = 1 << _BITS  # bytes of a document that are hashed at a time
_FLUSH = 400_000  # rows that a task holds before it passes them on
_SLICE = 1 << 15  # rows that it passes on at once
_OFTEN = 256  # different contents of a rank in one flush
_U = np.uint64
_FOUND, _TIED, _RANKED, _OFTEN_TIED = 1, 2, 0, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Names of single bytes in two families of ranks, independent of one another.
_BYTES = [np.random.default_rng(20240607 + i).integers(0, 1 << 64, 256, dtype=_U) for i in range(2)]


def ranks(data: np.ndarray, lengths: tuple[int, ...], family: int = 0) -> list[np.ndarray]:
    """For each of the lengths, which ascend, the ranks of all strings of that length."""
    return doubled(_BYTES[family][data], lengths, family)


def _content(rank: np.ndarray, first: np.ndarray, last: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The rank of what windows first..last cover, from the pair of its ends, and of where the mark stands in it."""
    return pair(rank[first], rank[last]) ^ _mix((mark - first).astype(_U) << _U(20) | (last - first).astype(_U))


def marks(order: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` hashes, the position of the smallest (in its upper bits), the leftmost of equals."""
    low = _U((1 << (_BITS + 1)) - 1)
    least = (order & ~low) | np.arange(len(order), dtype=_U)
    span = 1
    while span < w:
        step = min(span, w - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return (least & low).astype(np.int64)


def _parts(n: int, length: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the bytes to hash, so that each window of ``length`` bytes lies in exactly one of them."""
    for a in range(0, n - length + 1, _CHUNK):
        yield a, min(a + _CHUNK, n - length + 1) + length - 1


#: key, full, first, last, mark of some rows
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs(data: np.ndarray, length: int, spans: np.ndarray | None) -> Iterator[Rows]:
    """Round 1: the runs of a document.  A run is cut where a chunk ends; it then ties and later rounds settle it."""
    k = length // 4
    for a, b in _parts(len(data), length):
        order, whole = ranks(data[a:b], (k, length))
        at = marks(order, length - k + 1)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.append(first[1:], len(at)) - 1
        mark = at[first]
        yield order[mark], _content(whole, first, last, mark), first + a, last + a, mark + a


def _within(data: np.ndarray, length: int, spans: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(begin, bytes, spans) of the stretches of a document that hold unresolved spans (first, last, mark)."""
    at = 0
    while at < len(spans):
        a, to = int(spans[at, 0]), at + 1
        while to < len(spans) and spans[to, 0] - a < _CHUNK - length:
            to += 1
        mine = spans[at:to]
        yield a, data[a : int(mine[:, 1].max()) + length], mine
        at = to


def pieces(data: np.ndarray, length: int, spans: np.ndarray) -> Iterator[Rows]:
    """Round 2: unresolved runs in pieces whose windows stand alike to the mark."""
    c = max(1, length // 10)
    for a, part, mine in _within(data, length, spans):
        shared, whole = ranks(part, (length - c + 1, length))
        first, last, mark = (mine - a).T
        lo, hi = (mark - last) // c, (mark - first) // c  # classes of mark - window
        n = hi - lo + 1
        run = np.repeat(np.arange(len(mine)), n)
        j = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + lo[run]
        nearest, farthest = mark[run] - j * c, mark[run] - (j + 1) * c + 1  # windows of the whole class
        f, e = np.maximum(farthest, first[run]), np.minimum(nearest, last[run])
        yield shared[nearest] ^ _mix(j.astype(_U)), _content(whole, f, e, mark[run]), f + a, e + a, mark[run] + a


def windows(data: np.ndarray, length: int, spans: np.ndarray) -> Iterator[Rows]:
    """Round 3: unresolved pieces window by window, ranked by 128 bits."""
    for a, part, mine in _within(data, length, spans):
        n = mine[:, 1] - mine[:, 0] + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(mine[:, 0], n) - a
        yield ranks(part, (length,))[0][at], ranks(part, (length,), 1)[0][at], at + a, at + a, at + a


ROUNDS = (runs, pieces, windows)
_ROW = "kind byte, key long, full long, doc long, first int, last int, mark int"
_NAMES = ["kind", "key", "full", "doc", "first", "last", "mark"]


def _batch(kind, key, full, doc, first, last, mark) -> pa.RecordBatch:
    ints = [np.asarray(x, np.int32) for x in (first, last, mark)]
    cols = [np.asarray(kind, np.int8), key.view(np.int64), full.view(np.int64), doc, *ints]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_NAMES)


def _sorted_flags(key: np.ndarray, full: np.ndarray, doc: np.ndarray, first: np.ndarray, order: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """The order by key, full, document and position (if it isn't given), and where keys and contents begin."""
    o = np.lexsort((first, doc, full, key)) if order else None
    if o is not None:
        key, full = key[o], full[o]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    return o, new_key, new_key | np.concatenate([[True], full[1:] != full[:-1]])


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts that take little memory on the other side."""
    for at in range(0, batch.num_rows, _SLICE):
        yield batch.slice(at, _SLICE)


def _flush(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a task passes on: the first of equal rows; others are found; ranks that tie very often are passed by."""
    key, full, doc, first, last, mark = rows
    o, new_key, new_full = _sorted_flags(key, full, doc, first, True)
    key, full, doc, first, last, mark = (x[o] for x in rows)
    group = np.cumsum(new_key) - 1
    often = np.bincount(group, weights=new_full)[group] > _OFTEN
    kind = np.where(~new_full, _FOUND, np.where(often, _TIED, _RANKED))
    tell = np.flatnonzero(often & new_key)
    # rows that are settled, or wait for the next round, go anywhere
    away = kind != _RANKED
    spread = _mix(doc[away].view(_U) * _U(0x9E3779B97F4A7C15) + first[away].astype(_U))
    told = [x[tell] for x in (key, full, doc, first, last, mark)]
    key[away] = spread
    cols = [np.concatenate([a, b]) for a, b in zip((kind, key, full, doc, first, last, mark), (np.full(len(tell), _OFTEN_TIED), *told), strict=True)]
    yield from _sliced(_batch(*cols))


def _emit(round_: Callable[..., Iterator[Rows]], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            spans = batch.column("spans") if "spans" in batch.schema.names else None
            for i, (doc, text) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True)):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
                mine = None
                if spans is not None:
                    s = spans[i].values
                    mine = np.stack([s.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last", "mark")], axis=1)
                    mine = mine[np.lexsort((mine[:, 1], mine[:, 0]))]
                for key, full, first, last, mark in round_(data, length, mine):
                    held.append((key, full, np.full(len(key), doc), first.astype(np.int32), last.astype(np.int32), mark.astype(np.int32)))
                    size += len(key)
                if size > _FLUSH:
                    yield from _flush([np.concatenate(x) for x in zip(*held, strict=True)])
                    held, size = [], 0
        if size:
            yield from _flush([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _resolve(final: bool):
    """Sorted rows to found and tied ones; a rank whose rows all are unique is dropped."""

    def settle(kind, key, full, doc, first, last, mark) -> Iterator[pa.RecordBatch]:
        passed = (kind == _FOUND) | (kind == _TIED)
        state = kind.copy()
        real = np.flatnonzero(~passed)
        if len(real):
            k, f, row = key[real], full[real], kind[real] == _RANKED
            _, new_key, _ = _sorted_flags(k, f, doc, first, False)
            group = np.cumsum(new_key) - 1
            # the first row of each content; rows that only tell of a tie don't count
            ranked = np.flatnonzero(row)
            kr, fr = k[ranked], f[ranked]
            begins = np.ones(len(ranked), bool)
            begins[1:] = (kr[1:] != kr[:-1]) | (fr[1:] != fr[:-1])
            different = np.bincount(group[ranked], weights=begins, minlength=group[-1] + 1)
            told = np.bincount(group, weights=~row, minlength=group[-1] + 1) > 0
            tied = (different > 1) | told
            out = np.zeros(len(real), np.int64)
            out[ranked] = np.where(~begins, _FOUND, np.where(tied[group[ranked]] & (not final), _TIED, 0))
            state[real] = out
        keep = state > 0
        if keep.any():
            yield from _sliced(pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (state.astype(np.int8), doc, first, last, mark)], names=["state", "doc", "first", "last", "mark"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in _NAMES]
            key = cols[1]
            cut = int(np.searchsorted(key, key[-1]))
            if held and cut == 0 and held[0][1][0] == key[0]:
                held.append(cols)
                continue
            both = [np.concatenate([*(h[i] for h in held), c]) for i, c in enumerate(cols)] if held else cols
            cut += sum(len(h[0]) for h in held)
            if cut:
                yield from settle(*(c[:cut] for c in both))
            held = [[c[cut:] for c in both]]
        if held:
            yield from settle(*(np.concatenate([h[i] for h in held]) for i in range(len(_NAMES))))

    return run


def covered(n: int, spans: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal [begin, end) byte ranges that windows first..last (sorted) of ``length`` bytes cover."""
    out: list[list[int]] = []
    for a, b in spans.tolist():
        e = min(b + length, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, b) for a, b in out]


def _cut(length: int, keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, found in zip(*(batch.column(c) for c in ("doc_id", "text", "spans")), strict=True):
                data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                cuts: list[tuple[int, int]] = []
                if found.is_valid:
                    s = found.values
                    s = np.stack([s.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last")], axis=1)
                    cuts = covered(len(data), s[np.lexsort((s[:, 1], s[:, 0]))], length)
                at, digest, kept = 0, hashlib.sha256(), []
                for a, b in [*cuts, (len(data), len(data))]:
                    digest.update(data[at:a])
                    if keep_bytes:
                        kept.append(bytes(data[at:a]))
                    at = b
                row = (doc.as_py(), len(data), sum(b - a for a, b in cuts), len(cuts), digest.hexdigest(), b"".join(kept) if keep_bytes else None)
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _numbered(docs: DataFrame, stage: Staged) -> DataFrame:
    """(doc, doc_id, text): doc orders the rows; it is doc_id unless ids are null or repeat."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage.save(rows.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "numbered")


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 100, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs`` (doc_id, text).

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a row of smaller doc_id
    (null ids come first; rows that repeat an id are ordered by their text's hash, equal ones in any order), or further
    left in the same row.  Strings never cross documents and are judged on the input.  A null text counts as empty.
    ``kept`` (null without ``keep_bytes``) is bytes, as a cut may split a character.  An empty table gives an empty
    one.
    """
    if not 8 <= length <= 1 << 16:
        raise ValueError("length must be 8 to 65536")
    stage = Staged(spark)
    rows = _numbered(docs, stage)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, total // PART_BYTES))
    long_enough = rows.where(F.octet_length("text") >= length).select("doc", "text")
    todo, found = long_enough, None
    for n, round_ in enumerate(ROUNDS):
        ranked = map_arrow(todo, _emit(round_, length), _ROW).repartition(parts, "key").sortWithinPartitions("key", "full", "doc", "first")
        settled = stage.save(map_arrow(ranked, _resolve(round_ is windows), "state byte, doc long, first int, last int, mark int"), f"round{n}")
        more = settled.where(F.col("state") == _FOUND).select("doc", "first", "last")
        found = more if found is None else found.unionByName(more)
        if round_ is not windows:
            tied = settled.where(F.col("state") == _TIED).groupBy("doc").agg(F.collect_list(F.struct("first", "last", "mark")).alias("spans"))
            todo = long_enough.join(tied, "doc").select("doc", "text", "spans")
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    out = rows.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return map_arrow(out, _cut(length, keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
