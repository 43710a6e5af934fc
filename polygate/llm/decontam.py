"""Benchmark decontamination by template canonicalisation.

A text becomes words; numbers, names (capitalised inside a sentence) and units turn into typed placeholders, the rest
goes to lower case.  Windows of ``WINDOW`` canonical words are hashed.  Windows of plain lower-case words are a second key,
so that a passage in capitals is found as well.  A third takes capitalised words that open a sentence for slots too, as
they may be names.

Windows of documents and items are joined by hash; each pair of equal windows proposes an alignment of an item and a
document, which is then judged word by word.  An item is reported if windows that agree on one alignment cover at least
``min(RUN, half)`` of its words, with consistent slots: each slot value of the item stands for one value of the document.
Windows mostly of slots say too little for that: where they agree the whole item must, literals and kinds of slots, with
consistent slots.  An item of fewer than ``LEAST`` words is looked for as a whole, word for word.

At scale.  A document is read once and gives rows only for windows that a bitmap of the benchmark's windows lets through
(``FILTER_BITS`` at most, whatever the benchmark; what it lets through by chance falls out in the join); documents without any aren't
moved.  Neither items nor windows are gathered in the driver.  A window that more than ``HOT`` items share isn't joined
unless an item needs it: an item whose hot windows can't cover enough words shows up by another window or not at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polygate.llm.common import Staged, documents, doubled, map_arrow

WINDOW = 8
RUN = 13  # words on one alignment that always suffice
LEAST = 4  # items of fewer words have no templates, and only match as a whole
HOT = 64  # items that share a window which isn't joined without need
FILTER_BITS = 1 << 27
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?]+")
UNITS = frozenset("mm cm m km g kg mg t l ml s min h kmh mph hz w kw v a j n pa c f inch inches foot feet yard yards mile miles pound pounds ounce ounces gram grams kilogram kilograms meter meters metre metres kilometer kilometers liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split())
_U = np.uint64
_LITERAL, _NUMBER, _CAPITAL, _UNIT, _STOP = range(5)
_OPENS = 8  # added to the kind of a word that opens a sentence
_SLOT = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x6A09E667F3BCC909, 0], _U)
_SEEN, _TEXTS = 20, 64
_PLAIN, _TEMPLATE, _OPEN = range(3)  # kinds of keys; windows of the last two that are mostly slots need the whole item


class Words(dict):
    """Numbers words; their hashes and kinds are arrays by number."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[tuple[int, int]] = []
        self.hashes, self.kinds = np.empty(1 << 12, _U), np.empty(1 << 12, np.int8)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        first = token[0]
        kind = _STOP if first in ".!?" else _NUMBER if first.isdigit() else _UNIT if low in UNITS else _CAPITAL if first.isupper() and token[1:] == low[1:] and len(token) > 1 else _LITERAL
        n = self[token] = len(self)
        self.new.append((xxhash.xxh64_intdigest(low.encode("utf-8", "replace"), 7), kind))
        return n

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and kinds of all words so far."""
        if self.new:
            n = len(self)
            while n > len(self.hashes):
                self.hashes, self.kinds = (np.concatenate([x, np.empty_like(x)]) for x in (self.hashes, self.kinds))
            at = n - len(self.new)
            self.hashes[at:n] = np.fromiter((h for h, _ in self.new), _U, len(self.new))
            self.kinds[at:n] = np.fromiter((k for _, k in self.new), np.int8, len(self.new))
            self.new = []
        return self.hashes, self.kinds


class Canon:
    """Texts as hashes of plain words and kinds; by kind of key, hashes and which words are slots.  The texts share arrays."""

    def __init__(self, plain: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> None:
        self.plain, self.kinds, self.ends = plain, kinds, ends
        kind, opens = kinds & 7, kinds == _CAPITAL | _OPENS
        slot = kind != _LITERAL
        canon = np.where(slot, _SLOT[kind], plain)
        self.hashes = [plain, np.where(opens, plain, canon), canon]
        self.slots = [np.zeros(len(slot), bool), slot & ~opens, slot]

    @classmethod
    def of(cls, texts: list[str | None], words: Words) -> Canon:
        tokens = [_TOKEN.findall(t or "") for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        codes = np.fromiter((words[t] for some in tokens for t in some), np.int64, int(sizes.sum()))
        hashes, kinds = words.arrays()
        kind = kinds[codes]
        real = kind != _STOP
        starts = np.concatenate([[True], ~real[:-1]]) if len(kind) else np.empty(0, bool)
        ends = np.cumsum(sizes)
        starts[(ends - sizes)[sizes > 0]] = True
        return cls(hashes[codes[real]], kind[real] + _OPENS * starts[real].astype(np.int8), np.concatenate([[0], np.cumsum(real)])[ends])

    def windows(self, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """(kind of key, the key of each window of a width): keys of different widths and kinds never meet."""
        for key in (_PLAIN, _TEMPLATE, _OPEN) if width >= LEAST else (_PLAIN,):
            if not key or self.slots[key].any():
                yield key, doubled(self.hashes[key], (width,))[0] + _U(width << 2 | key)

    def telling(self, width: int, key: int) -> np.ndarray:
        """Whether each window of a kind of key says more than in the kind before, and holds a word that isn't a slot."""
        if not key:
            return np.ones(max(0, len(self.plain) - width + 1), bool)
        slots, fewer = (_sums(self.slots[k], width) for k in (key, key - 1))
        return (slots > fewer) & (slots < width)


def _sums(x: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[width:] - total[:-width]


def _cover(windows: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words some of the windows (a flag for each place) cover."""
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(windows)
    change[at] += 1
    change[at + width] -= 1  # places differ, so nothing is added twice
    return np.cumsum(change[:-1]) > 0


def needed(n: int) -> int:
    """How many of an item's words must be covered."""
    return min(RUN, -(-n // 2)) if n >= LEAST else n


def consistent(item: Canon, doc: Canon, places: np.ndarray, key: int) -> bool:
    """Whether each slot value of the item stands for one value of the document."""
    places = places[item.slots[key][places]]
    pairs = set(zip(item.plain[places].tolist(), doc.plain[places].tolist()))
    return len(pairs) == len({a for a, _ in pairs})


def judged(item: Canon, doc: Canon, there: np.ndarray) -> tuple[str, int, int] | None:
    """(kind, words covered, first word covered) of an alignment, or None.

    ``doc`` has a word for each of the item's; ``there`` tells which of these the document has at all.
    """
    n = len(item.plain)
    width, need = min(WINDOW, n), needed(n)
    plain = covered = agree = _cover(_sums((item.plain == doc.plain) & there, width) == width, width, n)
    if plain.sum() >= need:
        return "exact", int(plain.sum()), int(plain.argmax())
    for key in (_TEMPLATE, _OPEN) if n >= LEAST else ():
        same = (item.hashes[key] == doc.hashes[key]) & there
        hits = (_sums(same, width) == width) & item.telling(width, key)
        agree = agree | _cover(hits, width, n)
        covered = covered | _cover(hits & (2 * _sums(item.slots[key], width) <= width), width, n)
        if covered.sum() >= need and consistent(item, doc, np.flatnonzero((agree if key == _OPEN else covered) & ~plain), key):
            return "template", int(covered.sum()), int(covered.argmax())
        if hits.any() and same.all() and consistent(item, doc, np.arange(n), key):
            return "template", n, 0
    return None


# --- the benchmark ---------------------------------------------------------------------------------------------------


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, plain, kinds, windows) of each different item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for i in range(batch.num_rows):
                c = Canon.of([batch.column("text")[i].as_py()], words)
                n = len(c.plain)
                if not n:
                    continue
                width, found = min(WINDOW, n), []
                for key, h in c.windows(width):
                    found += [{"h": int(h[at]), "at": int(at), "key": key} for at in np.flatnonzero(c.telling(width, key))]
                window = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("key", pa.int8())]))
                found = [f | {"h": f["h"] - (f["h"] >> 63 << 64)} for f in found]
                cols = [batch.column("item").slice(i, 1), batch.column("item_id").slice(i, 1), pa.array([n], pa.int32()), pa.array([c.plain.astype("<u8").tobytes()], pa.binary()), pa.array([c.kinds.tobytes()], pa.binary()), pa.array([found], window)]
                yield pa.RecordBatch.from_arrays(cols, names=["item", "item_id", "n", "plain", "kinds", "windows"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    rows = rows.withColumn("item", F.xxhash64("item_id", "text"))
    return map_arrow(rows, run, "item long, item_id long, n int, plain binary, kinds binary, windows array<struct<h:long,at:int,key:byte>>")


def _joined(items: DataFrame, stage: Staged) -> DataFrame:
    """(h, item, at, n): the windows that are joined.  Of hot ones those of items that these could show up by alone."""
    windows = stage.save(items.select("item", "n", F.explode("windows").alias("w")).select("item", "n", "w.h", "w.at", "w.key"), "windows")
    hot = windows.groupBy("h").agg(F.count_distinct("item").alias("items")).where(F.col("items") > HOT).select("h", F.lit(True).alias("hot"))
    windows = stage.save(windows.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "marked")
    stage.drop("windows")
    width = F.least("n", F.lit(WINDOW))
    after = F.lead("at").over(Window.partitionBy("item").orderBy("at"))
    cover = windows.where("hot").select("item", "n", "at").distinct().select("item", "n", F.least(F.coalesce(after - F.col("at"), width), width).alias("words"))
    need = F.when(F.col("n") >= LEAST, F.least(F.lit(RUN), F.ceil(F.col("n") / 2))).otherwise(F.col("n"))
    enough = cover.groupBy("item", "n").agg(F.sum("words").alias("words")).where(F.col("words") >= need).select("item", F.lit(True).alias("enough"))
    only = windows.groupBy("item", "key").agg(F.min("hot").alias("only"))  # all of a kind are hot
    kept = windows.join(enough, "item", "left").join(only, ["item", "key"]).where("not hot or enough or only")
    return kept.select("h", "item", "at", "n")


def _filter(joined: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of the windows' hashes, and flags by their first bits; both of a bounded size."""
    bits = min(FILTER_BITS, 1 << max(16, (64 * joined.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen = np.zeros(bits >> 3, np.uint8), np.zeros(1 << _SEEN, bool)
        for batch in batches:
            h = batch.column("h").to_numpy().view(_U)
            seen[h >> _U(64 - _SEEN)] = True
            for at in _probes(h, bits):
                np.bitwise_or.at(mine, at >> _U(3), np.left_shift(1, at & _U(7), dtype=np.uint8, casting="unsafe"))
        yield pa.RecordBatch.from_arrays([pa.array([mine.tobytes()], pa.binary()), pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["bits", "seen"])

    bitmap, seen = np.zeros(bits >> 3, np.uint8), np.zeros(1 << _SEEN >> 3, np.uint8)
    for r in map_arrow(joined.select("h").coalesce(8), run, "bits binary, seen binary").toLocalIterator():
        bitmap |= np.frombuffer(r.bits, np.uint8)
        seen |= np.frombuffer(r.seen, np.uint8)
    return bitmap, np.unpackbits(seen).astype(bool)


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for shift in (0, 22, 37):
        yield (h >> _U(shift)) * _U(0x9E3779B97F4A7C15) >> _U(64 - bits.bit_length() + 1)


# --- documents -------------------------------------------------------------------------------------------------------


def _proposals(docs: DataFrame, widths: list[int], bitmap, bits: int) -> DataFrame:
    """(row, doc_id, plain, kinds, hits) of the documents that have windows which the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (mine, seen), words, row = bitmap.value, Words(), TaskContext.get().partitionId() << 40
        for whole in batches:
            out: list[tuple] = []
            for part in (whole.slice(a, _TEXTS) for a in range(0, whole.num_rows, _TEXTS)):
                if len(words) > 400_000:
                    words = Words()
                c = Canon.of(part.column("text").to_pylist(), words)
                hashes, places = [np.empty(0, _U)], [np.empty(0, np.int64)]
                for width in widths:
                    for _, h in c.windows(width):
                        at = np.flatnonzero(seen[h >> _U(64 - _SEEN)])
                        if len(at):
                            keep = np.ones(len(at), bool)
                            for probe in _probes(h[at], bits):
                                keep &= mine[probe >> _U(3)] >> (probe & _U(7)).astype(np.uint8) & 1 > 0
                            at = at[keep]
                            at = at[at + width <= c.ends[np.searchsorted(c.ends, at, "right")]]  # not into the next text
                        hashes.append(h[at])
                        places.append(at)
                h, at = np.concatenate(hashes), np.concatenate(places)
                text = np.searchsorted(c.ends, at, "right")
                for i in np.unique(text).tolist():
                    a, b = (int(c.ends[i - 1]) if i else 0), int(c.ends[i])
                    some = text == i
                    out.append((row, part.column("doc_id")[i].as_py(), c.plain[a:b].astype("<u8").tobytes(), c.kinds[a:b].tobytes(), h[some].view(np.int64).tolist(), (at[some] - a).tolist()))
                    row += 1
            if out:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["row", "doc_id", "plain", "kinds", "h", "place"])

    return map_arrow(documents(docs), run, "row long, doc_id long, plain binary, kinds binary, h array<long>, place array<int>")


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
    keep, found = [], []
    for i, shift in enumerate(cols["shift"]):
        item = Canon(np.frombuffer(cols["plain"][i], "<u8").astype(_U), np.frombuffer(cols["kinds"][i], np.int8), np.empty(0))
        n, begin, end = len(item.plain), max(0, -shift), max(0, -shift) + len(cols["doc_kinds"][i])
        plain, kinds = np.zeros(n, _U), np.zeros(n, np.int8)
        plain[begin:end], kinds[begin:end] = np.frombuffer(cols["doc_plain"][i], "<u8"), np.frombuffer(cols["doc_kinds"][i], np.int8)
        there = np.zeros(n, bool)
        there[begin:end] = True
        if said := judged(item, Canon(plain, kinds, np.empty(0)), there):
            keep.append(i)
            found.append((*said[:2], said[2] + shift))
    some = pa.array(keep, pa.int64())
    own = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int32(), pa.int32()))] if found else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.int32())]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("row", "doc_id", "item", "item_id", "n")), *own], names=["row", "doc_id", "item", "item_id", "n", "kind", "covered", "first_word"])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, kind, n_words, covered, first_word): each benchmark item that a row of ``docs`` holds.

    kind is ``exact``, or ``template`` where only numbers, names or units differ, consistently.  Documents without an item
    have no row; null and empty texts match nothing, nor do items without an id or words; items of fewer than four words
    match only as a whole, word for word; an item_id that repeats is looked for with each of its texts, equal ones once.
    Each row of ``docs`` counts for itself, so rows that repeat are each reported, as are null doc_ids.  Of several places
    in a document the one that covers most is told, the first of equals.  Very long texts are taken whole.  An empty table
    on either side gives an empty one.
    """
    stage = Staged(spark)
    items = stage.save(_items(benchmark), "items")
    joined = stage.save(_joined(items, stage), "joined")
    stage.drop("marked")
    widths = sorted(r.w for r in items.select(F.least("n", F.lit(WINDOW)).alias("w")).distinct().collect())  # numbers from 1 to WINDOW
    bitmap, seen = _filter(joined)
    sent = spark.sparkContext.broadcast((bitmap, seen))
    texts = stage.save(_proposals(docs, widths, sent, len(bitmap) << 3), "texts")
    hits = texts.select("row", F.explode(F.arrays_zip("h", "place")).alias("w")).select("row", "w.h", "w.place")
    pairs = hits.join(joined, "h").select("row", "item", "n", (F.col("place") - F.col("at")).alias("shift")).distinct()
    begin = F.greatest("shift", F.lit(0))
    size = F.greatest(F.col("n") + F.col("shift") - begin, F.lit(0))  # what lies before the document's start is left out
    words = texts.select("row", "doc_id", F.col("plain").alias("doc_plain"), F.col("kinds").alias("doc_kinds"))
    pairs = pairs.join(words, "row").select("row", "doc_id", "item", "shift", F.substring("doc_plain", 8 * begin + 1, 8 * size).alias("doc_plain"), F.substring("doc_kinds", begin + 1, size).alias("doc_kinds"))
    pairs = pairs.join(items.select("item", "item_id", "n", "plain", "kinds"), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_verified(b) for b in batches if b.num_rows)

    found = map_arrow(pairs, run, "row long, doc_id long, item long, item_id long, n int, kind string, covered int, first_word int")
    best = F.max(F.struct("covered", (-F.col("first_word")).alias("back"), "kind")).alias("best")
    rows = found.groupBy("row", "doc_id", "item", "item_id", "n").agg(best)
    return rows.select("doc_id", "item_id", "best.kind", F.col("n").alias("n_words"), "best.covered", (-F.col("best.back")).alias("first_word"))
