"""SimHash near-dedup by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits differ in at most that many of their 8 bytes, so they
share at least ``8 - max_bits`` positional bytes: the guaranteed minimum.  The index posts each fingerprint under every
choice of that many positions with the bytes there (for 4 bits: 70 postings of 32 bits), so a posting list holds only
fingerprints that already have the minimum in common; single-byte lists would hold a 256th of all rows each.  Within a
list the tally of equal positional bytes is taken from the XOR, a pair is judged only in the list of its first shared
positions, and the bits are verified.

Memory and skew: equal fingerprints collapse first (partial minimum before the shuffle), lists stream through sorted
partitions, a list of at most 64 emits its verified links, a longer one emits a spanning forest only, found row by row
or, beyond 20,000, over the midpoints two bits away.  Nothing is capped.

A few bits of one sum over all shingles tell only copies with few edits: at a Jaccard similarity of 0.8, 64-bit
fingerprints differ in about 10 bits, where no byte is sure to be shared, so this method can't find such pairs.  With
``similarity`` candidates therefore come from another one as well, MinHash: shingles fall into 256 classes by hash, and a
text keeps the smallest hash of each class.  Lists are keyed by bands of six classes; a byte for each class makes the
sketch, whose equal positions estimate the similarity (standard error 0.025 at 0.8).  Three rules make a link:

* two texts are candidates if they share a band, if their fingerprints are equal, or by a link of the fingerprint index;
* a candidate from a band is dropped if its sketch is more than 4.5 standard errors below the similarity;
* of those that are left the whole shingle sets are compared, so what is linked has the similarity exactly.

The rules are the same for groups of any size.  Links of texts that are tied already aren't looked for, as only
components are wanted.  Texts collapse by a hash of the whole shingle set, never by fingerprint: one line that repeats
often gives texts with little else in common equal fingerprints, which therefore only propose pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polygate.llm.common import Staged, documents, map_arrow, map_batches, placed
from polygate.llm.components import components

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_CHUNK, _SMALL, _LARGE = 1 << 16, 64, 20_000
_GROUP = 500  # texts of a loose group that one task takes as a whole; larger ones go by their lists, with the same candidates


def _bit_counts(digests: list[bytes]) -> np.ndarray:
    """How many of the 8-byte digests have each of the 64 bits, highest first."""
    n = len(digests)
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(n, 8), axis=1)
    whole, out = n // 255 * 255, np.zeros(64, np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    if whole < n:
        out += bits[whole:].sum(0, dtype=np.uint8)
    return out


def _shingles(text: str | None, shingle: int) -> Iterator[list[bytes]]:
    """The XXH64 digests of a text's word shingles, in chunks."""
    buf = b" ".join((text or "").encode("utf-8", "replace").translate(_LOWER).split())
    if not buf:
        return
    gaps = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    digest = xxhash.xxh64_digest
    if len(gaps) < shingle:
        yield [digest(buf, 42)]
        return
    starts = np.concatenate([[0], gaps[: len(gaps) - shingle + 1] + 1])
    ends = np.concatenate([gaps[shingle - 1 :], [len(buf)]])
    for i in range(0, len(starts), _CHUNK):
        yield [digest(buf[a:b], 42) for a, b in zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist())]


def fingerprint(text: str | None, shingle: int = 4, also: Sketch | list[bytes] | None = None) -> int:
    """The SimHash of a text's word shingles, as an unsigned integer; 0 without words.

    ``also`` gets the digests of the shingles: a sketch, or a list that keeps them.
    """
    total, n = np.zeros(64, np.int64), 0
    for digests in _shingles(text, shingle):
        total += _bit_counts(digests)
        n += len(digests)
        if isinstance(also, list):
            also += digests
        elif also is not None:
            also.add(digests)
    if not n:
        return 0
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


class Sketch:
    """The positional bytes of one text: for each class of shingles a byte of the smallest hash, 0 for an empty class."""

    CLASSES, WIDTH, BANDS = 256, 6, 42

    def __init__(self) -> None:
        self.least = np.full(self.CLASSES, np.iinfo(np.uint64).max, np.uint64)

    def add(self, digests: list[bytes]) -> None:
        h = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h.sort()
        at = np.searchsorted(h, np.arange(self.CLASSES, dtype=np.uint64) << np.uint64(56))
        found = at < len(h)
        first = h[np.minimum(at, len(h) - 1)]
        found &= (first >> np.uint64(56)).astype(np.int64) == np.arange(self.CLASSES)
        self.least[found] = np.minimum(self.least[found], first[found])

    def bytes(self) -> np.ndarray:
        full = self.least != np.iinfo(np.uint64).max
        return np.where(full, (self.least >> np.uint64(20)) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)

    def keys(self) -> np.ndarray:
        """A key for each band of positions; an empty class borrows from the next full one."""
        value = (self.least >> np.uint64(8)).astype(np.uint64)
        full = np.flatnonzero(self.least != np.iinfo(np.uint64).max)
        if not len(full):
            return np.empty(0, np.int64)
        place = np.searchsorted(full, np.arange(self.CLASSES)) % len(full)
        away = (full[place] - np.arange(self.CLASSES)) % self.CLASSES
        value = value[full[place]] + away.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out = np.zeros(self.BANDS, np.uint64)
        for i in range(self.WIDTH):
            out = (out ^ value[i : self.WIDTH * self.BANDS : self.WIDTH]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def _set_of(digests: list[bytes]) -> np.ndarray:
    """The hashes of a text's shingles, sorted and without repeats."""
    return np.unique(np.frombuffer(b"".join(digests), np.uint64))


def _node(found: np.ndarray) -> int:
    """A signed 64-bit hash of a whole shingle set."""
    n = xxhash.xxh3_64_intdigest(found.tobytes(), 42)
    return n - (1 << 64) if n >> 63 else n


def fingerprints(docs: DataFrame, shingle: int = 4, sketches: bool = False) -> DataFrame:
    """(doc_id, fp[, at, node, sketch, keys]) with fp the signed 64-bit view of the fingerprint; one row for each row of ``docs``.

    node is the hash of the shingle set; the first key of a text with words is its fingerprint, the others are the sketch's.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column("doc_id")]
        fps, nodes, made, keys = np.empty(batch.num_rows, np.uint64), [], [], []
        for i, text in enumerate(batch.column("text")):
            seen: list[bytes] | None = [] if sketches else None
            fps[i] = fingerprint(text.as_py(), shingle, seen)
            if sketches:
                nodes.append(_node(_set_of(seen)))
                sketch = Sketch()
                for a in range(0, len(seen), _CHUNK):
                    sketch.add(seen[a : a + _CHUNK])
                made.append(sketch.bytes().tobytes())
                keys.append(np.concatenate([fps[i : i + 1].view(np.int64), sketch.keys()]) if seen else sketch.keys())
        cols.append(pa.array(fps.view(np.int64)))
        if sketches:
            cols += [batch.column("at"), pa.array(nodes, pa.int64()), pa.array(made, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "at", "node", "sketch", "keys"][: len(cols)])

    return map_batches(placed(docs) if sketches else documents(docs), run, "doc_id long, fp long" + ", at long, node long, sketch binary, keys array<long>" * sketches)


def _masks(minimum: int) -> list[int]:
    """For each choice of ``minimum`` of the 8 byte positions, the mask of those bytes."""
    return [sum(0xFF << (8 * p) for p in c) for c in itertools.combinations(range(8), minimum)]


def _star(fp: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row to the row that stands for its label: the flattest links, so that components take few rounds."""
    some = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[some]], fp[some]


class _Lists:
    """Finds the links of posting lists that arrive sorted by position choice and bytes."""

    def __init__(self, max_bits: int) -> None:
        self.bits, self.minimum = max_bits, 8 - max_bits
        masks = _masks(self.minimum)
        self.masks = np.array(masks, np.uint64)
        choice = {c: k for k, c in enumerate(itertools.combinations(range(8), self.minimum))}
        shared = [tuple(p for p in range(8) if m >> p & 1) for m in range(256)]
        #: By the set of equal positional bytes: the list in which the pair is judged, -1 if the tally is too small.
        self.first = np.array([choice[s[: self.minimum]] if len(s) >= self.minimum else -1 for s in shared])

    def _judge(self, k: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a ^ b
        same = (x.view(np.uint8).reshape(-1, 8) == 0) @ (1 << np.arange(8))
        return (self.first[same] == k) & (np.bitwise_count(x) <= self.bits)

    def links(self, k: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole lists: k is the position choice, fp the fingerprint, rows sorted by list."""
        if not len(fp):
            return fp, fp
        key = fp & self.masks[k]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (k[1:] != k[:-1])])
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        some = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= _SMALL))
        left, right = [], []
        for d in range(1, _SMALL):
            i = some[some + d < len(fp)]
            i = some = i[group[i + d] == group[i]]
            if not len(i):
                break
            i = i[self._judge(k[i], fp[i], fp[i + d])]
            left.append(fp[i])
            right.append(fp[i + d])
        for g in np.flatnonzero(sizes > _SMALL):
            a, b = self.forest(fp[starts[g] : starts[g] + sizes[g]], int(self.masks[k[starts[g]]]))
            left.append(a)
            right.append(b)
        return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])

    def forest(self, fp: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what pairs within the bound connect, one at most for each row."""
        fp = np.unique(fp)
        if len(fp) > _LARGE and self.bits % 2 == 0:
            return self._midpoints(fp, mask)
        label = np.arange(len(fp))
        for i in range(1, len(fp)):
            near = np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= self.bits)
            if len(near):
                labels = np.unique(label[near])
                label[i] = labels[0]
                for x in labels[1:]:
                    label[:i][label[:i] == x] = labels[0]
        return _star(fp, label)

    def _midpoints(self, fp: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints are within 2r bits just if some value is within r bits of both."""
        free = [b for b in range(64) if not mask >> b & 1]
        flips = np.array([sum(1 << b for b in c) for r in range(self.bits // 2 + 1) for c in itertools.combinations(free, r)], np.uint64)
        parts, pairs = -(-len(fp) * len(flips) // 10_000_000), []
        for part in range(parts):
            owner, point = [], []
            for f in flips:
                p = fp ^ f
                keep = np.flatnonzero((p * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part)
                owner.append(keep)
                point.append(p[keep])
            own, at = np.concatenate(owner), np.concatenate(point)
            order = np.lexsort((own, at))
            own, at = own[order], at[order]
            same = np.flatnonzero(at[1:] == at[:-1])
            pairs.append(np.unique(own[same].astype(np.int64) << 32 | own[same + 1]))
        pairs = np.unique(np.concatenate(pairs))
        return fp[pairs >> 32], fp[pairs & 0xFFFFFFFF]


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links between different fingerprints, enough to give all components.  ``distinct`` has fp, without repeats."""
    if not 1 <= max_bits <= 7:
        raise ValueError("max_bits must be 1 to 7, else no positional byte is sure to be shared")
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(8 - max_bits)]
    posted = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("k", "bytes"))
    posted = posted.repartition(F.col("k"), F.col("bytes")).sortWithinPartitions("k", "bytes", "fp").select(F.col("k").cast("byte"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(max_bits)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the list that may go on in the next batch

        def out(k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = lists.links(k, fp)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            key = fp & lists.masks[k]
            cut = int(np.flatnonzero((key == key[-1]) & (k == k[-1]))[0])  # sorted: the last list begins here
            if held:
                k0, fp0 = held[0][0][0], held[0][1][0]
                if cut == 0 and k[0] == k0 and key[0] == fp0 & lists.masks[k0]:
                    held.append((k, fp))
                    continue
                k = np.concatenate([*(x[0] for x in held), k])
                fp = np.concatenate([*(x[1] for x in held), fp])
                cut += sum(len(x[0]) for x in held)
            yield from out(k[:cut], fp[:cut])
            held = [(k[cut:], fp[cut:])]
        if held:
            yield from out(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

    return map_arrow(posted, run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], names: Sequence[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with equal values of ``by``, from sorted batches; runs of one row are left out."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*by, *names)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for key in cols[: len(by)]:
            new[1:] |= key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        ends = np.append(begin[1:], batch.num_rows)
        for a, b in zip(begin.tolist(), ends.tolist()):
            part = [c[a:b] for c in cols]
            if held and any(held[0][k][0] != part[k][0] for k in range(len(by))):
                if sum(len(h[0]) for h in held) > 1:
                    yield [np.concatenate(x) for x in zip(*held)]
                held = []
            held.append(part)
    if held and sum(len(h[0]) for h in held) > 1:
        yield [np.concatenate(x) for x in zip(*held)]


def _forest(fp: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], holds: Callable[[int, int], bool] | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs that hold connect; near(i, some) gives those of the rows that row i may be tied to, best first.

    Rows that are tied already aren't compared, so a list of copies takes time in proportion to its rows.
    """
    label = np.arange(len(fp))
    for i in range(1, len(fp)):
        first = np.unique([i - 1, 0, label[i - 1]])
        for some in (first, None):
            if some is None:
                some = np.flatnonzero(label[:i] != label[i])
            for j in near(i, some).tolist() if len(some) else ():
                if label[j] != label[i] and (holds is None or holds(i, j)):
                    new, old = sorted((label[i], label[j]))
                    label[: i + 1][label[: i + 1] == old] = new
    return _star(fp, label)


def _similar(fp: np.ndarray, x: np.ndarray, least: float, sets: list[np.ndarray] | None = None, similarity: float = 0.0, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the texts of one list whose sketches agree often enough.

    With sets (hashes of all shingles, sorted) a pair must also have the similarity, exactly; with keys it must share one.
    """
    full = x > 0

    def near(i: int, some: np.ndarray) -> np.ndarray:
        if keys is not None:
            some = some[(keys[some] == keys[i]).any(1)]
        both = ((x[some] == x[i]) & full[i]).sum(1)
        close = both + 1 >= least * (full[some] | full[i]).sum(1)  # one more, as few shingles may share a class
        return some[close][np.argsort(-both[close], kind="stable")]

    return _forest(fp, near, None if sets is None else lambda i, j: _jaccard(sets[i], sets[j]) >= similarity)


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _judged(lists: DataFrame, by: list[str], least: float, similarity: float) -> DataFrame:
    """(a, b): links within each list of rows (``by``, node, sketch[, set][, keys])."""
    cols = [F.col(c) for c in by]
    names = ["node", "sketch", *(c for c in ("set", "keys") if c in lists.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, by, names):
            of = dict(zip(names, group[len(by) :]))
            x = np.frombuffer(b"".join(of["sketch"]), np.uint8).reshape(len(of["node"]), -1)
            sets = [np.frombuffer(s, np.uint64) for s in of["set"]] if "set" in of else None
            keys = None
            if "keys" in of:  # a text without words has none: it shares none
                keys = np.zeros((len(x), max(map(len, of["keys"]))), np.int64)
                for row, k in zip(keys, of["keys"]):
                    row[: len(k)] = k
            a, b = _similar(of["node"], x, least, sets, similarity, keys)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = lists.select(*by, *names).repartition(*cols).sortWithinPartitions(*cols, "node")
    return map_arrow(rows, run, "a long, b long")


def _posted(classes: DataFrame) -> DataFrame:
    """(band, key, node) of each list that has more than one node."""
    by = [F.col("band"), F.col("key")]
    posted = classes.select("node", F.posexplode("keys").alias("band", "key")).repartition(*by).sortWithinPartitions(*by, "node")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in _groups(batches, ["band", "key"], ("node",)):
            held.append(group)
            size += len(group[0])
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["band", "key", "node"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["band", "key", "node"])

    return map_arrow(posted, shared, "band int, key long, node long")


def _sets(members: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``members`` (node, at, ...) with the sorted hashes of all shingles of the node's text."""
    rows = placed(docs).join(members.select("node", "at"), "at").select("node", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        nodes, out = [], []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
            found = _set_of([d for some in _shingles(text.as_py(), shingle) for d in some])
            if _node(found) == node:
                nodes.append(node)
                out.append(found.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], names=["node", "set"])

    found = map_batches(rows, run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))  # rows may repeat
    return members.drop("at").join(found, "node")


def _proposed(classes: DataFrame, close: DataFrame) -> DataFrame:
    """(a, b): the links between fingerprints in ``close`` as links between nodes, all nodes of such a fingerprint tied."""
    ends = close.select(F.col("a").alias("fp")).union(close.select("b")).distinct()
    mine = classes.select("fp", "node").join(ends, "fp")
    first = mine.groupBy("fp").agg(F.min("node").alias("first"))
    ties = mine.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    left, right = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in "ab")
    pairs = close.distinct().join(left, "a").join(right, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return pairs.unionByName(ties)


def similar_links(spark: SparkSession, docs: DataFrame, classes: DataFrame, close: DataFrame, shingle: int, similarity: float, stage: Staged) -> DataFrame:
    """(a, b): links between nodes of texts whose shingles have the Jaccard similarity or more.

    Sketches and ``close`` (links between fingerprints) pick loose groups first, and only texts of these are compared.  A
    group of up to ``_GROUP`` texts is one task's, where a text and its shingle set are once; a larger one goes by its lists,
    so no task gets all of it.  Both judge the pairs that share a key.
    """
    least = similarity - 4.5 * (similarity * (1 - similarity) / Sketch.CLASSES) ** 0.5
    posted = stage.save(_posted(classes), "posted")
    lists = posted.join(classes.select("node", "sketch"), "node")
    proposed = stage.save(_proposed(classes, close), "proposed")
    loose = stage.save(proposed.unionByName(_judged(lists, ["band", "key"], least, 0.0)), "loose")
    groups = stage.save(components(spark, loose), "groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = classes.join(groups, "node").join(sizes, "root").select("root", "n", "node", "at", "sketch", "keys")
    members = stage.save(_sets(stage.save(members, "members"), docs, shingle), "sets")
    small = _judged(members.where(F.col("n") <= _GROUP), ["root"], least, similarity)
    large = members.where(F.col("n") > _GROUP).select("node", "sketch", "set")
    found = small.unionByName(_judged(posted.join(large, "node"), ["band", "key"], least, similarity))
    return found.unionByName(_confirmed(proposed, members.select("node", "set"), similarity))


def _confirmed(pairs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Those of the links (a, b) between ``members`` (node, set) that have the similarity."""
    left, right = (members.select(F.col("node").alias(c), F.col("set").alias(f"{c}_set")) for c in "ab")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = zip(*([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("a_set", "b_set")))
        keep = pa.array([_jaccard(x, y) >= similarity for x, y in sets], pa.bool_())
        return batch.select(["a", "b"]).filter(keep)

    return map_batches(pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set"), run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 4, max_bits: int = 4, similarity: float | None = None, rows: bool = False) -> DataFrame:
    """(doc_id, fp, component_id[, at, keep]) for every row of ``docs`` (doc_id, text).

    Fingerprints that differ in at most ``max_bits`` bits are linked, over any number of steps; component_id is the
    smallest doc_id reachable.  With ``similarity`` texts are linked whose word shingles have that Jaccard similarity or
    more; equal and close fingerprints then only propose pairs.  Null and wordless texts have fingerprint 0 and are
    linked like any other.  Rows that repeat a doc_id are each returned.  A null doc_id takes part; a component of null ids only has a null id.  An empty table gives an
    empty one.  With ``rows`` (and ``similarity``) at is the row's place as in ``placed``, and keep that of the row that
    stands for its component: the smallest doc_id's, null ids last.
    """
    stage = Staged(spark)
    fps = stage.save(fingerprints(docs, shingle, similarity is not None), "fp")
    key = "fp" if similarity is None else "node"
    if similarity is None:
        classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    else:
        first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "doc_id", "at", "fp", "sketch", "keys"))
        classes = fps.groupBy("node").agg(first.alias("s")).select("node", F.col("s.doc_id").alias("first_id"), "s.at", "s.fp", "s.sketch", "s.keys")
    classes = stage.save(classes, "class")
    distinct = classes.select("fp")
    found = links(distinct if similarity is None else distinct.distinct(), max_bits)
    if similarity is not None:
        found = similar_links(spark, docs, classes, stage.save(found, "close"), shingle, similarity, stage)
    roots = components(spark, stage.save(found, "link"))
    at = F.lit(None).cast("long") if similarity is None else F.col("at")
    named = classes.join(roots.withColumnRenamed("node", key), key, "left").select(key, "first_id", at.alias("at"), F.coalesce("root", key).alias("root"))
    named = stage.save(named, "root")
    # staged, so that both sides of the join are exchanged and a component that holds many nodes can be split
    first = F.min(F.struct(F.coalesce("first_id", F.lit((1 << 63) - 1)), "first_id", "at"))
    least = stage.save(named.groupBy("root").agg(F.min("first_id").alias("component_id"), first["at"].alias("keep")), "least")
    ids = stage.save(named.join(least, "root").select(key, "component_id", "keep"), "id")
    stage.drop("class", "close", "link", "root", "least", "posted", "proposed", "loose", "groups", "members", "sets")
    return fps.join(ids, key).select("doc_id", "fp", "component_id", *["at", "keep"] * rows)


def as_hex(fp) -> F.Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
