"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the corpus are counted (all texts, partial sums first); frequent ones are merged once on the driver and
compiled into a minimal acyclic automaton whose states share suffixes.  Each transition carries the number of words
that sort before it, so a walk sums up to the word's rank, and the rank leads to its ids: an id-output transducer
without outputs on the arcs, which would spoil the sharing.  Its flat arrays go to the shared folder as one file, which
executors fetch and memory-map, so the workers of a machine share its pages.  Words outside it are merged exactly.

Results equal the tokenizers library's for byte-level BPE files with word ends.  Texts up to U+024F are normalised and
split here; others go through the file's own normaliser and splitter, so Unicode versions can't differ.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polygate.llm.common import Staged, documents, map_arrow, map_batches, publish

#: The lexicon's words at most: a bound on what is compiled on the driver, not on what is encoded.
LEXICON = 150_000
_CACHE = 400_000  # words that a worker remembers
_SLICE = 4 << 20  # characters encoded at a time
_SHORT = 48  # bytes of a word that is merged beside others
_NEVER = np.int32(2**31 - 1)


@cache
def _byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A tokenizer file: ids, merges and special tokens."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.content = content
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level BPE files are supported")
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in (*self.ids.items(), *self.special.items()):
            self.tokens[i] = t
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        chars = _byte_chars()
        self.inner = [self.ids.get(c, -1) for c in chars]
        self.last = [self.ids.get(c + self.end, -1) for c in chars]
        self.splitter = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._tables()
        full = Tokenizer.from_str(content)
        self.normalizer, self.pre = full.normalizer, full.pre_tokenizer
        self.unmapped = {c: b for b, c in enumerate(chars)}

    def _tables(self) -> None:
        """The merges as arrays, sorted by pair, for words merged side by side."""
        self.inner_ids, self.last_ids = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        pairs = np.array([a * len(self.tokens) + b for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.pair_ranks = np.array([r for r, _ in self.ranks.values()], np.int32)[order]
        self.made = np.zeros(1 + max((r for r, _ in self.ranks.values()), default=0), np.int32)
        for rank, new in self.ranks.values():
            self.made[rank] = new

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, ``_NEVER`` for those without a merge."""
        want = left.astype(np.int64) * len(self.tokens) + right
        if not len(self.pairs):
            return np.full(want.shape, _NEVER, np.int32)
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.pair_ranks[at], _NEVER)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`merge` gives for each word: lengths, and all ids in a row.

        Words of a length stand in a matrix; a round merges the best pair of each row, so that all rows left are one
        shorter and meet the words of that length.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        found: list[tuple[np.ndarray, np.ndarray]] = []  # words, and a matrix of their ids
        side_by_side = sizes <= _SHORT if min(self.inner_ids.min(), self.last_ids.min()) >= 0 else np.zeros(len(words), bool)
        lengths = np.zeros(len(words), np.int64)
        alone = {i: self.merge(words[i]) for i in np.flatnonzero(~side_by_side).tolist()}
        lengths[list(alone)] = [len(x) for x in alone.values()]
        who, ids, ranks = np.empty(0, np.int64), np.empty((0, _SHORT), np.int32), np.empty((0, _SHORT - 1), np.int32)
        for k in range(_SHORT, 0, -1):
            ids, ranks = ids.reshape(len(who), k), ranks.reshape(len(who), k - 1)
            fresh = np.flatnonzero((sizes == k) & side_by_side)
            if len(fresh):
                raw = np.frombuffer(b"".join([words[i] for i in fresh.tolist()]), np.uint8).reshape(-1, k)
                new = self.inner_ids[raw]
                new[:, -1] = self.last_ids[raw[:, -1]]
                who, ids = np.concatenate([who, fresh]), np.concatenate([ids, new])
                ranks = np.concatenate([ranks, self._rank(new[:, :-1], new[:, 1:])])
            if k == 1 or not len(who):
                found.append((who, ids))
                continue
            at = ranks.argmin(1)
            best = ranks[np.arange(len(who)), at]
            go = best < _NEVER
            found.append((who[~go], ids[~go]))
            who, ids, ranks, at, best = who[go], ids[go], ranks[go], at[go], best[go]
            row = np.arange(len(who))
            ids[row, at] = self.made[best]
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(who), k - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(who), k - 2)
            i = np.flatnonzero(at > 0)
            ranks[i, at[i] - 1] = self._rank(ids[i, at[i] - 1], ids[i, at[i]])
            i = np.flatnonzero(at < k - 2)
            ranks[i, at[i]] = self._rank(ids[i, at[i]], ids[i, at[i] + 1])
        for w, x in found:
            lengths[w] = x.shape[1]
        begin = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.uint32)
        for w, x in found:
            flat[begin[w][:, None] + np.arange(x.shape[1])] = x
        for w, x in alone.items():
            flat[begin[w] : begin[w] + len(x)] = x
        return lengths, flat

    def merge(self, word: bytes) -> list[int]:
        """Merges a word's bytes by rank, the leftmost of equals first."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]] if word else []
        ids = [i for i in ids if i >= 0]
        if len(ids) > 48:
            return self._merge_long(ids)
        ranks = self.ranks
        while len(ids) > 1:
            best, at, new = 1 << 60, -1, -1
            for i, pair in enumerate(zip(ids, ids[1:])):
                r = ranks.get(pair)
                if r is not None and r[0] < best:
                    best, new = r
                    at = i
            if at < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for very long words."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.ranks[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (r := self.ranks.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (r[0], p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if text.isascii() or _SIMPLE.fullmatch(text):
            return _WORD.findall(_lower(text))
        back = self.unmapped
        return [bytes(back[c] for c in w).decode("utf-8", "replace") for w, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def split(self, text: str) -> list[str | int]:
        """Texts between special tokens, and the ids of those."""
        if self.splitter is None or "<" not in text:
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.splitter.finditer(text):
            out += [text[at : m.start()], self.special[m.group()]]
            at = m.end()
        return [*out, text[at:]]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by blanks, as the library does for a file without decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_text(self, ids: Iterable[int]) -> str:
        """Readable text: bytes for characters, and a blank for each word end."""
        data = bytearray()
        for i in ids:
            t = self.tokens[i]
            ends = bool(self.end) and t.endswith(self.end)
            data += bytes(self.unmapped[c] for c in (t[: -len(self.end)] if ends else t) if c in self.unmapped)
            if ends:
                data += b" "
        return bytes(data).decode("utf-8", "replace").rstrip(" ")


def _lower(text: str) -> str:
    """Lower case by character: no final sigma."""
    return text.lower()


#: What the characters below U+0250 can be lower-cased to, themselves included; some have a lower case above U+024F.
_REACH = sorted({c for i in range(0x250) for c in chr(i) + chr(i).lower()})


def _class(test) -> str:
    return "".join(re.escape(c) for c in _REACH if test(unicodedata.category(c)[0]))


_SIMPLE = re.compile("[\x00-\x1b -\u024f]*")  # what follows is stable in all Unicode versions; \x1c-\x1f are spaces for some
_LETTER, _NUMBER = _class(lambda c: c == "L"), _class(lambda c: c == "N")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\t-\\r \x85\xa0{_LETTER}{_NUMBER}]+")


# --- the transducer -------------------------------------------------------------------------------------------------


class Transducer:
    """A minimal acyclic automaton over bytes in dense flat arrays; looks up many words at once."""

    def __init__(self, classes: np.ndarray, step: np.ndarray, skip: np.ndarray, final: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        self.classes, self.step, self.skip, self.final, self.starts, self.ids = classes, step, skip, final, starts, ids

    @classmethod
    def build(cls, entries: Iterable[tuple[bytes, list[int]]]) -> Transducer:
        """From distinct words and their ids: words are added in order and finished branches replaced by equal ones."""
        entries = sorted(entries)
        states: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]  # states of the last word
        last = b""

        def close(down_to: int) -> None:
            for depth in range(len(path) - 1, down_to, -1):
                s = path[depth]
                sign = (final[s], *states[s].items())
                same = register.get(sign)
                if same is None:
                    register[sign] = s
                else:
                    states[path[depth - 1]][last[depth - 1]] = same
                    if s == len(states) - 1:
                        states.pop()
                        final.pop()

        for word, _ in entries:
            common = len(os.path.commonprefix([word, last]))
            close(common)
            del path[common + 1 :]
            for b in word[common:]:
                states.append({})
                final.append(False)
                states[path[-1]][b] = len(states) - 1
                path.append(len(states) - 1)
            final[path[-1]] = True
            last = word
        close(0)
        used = sorted({b for s in states for b in s})
        classes = np.zeros(256, np.uint8)
        classes[used] = np.arange(1, len(used) + 1)
        step = np.zeros((len(states), len(used) + 1), np.int32)  # 0: no way on
        skip = np.zeros_like(step)
        words = [-1] * len(states)

        def count(top: int) -> None:
            todo = [top]
            while todo:
                s = todo[-1]
                open_ = [t for t in states[s].values() if words[t] < 0]
                if open_:
                    todo += open_
                    continue
                todo.pop()
                total = int(final[s])
                for b, t in sorted(states[s].items()):
                    step[s, classes[b]], skip[s, classes[b]] = t, total
                    total += words[t]
                words[s] = total

        count(0)
        starts = np.cumsum([0, *(len(ids) for _, ids in entries)])
        flat = np.fromiter((i for _, ids in entries for i in ids), np.uint32, int(starts[-1]))
        return cls(classes, step, skip, np.array(final, bool), starts.astype(np.int64), flat)

    _FIELDS = ("classes", "step", "skip", "final", "starts", "ids")

    def packed(self) -> bytes:
        """One file's bytes: a header of shapes and kinds, then the arrays, each at a multiple of 64 bytes."""
        head, blobs, at = [], [], 0
        for f in self._FIELDS:
            a = np.ascontiguousarray(getattr(self, f))
            head.append((f, a.dtype.str, a.shape, at))
            blobs.append((at, a))
            at += -(-a.nbytes // 64) * 64
        text = json.dumps(head).encode()
        base = -(-(8 + len(text)) // 64) * 64
        out = bytearray(max(base + blobs[-1][0] + blobs[-1][1].nbytes, base + 1))
        out[: 8 + len(text)] = len(text).to_bytes(8, "little") + text
        for at, a in blobs:
            out[base + at : base + at + a.nbytes] = a.tobytes()
        return bytes(out)

    @classmethod
    def load(cls, path: str) -> Transducer:
        """Memory-maps a saved transducer."""
        data = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(bytes(data[:8]), "little")
        base = -(-(8 + n) // 64) * 64
        out = {}
        for f, kind, shape, at in json.loads(bytes(data[8 : 8 + n])):
            size = int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize
            out[f] = data[base + at : base + at + size].view(kind).reshape(shape)
        return cls(**out)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words outside; all words walk one byte at a time together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        out = np.full(n, -1, np.int64)
        short = np.flatnonzero((lengths <= 64) & (lengths > 0))
        if not len(short):
            return out
        order = short[np.argsort(-lengths[short], kind="stable")]  # longest first: those still walking are in front
        size = lengths[order]
        data = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
        begin = np.cumsum(size) - size
        state, rank, alive = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.ones(len(order), bool)
        for p in range(int(size[0])):
            m = int(np.searchsorted(-size, -p, side="left"))  # words longer than p
            s, c = state[:m], self.classes[data[begin[:m] + p]]
            rank[:m] += self.skip[s, c]
            state[:m] = self.step[s, c]
            alive[:m] &= state[:m] > 0
        hit = alive & self.final[state]
        out[order[hit]] = rank[hit]
        return out

    def outputs(self, rank: int) -> list[int]:
        return self.ids[self.starts[rank] : self.starts[rank + 1]].tolist()


# --- a worker's encoder ---------------------------------------------------------------------------------------------


class _Codes(dict):
    """Numbers words in the order in which they are first looked up, and notes the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes texts with a vocabulary and, if there is one, a lexicon; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None = None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._reset()

    def _reset(self) -> None:
        self.code = _Codes()
        self.flat, self.size = np.empty(1 << 16, np.uint32), 0
        self.begin, self.length, self.known = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        """The ids of new words: from the lexicon, else merged; of a special token its own id."""
        special = {i: int(w[1:]) for i, w in enumerate(new) if w[0] == "\x00" and w[1:2].isdigit()}
        raw = [w.encode() for w in new]
        lengths, ranks = np.ones(len(new), np.int64), np.full(len(new), -1)
        if self.lexicon is not None:
            ranks = self.lexicon.ranks(raw)
        ranks[list(special)] = -2
        found = [(np.array(list(special), np.int64), np.array(list(special.values()), np.uint32))]
        some = np.flatnonzero(ranks >= 0)
        if len(some):
            first, end = self.lexicon.starts[ranks[some]], self.lexicon.starts[ranks[some] + 1]
            lengths[some] = end - first
            found.append((some, self.lexicon.ids[_ranges(first, end - first)]))
        some = np.flatnonzero(ranks == -1)
        lengths[some], ids = self.vocabulary.merge_many([raw[i] for i in some.tolist()])
        found.append((some, ids))
        begin = self.size + np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        while self.size + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.uint32)])
        while self.known + len(new) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.empty(len(x), np.int64)]) for x in (self.begin, self.length))
        for some, ids in found:
            self.flat[_ranges(begin[some], lengths[some])] = ids
        self.begin[self.known : self.known + len(new)] = begin
        self.length[self.known : self.known + len(new)] = lengths
        self.size += total
        self.known += len(new)

    def batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            words: list[str] = []
            for part in self.vocabulary.split(text or ""):
                if isinstance(part, int):
                    words.append(f"\x00{part}")  # no word begins with a zero byte and a digit: those are split
                else:
                    words += self.vocabulary.words(part)
            held.append(words)
            size += len(text or "")
            if size > _SLICE:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.code) > _CACHE:
            self._reset()
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(held)), np.int64, int(sizes.sum()))
        if self.code.new:
            new, self.code.new = self.code.new, []
            self._learn(new)
        lengths = self.length[codes]
        ids = self.flat[_ranges(self.begin[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        for a, b in zip(ends, ends[1:]):
            yield ids[a:b]


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of each range, one range after the other."""
    end = np.cumsum(length)
    out = np.ones(int(end[-1]) if len(end) else 0, np.int64)
    some = length > 0
    first, length = first[some], length[some]
    if len(first):
        out[0] = first[0]
        out[np.cumsum(length)[:-1]] = first[1:] - first[:-1] - length[:-1] + 1
    return np.cumsum(out)


_vocabularies: dict[int, Vocabulary] = {}


def vocabulary_of(content: str) -> Vocabulary:
    """Parses a file once in each process."""
    key = hash(content)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(content)
    return _vocabularies[key]


# --- over tables ----------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, content: str) -> DataFrame:
    """(word, n): how often each word occurs, over all whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(content)  # a tokenizer file: some megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        vocabulary, counts = vocabulary_of(sent.value), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column("text"):
                for part in vocabulary.split(text.as_py() or ""):
                    if isinstance(part, str):
                        counts.update(vocabulary.words(part))
                if len(counts) > 500_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return map_arrow(documents(docs).select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(spark: SparkSession, docs: DataFrame, content: str, most: int = LEXICON) -> str:
    """Compiles the most frequent words and sends the transducer to the executors; returns the file's name there.

    Counts fall into buckets of an eighth of an octave; whole buckets are taken from the top while at most ``most``
    words fit, so the driver never sees more.
    """
    bucket = F.floor(F.log2("n") * 8).cast("int")
    stage = Staged(spark)
    counts = stage.save(word_counts(docs, content).where("length(word) <= 64 and n > 1").withColumn("bucket", bucket), "words")  # words that occur once gain nothing
    least, room = 1 << 30, most
    for b, n in sorted(((r.bucket, r["count"]) for r in counts.groupBy("bucket").count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = b
    words = [r.word for r in counts.where(F.col("bucket") >= least).select("word").collect()]
    stage.drop("words")
    vocabulary = vocabulary_of(content)
    raw = [w.encode() for w in words if w]
    lengths, ids = vocabulary.merge_many(raw)
    name = f"lexicon-{os.urandom(6).hex()}.bin"
    built = Transducer.build(zip(raw, (x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1]))))
    spark.sparkContext.addFile(publish(spark, name, built.packed()))
    return name


_encoders: dict[tuple[int, str | None], Encoder] = {}


def encoder(content: str, lexicon: str | None) -> Encoder:
    """For a worker: the vocabulary, and the lexicon that the driver sent.  The last one is kept for later tasks."""
    from pyspark import SparkFiles

    key = (hash(content), lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary_of(content), Transducer.load(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[key]


def encode(spark: SparkSession, docs: DataFrame, path: str, lexicon_words: int = LEXICON) -> DataFrame:
    """(doc_id, ids): ids is binary, little-endian unsigned 32-bit integers, for every row of ``docs`` (doc_id, text).

    ``path`` is the tokenizer file, read on the driver alone.  Null texts count as empty and have no ids; null and
    repeated doc_ids are kept.  Very long texts and words are taken whole: a text is encoded in slices of words, a long word
    merged with a heap.  An empty table gives an empty one.  ``lexicon_words=0`` encodes without a lexicon, and without the counting pass.
    """
    return _apply(spark, docs, path, lexicon_words, _ids_only, "doc_id long, ids binary")


def _ids_only(batch: pa.RecordBatch, ids: list[np.ndarray], vocabulary: Vocabulary) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())], names=["doc_id", "ids"])


def _apply(spark, docs, path, lexicon_words, finish, schema) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        content = f.read()
    lexicon = compile_lexicon(spark, docs, content, lexicon_words) if lexicon_words else None
    sent = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, lexicon)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield finish(batch, list(enc.batch(batch.column("text").to_pylist())), enc.vocabulary)

    return map_arrow(documents(docs), run, schema)


def _round_trip(batch: pa.RecordBatch, ids: list[np.ndarray], vocabulary: Vocabulary) -> pa.RecordBatch:
    import hashlib

    decoded = [vocabulary.decode(i.tolist()) for i in ids]
    cols = [
        batch.column("doc_id"),
        pa.array([len(i) for i in ids], pa.int64()),
        pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]),
        pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(spark: SparkSession, docs: DataFrame, path: str, lexicon_words: int = LEXICON) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass; odd rows as in :func:`encode`."""
    return _apply(spark, docs, path, lexicon_words, _round_trip, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str, readable: bool = False) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): as the library decodes, or readable text.  Null ids give a null text."""
    with open(path, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = vocabulary_of(sent.value)
        say = vocabulary.decode_text if readable else vocabulary.decode
        texts = [None if x is None else say(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")), run, "doc_id long, text string")
