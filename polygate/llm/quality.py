"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each whole text (lengths, character classes, repetition, compressibility) are standardised and mapped by
``cos(W x + b)`` with Gaussian W, whose inner products approximate a Gaussian kernel.  Ridge scores come from normal
equations: each partition sums its own ``Z'Z`` and ``Z'y``, and the sums of partitions are added in two levels, so the
driver gets a few matrices whatever the number of rows.  Isotonic regression over score bins of a part of the training
rows that the fit didn't see turns scores into probabilities.  All labelled training rows take part; nothing is sampled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polygate.llm.common import Staged, documents, map_arrow, map_batches, placed

FEATURES = 256  # random Fourier features
BINS = 4096
_EDGE = re.compile(r"[^\W_]+")

STATISTICS = (
    "log_chars", "log_words", "mean_word", "long_words", "unique_words", "upper", "title_words", "digits", "spaces", "punctuation", "symbols", "non_ascii",
    "words_ending_in_symbols", "words_without_letters", "sentence_ends", "log_lines", "mean_line", "repeated_lines", "top_word", "top_pair", "repeated_triples", "word_entropy", "char_entropy", "compression", "bars", "commas",
)
_SYMBOLS = b"#$%&*<>@\\^_`{|}~+=/["
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 1 if "A" <= _ch <= "Z" else 2 if "a" <= _ch <= "z" else 3 if _ch.isdigit() and _c < 128 else 4 if _ch in " \t\r\n\x0b\x0c" else 5 if _c in _SYMBOLS else 6 if _c < 128 else 7


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``; all finite, also for empty texts."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    n = max(1, len(raw))
    chars = np.bincount(raw, minlength=256)
    kind = np.bincount(_CLASS, weights=chars, minlength=8)
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:])))
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    total = int(lengths.sum())
    ends = Counter(w[-1] for w in words)
    odd = sum(c for e, c in ends.items() if not (e.isalnum() or e in ".,;:!?'\")"))
    squeezed = zlib.compressobj(1)
    size = sum(len(squeezed.compress(data[i : i + (1 << 20)])) for i in range(0, len(data), 1 << 20)) + len(squeezed.flush())
    lower = np.fromiter(counts.values(), np.int64, len(counts))
    return [
        math.log1p(len(text)), math.log1p(len(words)), total / m, float((lengths > 12).sum()) / m, len(counts) / m, kind[1] / n, sum(w[:1].isupper() for w in words) / m, kind[3] / n, kind[4] / n, kind[6] / n, kind[5] / n, kind[7] / n,
        odd / m, sum(c for w, c in counts.items() if not _EDGE.search(w)) / m, (chars[46] + chars[33] + chars[63]) / m, math.log1p(len(lines)), math.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines),
        max(counts.values(), default=0) / m, max(pairs.values(), default=0) / m, 1 - triples / max(1, len(words) - 2) if len(words) > 2 else 0.0, _entropy(lower) / math.log2(m + 1), _entropy(chars), size / n, chars[124] / m, chars[44] / m,
    ]


def statistics_of(docs: DataFrame, rows: bool = False) -> DataFrame:
    """(doc_id, x[, at]): the statistics of every row of ``docs`` (doc_id, text); with ``rows`` also its place."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t.as_py()) for t in batch.column("text")]
        cols = [batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())), *(batch.column("at") for _ in range(rows))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "x", "at"][: len(cols)])

    return map_batches(placed(docs) if rows else documents(docs), run, "doc_id long, x array<double>" + ", at long" * rows)


@dataclass
class Model:
    """Everything that scores: scaling, Fourier weights, ridge weights and the calibration's steps."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    shifts: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        out = np.cos(z @ self.weights + self.shifts) * math.sqrt(2 / len(self.shifts))
        return np.concatenate([np.ones((len(x), 1)), out], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, between 0 and 1; a trace of the raw score keeps the order within a step."""
        s = self.raw(x)
        p = np.interp(s, self.knots, self.values) if len(self.knots) else np.full(len(x), 0.5)
        return np.clip(0.998 * p + 0.002 * np.clip(s, 0, 1), 0.0, 1.0)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The nondecreasing values closest to ``y`` in weighted least squares (pool adjacent violators)."""
    value, weight, size = [], [], []
    for a, b in zip(y.tolist(), w.tolist()):
        value.append(a)
        weight.append(b)
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            b1, b2 = weight[-2], weight[-1]
            value[-2:] = [(value[-2] * b1 + value[-1] * b2) / (b1 + b2)]
            weight[-2:] = [b1 + b2]
            size[-2:] = [size[-2] + size[-1]]
    return np.repeat(value, size)


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _fourier(d: int, features: int, width: float, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / (width * math.sqrt(d)), (d, features)), rng.uniform(0, 2 * math.pi, features)


def normal_equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows of ``train`` (x, y): sums of partitions, then of groups of partitions."""
    size = len(model.shifts) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z, y = model.features(_stack(batch)), batch.column("y").to_numpy(zero_copy_only=False)
                a[:, :-1] += z.T @ z
                a[:, -1] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["a"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros(size * (size + 1))
        for batch in batches:
            for b in batch.column("a"):
                a += np.frombuffer(b.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["a"])

    parts = map_arrow(train.select("x", F.col("y").cast("double").alias("y")), part, "a binary")
    total = sum(np.frombuffer(r.a) for r in map_arrow(parts.repartition(4), add, "a binary").toLocalIterator())
    total = np.asarray(total).reshape(size, size + 1)
    return total[:, :-1], total[:, -1]


def fit(train: DataFrame, features: int = FEATURES, width: float = 1.0, ridge: float = 1e-3) -> Model:
    """Fits on ``train`` (x, y, fold): fold 4 calibrates, the others fit.  Without rows the score is a constant."""
    d = len(STATISTICS)
    aggs = [f(F.element_at("x", i + 1)).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = train.agg(*aggs).first()
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(d)])
    deviation = np.array([max(r[f"s{i}"] or 0.0, 1e-6) for i in range(d)])
    w, b = _fourier(d, features, width)
    model = Model(mean, deviation, w, b, np.zeros(features + 1), np.empty(0), np.empty(0))
    a, y = normal_equations(train.where("fold <> 4"), model)
    n = max(a[0, 0], 1.0)
    penalty = ridge * n * np.eye(features + 1) / features
    penalty[0, 0] = 1e-9
    model.beta = np.linalg.solve(a + penalty, y)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.clip(model.raw(_stack(batch)), -1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(((s + 1) / 3 * BINS).astype(np.int32)), pa.array(s), batch.column("y")], names=["bin", "s", "y"])

    rows = map_arrow(train.where("fold = 4").select("x", F.col("y").cast("double").alias("y")), bins, "bin int, s double, y double")
    got = sorted(rows.groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    if got:
        model.knots = np.array([g.s for g in got])
        model.values = isotonic(np.array([g.y for g in got]), np.array([float(g.n) for g in got]))
    return model


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep_text: bool = False, rows: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted[, at]) for every row of ``docs`` (doc_id, text).

    Learns from rows of ``labels`` (doc_id, quality) with a label and an id whose fold isn't 0.  Labels of unknown
    documents and null labels are ignored; repeated ones each count.  Null texts score as empty ones.  Without any
    label every score is one constant.  A null id is held out.  Very long texts are read whole; equal texts have equal
    scores, and a score that equals the threshold is accepted.  An empty table gives an empty one.  With ``rows`` at is the row's place as in ``placed``.
    """
    stage = Staged(spark)
    stats = stage.save(statistics_of(docs, rows), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    train = stats.join(known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0"), "doc_id").select("x", "y", "fold")
    train = stage.save(train, "train")
    model = fit(train)
    stage.drop("train")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(_stack(batch))
        cols = [batch.column("doc_id"), pa.array(s), *(batch.column("at") for _ in range(rows))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "at"][: len(cols)])

    out = map_batches(stats, run, "doc_id long, score double" + ", at long" * rows)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["at"] * rows)
