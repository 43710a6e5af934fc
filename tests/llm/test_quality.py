import random
import zlib

import numpy as np

from polygate.llm import quality

SCHEMA = "doc_id long, text string, quality string, score string"


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 0.0, 2.0, 1.0, 1.0]), np.ones(5)).round(6).tolist() == [0.5, 0.5, 1.333333, 1.333333, 1.333333]


def test_isotonic_ties_and_weights():
    rng = np.random.default_rng(3)
    for _ in range(30):
        y, w = rng.integers(0, 3, 12).astype(float), rng.integers(1, 5, 12).astype(float)
        got = quality.isotonic(y, w)
        # by the max-min formula: the largest over beginnings of the smallest mean up to an end
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(got, want)
    assert quality.isotonic(np.array([0.5, 0.5, 0.5]), np.array([1.0, 2.0, 3.0])).tolist() == [0.5] * 3


def test_equals_a_dense_fit(spark):
    """The same features, ridge and calibration in one matrix, without partitions."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("etaoins", k=rng.randrange(2, 9))) + rng.choice(["", "", "!", "##"]) for _ in range(rng.randrange(1, 80))) for _ in range(700)]
    texts += texts[:40]  # ties
    y = {i: int(rng.random() < (0.9 if t.count("#") < t.count(" ") / 5 else 0.1)) for i, t in enumerate(texts) if i % 7}
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in quality.classify(spark, docs, spark.createDataFrame(list(y.items()), "doc_id long, quality int").repartition(3)).collect()}

    x = np.array([quality.statistics(t) for t in texts])
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))])
    known = np.array([i in y and fold[i] != 0 for i in range(len(texts))])
    mean, deviation = x[known].mean(0), np.maximum(x[known].std(0), 1e-6)
    rng2 = np.random.default_rng(17)
    d, n = x.shape[1], quality.FEATURES
    weights, shifts = rng2.normal(0, 1 / np.sqrt(d), (d, n)), rng2.uniform(0, 2 * np.pi, n)
    z = np.concatenate([np.ones((len(x), 1)), np.cos(np.clip((x - mean) / deviation, -8, 8) @ weights + shifts) * np.sqrt(2 / n)], axis=1)
    fit, tune, label = known & (fold != 4), known & (fold == 4), np.array([y.get(i, 0) for i in range(len(texts))], float)
    penalty = np.diag(np.r_[1e-9, np.full(n, 1e-3 * fit.sum() / n)])
    raw = z @ np.linalg.solve(z[fit].T @ z[fit] + penalty, z[fit].T @ label[fit])
    bins = ((np.clip(raw, -1, 2) + 1) / 3 * quality.BINS).astype(int)
    at = sorted(set(bins[tune]))
    knots, means, counts = (np.array([f(tune & (bins == b)) for b in at]) for f in (lambda m: np.clip(raw, -1, 2)[m].mean(), lambda m: label[m].mean(), lambda m: float(m.sum())))
    values = np.array([max(min(np.average(means[a : b + 1], weights=counts[a : b + 1]) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))])
    want = np.clip(0.998 * np.interp(raw, knots, values) + 0.002 * np.clip(raw, 0, 1), 0, 1)
    assert max(abs(got[i].score - want[i]) for i in range(len(texts))) < 1e-9
    assert 0.1 < want.mean() < 0.9 and all(got[i].predicted == (got[i].score >= 0.3) for i in got)
    assert all(got[i].score == got[700 + i].score for i in range(40))


def test_ties_at_the_threshold(spark):
    """Without labels each score is 0.5 by 0.998 and the clipped raw score's trace: a threshold that equals it accepts."""
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a", None, None), (2, None, None, None), (2, "b " * 200_000, None, None)], SCHEMA)
    score = quality.classify(spark, docs, none).first().score
    assert {r.predicted for r in quality.classify(spark, docs, none, threshold=score).collect()} == {1}
    assert {r.predicted for r in quality.classify(spark, docs, none, threshold=np.nextafter(score, 1)).collect()} == {0}


def test_statistics_are_finite():
    for t in (None, "", " ", "\n\n", "a", "é" * 1000, "x " * 100_000, "!!!", "\x00"):
        s = quality.statistics(t)
        assert len(s) == len(quality.STATISTICS) and np.isfinite(s).all()


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(1200):
        n, bad = rng.randrange(20, 200), i % 3 == 0
        w = ["".join(rng.choices("etaoins", k=rng.randrange(2, 9))) for _ in range(n)]
        text = " ".join(x.upper() + "!!" if bad else x for x in w)
        rows.append((i, text, "a", "b"))
        labels.append((i, 0 if bad else 1))
    rows += [(5000, None, None, None), (5001, "", None, None), (None, "text", None, None), (4, "again", None, None)]
    labels += [(9999, 1), (None, 1), (7, None)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = quality.classify(spark, d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) > 0.97 * len(held)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(spark, spark.createDataFrame([(1, "a", None, None), (2, "b c", None, None)], SCHEMA), none).collect()
    assert len({r.score for r in got}) == 1
    assert quality.classify(spark, spark.createDataFrame([], SCHEMA), none).collect() == []
