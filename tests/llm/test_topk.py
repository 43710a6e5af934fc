import math
import random

import numpy as np
import pytest

from polygate.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, pivot int, x string"


def brute(rows, k=5):
    vecs = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vecs:
        if q % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vecs if i != q)[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (9, 16))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.3, 16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(i, rows[50][1]) for i in range(1500, 1900)]  # many equal vectors
    rows += [(5000, None), (5050, [1.0] * 15 + [float("nan")]), (5100, [float("inf")] + [0.0] * 15), (5150, [None] + [0.5] * 15), (-50, [0.25] * 16), (None, [9.0] * 16), (5200, []), (5250, [0.0] * 16), (5300, [2.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(spark, df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)


def test_few_rows_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, ""), (50, [0.5, 0.5], 1, 1, ""), (7, [-1.0, 0.001], 1, 1, "")], SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(spark, few).collect())
    assert got == brute([(0, [1.0, 2.0]), (50, [0.5, 0.5]), (7, [-1.0, float(np.float32(0.001))])])
    assert topk.top_k(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    assert topk.top_k(spark, spark.createDataFrame([(3, [1.0], 1, 1, "")], SCHEMA)).collect() == []


def test_large_components_and_overflow(spark):
    say = lambda rows: spark.createDataFrame([(i, v, 1, 1, "") for i, v in rows], SCHEMA.replace("float", "double"))
    rows = [(0, [1e10]), (1, [1.0]), (2, [2.0]), (50, [-3000.0]), (100, [9000.5]), (3, [1e-9])]
    got = sorted(tuple(r) for r in topk.top_k(spark, say(rows)).collect())
    assert got == brute(rows) and (0, 2, 2, 1310720000000000) in got and (0, 3, 1, 655360000000000) in got
    for bad in ([(0, [1e7] * 64), (1, [1e7] * 64)], [(0, [1e300]), (1, [1.0])], [(0, [2.0**55]), (1, [1.0])], [(0, [1e10]), (1, [-1e10])]):
        with pytest.raises(Exception, match="64-bit"):
            topk.top_k(spark, say(bad)).collect()


def test_repeated_ids_and_ties(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(40)] + [(0, [0.5, 9.0]), (0, [0.5, -9.0]), (0, [0.5, 9.0]), (50, [1.0, 1.0])]
    got = {}
    for r in topk.top_k(spark, spark.createDataFrame([(i, v, 1, 1, "") for i, v in rows], SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for q, x in ((0, [128, -2304]), (50, [256, 256])):  # of the rows with id 0 the smallest vector asks
        want = sorted((-(x[0] * v[0] + x[1] * v[1]), i) for i, v in whole if i != q)[:5]
        assert sorted(got[q]) == [(r + 1, i, -s) for r, (s, i) in enumerate(want)]
    assert [v for _, v, _ in got[50]].count(0) == 2


def test_share_of_products_on_clustered_data(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.02, 16)).astype(np.float32).tolist()) for i in range(8000)]
    rows += [(i, rows[3][1]) for i in range(8000, 10000)]  # a common vector
    df = spark.createDataFrame([(i, v, 1, 1, "") for i, v in rows], SCHEMA).repartition(4)
    spent = topk._searched(spark, df, 5, 256.0, 50).agg({"spent": "sum"}).first()[0]
    share = spent / (200 * 10000)
    print(f"{share:.3f} of all products")
    assert share < 0.3
    e = np.floor(256 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark, df).collect()}
    for q in range(0, 10000, 50):
        s = e @ e[q]
        s[q] = -(1 << 62)
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(int(b), int(s[b])) for b in best]


def test_bounds_prune():
    rng = random.Random(0)
    pivots = np.array([[0, 0], [1000, 1000]])
    seen = []

    class Watch(dict):
        def __getitem__(self, key):
            if key == "x":
                seen.append(dict.__getitem__(self, "pivot"))
            return dict.__getitem__(self, key)

    def block(p):
        x = np.array([[rng.randrange(5) + 1000 * p, rng.randrange(5) + 1000 * p] for _ in range(20)])
        d = topk._distances(x, pivots)[:, p]
        return Watch(pivot=p, near=d.min() - 0.01, far=d.max() + 0.01, norm=float((x**2).sum(1).max()), ids=np.arange(20) + 100 * p, x=x)

    topk.search(np.array([999]), np.array([[1000, 1000]]), np.array([-(1 << 62)]), [block(0), block(1)], pivots, 5)
    assert seen == [1]
