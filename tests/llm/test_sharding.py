import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from polygate.llm import sharding

SCHEMA = "doc_id long, text string, shard string, block string"


def test_law_sizes_slots(spark):
    rows = [(i, f"täxt {i}" * (i % 5), "a", "b") for i in range(4000)] + [(7, "again", None, None), (None, None, None, None), (None, "", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.shard(spark, df, sharding.tree(40), sharding.tree(40, grown=1)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    assert all(r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 for r in got)
    assert 60 < sum(r.grown_shard == 40 for r in got) < 150
    counts = Counter(r.shard for r in got)
    assert all(abs(n - 100) < 50 for n in counts.values())
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    place = {}
    for r in got:
        assert place.setdefault(r.doc_id, r.shard) == r.shard
    texts = Counter((d, (t or "").encode()) for d, t, _, _ in rows)
    assert texts.keys() >= {(r.doc_id, (dict((x[0], x[1]) for x in rows if x[0] == r.doc_id)[r.doc_id] or "").encode()) for r in got}
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert want == Counter((r.doc_id, r.size, r.text_crc32) for r in got)


def test_weights_confine_movement(spark):
    df = spark.range(6000).selectExpr("id doc_id")
    a, b = sharding.tree(16), sharding.tree(16, weights={3: 3.0})
    got = df.select("doc_id", sharding.place(df.doc_id, a).alias("a"), sharding.place(df.doc_id, b).alias("b")).collect()
    moved = [(r.a, r.b) for r in got if r.a != r.b]
    assert moved and all(y < 8 for _, y in moved)  # only into the region whose weight grew
    assert all(y == 3 for x, y in moved if x < 4)  # within the rack, only into the shard
    share = sum(r.b == 3 for r in got) / 6000
    assert abs(share - 3 / 18) < 0.03


def test_place_matches_brute_force(spark):
    tree = sharding.tree(11, weights={2: 0.0, 5: 2.5})

    def walk(key, node):
        while node.children:
            def draw(c):
                if c.weight <= 0:
                    return math.inf
                h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
                h = xxhash.xxh64_intdigest(c.name.encode(), h)
                return -math.log(((h >> 11) + 1) / (1 << 53)) / c.weight

            node = min(node.children, key=draw)
        return node.shard

    got = spark.range(500).select("id", sharding.place(F.col("id"), tree).alias("s")).collect()
    assert [r.s for r in got] == [walk(r.id, tree) for r in got]
    assert 2 not in {r.s for r in got}


def test_very_long_texts_ties_and_nulls(spark):
    long = "é" * 3_000_000
    rows = [(1, long), (1, long), (2, None), (None, ""), (None, None), (3, "x")]
    got = sharding.shard(spark, spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, shard string"), sharding.tree(4), sharding.tree(4, grown=1)).collect()
    want = sorted((i or 0, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert len({r.shard for r in got if r.doc_id == 1}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_empty(spark):
    assert sharding.shard(spark, spark.createDataFrame([], SCHEMA), sharding.tree(3)).collect() == []
