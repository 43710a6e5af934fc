import random
import re

import numpy as np
import pytest
import xxhash

from polygate.llm import simhash
from polygate.llm.components import components

SCHEMA = "doc_id long, text string, lang string, fp string"


def brute_fp(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    words = ["Ärger", "THE", "of", "x", "naïve", " wide", "9", "don't"]
    texts = ["", None, "  \t\r\n", "one", "one two three", "a b c d", "a b c d " * 700]
    texts += [rng.choice([" ", "\n", "\t\x0b"]).join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(4):
            w = b.split()
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += ["", None, "   ", base[0], "tiny", "tiny"]
    rows = [(100 + i, t, None, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [brute_fp(t) for t in texts]
    want = brute_components(fps, 4)
    assert len(got) == len(rows)
    for i, f in enumerate(fps):
        assert got[100 + i].fp == (f - (1 << 64) if f >> 63 else f)
        assert got[100 + i].component_id == 100 + want[i]


def test_null_ids_repeats_and_empty(spark):
    rows = [(5, "a b c d e", None, None), (5, "a b c d e", None, None), (None, "a b c d e", None, None), (None, "lonely words here now", None, None)]
    got = sorted((r.doc_id is None, r.component_id is None) for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, False), (False, False), (True, False), (True, True)]
    assert simhash.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_lists_connect_like_all_pairs():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = []
    for c in centre:
        x = int(c) & ~0xFFFFFFFF
        for _ in range(60):
            y = x | (int(c) & 0xFFFFFFFF)
            for b in rng.integers(0, 32, 6):
                y ^= 1 << int(b)
            fps.append((int(centre[0]) & ~0xFFFFFFFF) | (y & 0xFFFFFFFF))
    fps = np.unique(np.array(fps, np.uint64))
    lists = simhash._Lists(4)
    mask = 0xFFFFFFFF00000000

    def parts(a, b):
        at = {int(f): i for i, f in enumerate(fps)}
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(at[x]), find(at[y])
            root[max(p, q)] = min(p, q)
        return [find(i) for i in range(len(fps))]

    want = brute_components([int(f) for f in fps], 4)
    assert parts(*lists.forest(fps, mask)) == want
    assert parts(*lists._midpoints(fps, mask)) == want


def test_bound_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).selectExpr("id fp"), 8)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}}


def jaccard(a, b):
    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    return len(sh(a) & sh(b)) / len(sh(a) | sh(b))


def test_similarity_links_near_copies(spark):
    rng = random.Random(5)
    texts = []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 400]))]
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.choice([1, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = [(i, t, None, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 5, 4, 0.8).collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(links) > 30
    assert [got[i] for i in range(len(texts))] == brute_groups(len(texts), links)


def test_many_pairs_near_the_bound_equal_all_pairs(spark):
    """Copies with about as many edits as the similarity allows, texts of all lengths, and one passage that many share."""
    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for g in range(260):
        n = rng.choice([5, 8, 14, 30, 60, 120, 250, 600, 2000])
        base = rng.choices(vocabulary, k=n) + (passage if g % 3 == 0 else [])
        for c in range(rng.choice([1, 3, 5, 8])):
            w = list(base)
            for _ in range(round(len(w) / 45 * rng.uniform(0.2, 1.3)) if c else 0):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    at, links = {}, set()
    sets = []
    for i, t in enumerate(texts):
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
        for s in sets[-1]:
            at.setdefault(s, []).append(i)
    seen = set()
    for some in at.values():
        for x in range(len(some)):
            for y in range(x):
                seen.add((some[x], some[y]))
    links = {(i, j) for i, j in seen if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert len(links) > 1000
    rows = [(i, t, None, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(6), 5, 4, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(len(texts), links)


def test_similarity_of_large_groups_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_GROUP", 5)  # so that groups go by their lists
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = ["", None, "  ", "one two", "one two"]
    for _ in range(25):
        w = list(base)
        for _ in range(rng.choice([3, 6, 7, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = [(i, t, None, "clash") for i, t in enumerate(texts)] + [(7, texts[7], None, None)] * 3 + [(None, texts[8], None, None)] * 2 + [(7, "other text with the id of seven", None, None)]
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 5, 4, 0.8).collect()
    assert len(got) == len(rows)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (texts[i] or "").split() == (texts[j] or "").split() or texts[i] and texts[j] and jaccard(texts[i], texts[j]) >= 0.8]
    want = brute_groups(len(texts), links)
    by = {r.fp: r.component_id for r in got}
    for i, t in enumerate(texts):
        f = simhash.fingerprint(t, 5)
        assert by[f - (1 << 64) if f >> 63 else f] == want[i]
    assert simhash.near_duplicates(spark, spark.createDataFrame([], SCHEMA), 5, 4, 0.8).collect() == []


def brute_groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_large_lists_are_compared_in_full():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 256, (3, 256), dtype=np.uint8)
    x = np.repeat(base, 1500, axis=0)
    flip = rng.random(x.shape) < 0.08
    x = np.where(flip, rng.integers(1, 256, x.shape, dtype=np.uint8), x)
    fp = np.arange(len(x))
    links = list(zip(*(c.tolist() for c in simhash._similar(fp, x, 0.775))))
    assert brute_groups(len(fp), links) == [i // 1500 * 1500 for i in range(len(fp))]


def test_equal_fingerprints_only_propose(spark):
    rng = random.Random(8)
    line = " ".join(f"l{i}" for i in range(9))
    texts = []
    for _ in range(6):
        own = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        texts.append(" ".join([*own, *[line] * 100]))
        texts.append(" ".join([*own[:60], "x", *own[61:], *[line] * 100]))
    assert len({simhash.fingerprint(t, 5) for t in texts}) < 12
    rows = [(i, t, None, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 5, 4, 0.8).collect()}
    assert got == {i: i // 2 * 2 for i in range(12)}


def test_bands_and_bound_lose_no_pair_at_the_bound():
    rng = np.random.default_rng(2)
    for union, trials in ((5, 4000), (10, 3000), (100, 2000), (5000, 300)):
        least, lost = 0.8 - 4.5 * (0.16 / simhash.Sketch.CLASSES) ** 0.5, 0
        for _ in range(trials):
            both = [d.tobytes() for d in rng.integers(0, 1 << 63, union, dtype=np.uint64)]
            a, b = simhash.Sketch(), simhash.Sketch()
            a.add(both[: union * 9 // 10] if union > 5 else both)
            b.add(both[: union * 8 // 10] + both[union * 9 // 10 :] if union > 5 else both[:4])
            x, y = a.bytes(), b.bytes()
            close = ((x == y) & (x > 0)).sum() + 1 >= least * ((x > 0) | (y > 0)).sum()
            lost += not (close and (a.keys() == b.keys()).any())
        assert lost <= trials // 1500, (union, lost)


def test_large_groups_keep_links_of_the_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_GROUP", 1)
    monkeypatch.setattr(simhash.Sketch, "keys", lambda self: np.empty(0, np.int64))  # so that only the bits propose
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(2000)]
    made = (" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(1000))
    away = lambda t: (simhash.fingerprint(t, 5) ^ simhash.fingerprint(" ".join(base), 5)).bit_count()
    texts = [" ".join(base), next(t for t in made if 0 < away(t) <= 4)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), 5, 4, 0.8).collect()
    assert {r.component_id for r in got} == {0}
