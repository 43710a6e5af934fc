import hashlib
import random

import numpy as np
import pytest

from polygate.llm import suffix_dedup

SCHEMA = "doc_id long, text string, first string, spans string"


def brute(rows, length):
    """rows: (doc_id, text) in the order of positions."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        cut = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                cut[p : p + length] = True
            seen.add(w)
        n_spans = int((cut[1:] & ~cut[:-1]).sum() + (cut[:1].sum()))
        kept = bytes(np.frombuffer(data, np.uint8)[~cut])
        out.append((doc, len(data), int(cut.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(rng, n):
    words = ["".join(rng.choices("abcdeéñ", k=rng.randrange(1, 9))) for _ in range(200)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    line, passage = say(14), say(60)
    out = []
    for i in range(n):
        t = say(rng.randrange(1, 120))
        if i % 3 == 0:
            t += " " + passage
        if i % 4 == 1:
            t = line + " " + t
        if i % 7 == 2 and out:
            w = rng.choice(out).split(" ")
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        if i % 9 == 3 and out:
            t = rng.choice(out)
        if i % 11 == 5:
            t = t + " " + "ab" * 200 + t
        out.append(t)
    return out


@pytest.mark.parametrize("length", [100, 24])
def test_matches_brute_force(spark, length, monkeypatch):
    rng = random.Random(length)
    rows = list(enumerate(["", "short", "x" * length, "x" * (length + 3), *texts(rng, 70)]))
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in reversed(rows)], SCHEMA).repartition(3)
    got = suffix_dedup.remove_repeats(spark, df, length).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, length)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_null_ids_repeats_and_empty(spark):
    a, b = "lorem ipsum " * 20, "dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna"
    df = spark.createDataFrame([(None, b, None, None), (None, b, None, None), (1, b, None, None), (1, a, None, None), (1, a, None, None), (2, None, None, None)], SCHEMA)
    got = suffix_dedup.remove_repeats(spark, df, 100, keep_bytes=False).collect()
    assert len(got) == 6 and all(r.kept is None for r in got)
    assert sorted(r.n_removed for r in got if r.n_bytes == len(b)) == [0, len(b), len(b)]
    assert sorted(r.n_removed for r in got if r.n_bytes == len(a)) == [len(a) - 12, len(a)]
    assert suffix_dedup.remove_repeats(spark, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("family", [0, 1])
def test_ranks_name_contents(family):
    rng = random.Random(family)
    data = np.frombuffer("".join(rng.choices("ab", k=600)).encode(), np.uint8)
    lengths = (1, 2, 3, 7, 8, 25, 91, 100, 128)
    for n, rank in zip(lengths, suffix_dedup.ranks(data, lengths, family), strict=True):
        assert len(rank) == len(data) - n + 1
        content = [data[i : i + n].tobytes() for i in range(len(rank))]
        names = {}
        assert all(names.setdefault(c, r) == r for c, r in zip(content, rank.tolist())) and len(set(names.values())) == len(names)
    at4, at8 = suffix_dedup.ranks(data, (4, 8), family)
    assert (suffix_dedup.pair(at4[:-4], at4[4:], family) == at8).all()  # a rank is made from two shorter ones


def test_rounds_by_hand(monkeypatch):
    """All rounds in one process, with small chunks and ranks that tie often."""
    monkeypatch.setattr(suffix_dedup, "_OFTEN", 2)
    monkeypatch.setattr(suffix_dedup, "_FLUSH", 300)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1 << 10)
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 60)))
    length, docs = 40, {d: np.frombuffer(t.encode(), np.uint8) for d, t in rows}
    todo, found = {d: None for d in docs}, {d: [] for d in docs}
    import pyarrow as pa

    for round_ in suffix_dedup.ROUNDS:
        batches = []
        for d, s in todo.items():
            cols = {"doc": pa.array([d], pa.int64()), "text": pa.array([bytes(docs[d]).decode()])}
            if s is not None:
                cols["spans"] = pa.array([[dict(zip(("first", "last", "mark"), x)) for x in s]])
            batches.append(pa.RecordBatch.from_pydict(cols))
        made = pa.Table.from_batches(suffix_dedup._emit(round_, length)(iter(batches))).sort_by([("key", "ascending"), ("full", "ascending"), ("doc", "ascending"), ("first", "ascending")])
        todo = {}
        for out in suffix_dedup._resolve(round_ is suffix_dedup.windows)(iter(made.to_batches(max_chunksize=37))):
            for r in out.to_pylist():
                if r["state"] == 1:
                    found[r["doc"]].append((r["first"], r["last"]))
                else:
                    todo.setdefault(r["doc"], []).append((r["first"], r["last"], r["mark"]))
    got = []
    for d, t in rows:
        spans = np.array(sorted(found[d])).reshape(-1, 2)
        cuts = suffix_dedup.covered(len(docs[d]), spans, length)
        got.append((d, sum(b - a for a, b in cuts), len(cuts)))
    assert got == [(r[0], r[2], r[3]) for r in brute(rows, length)]
