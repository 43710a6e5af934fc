import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from polygate.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, n string"


@pytest.fixture(scope="module")
def content():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def texts():
    rng = random.Random(4)
    bits = ["the", "The", " ", "  ", "\n", "don't", "'LL", "it's", "9", "12345", "½", "²", "é", "É", "naïve", "Straße", "ΣΑΣ", "Σ", "İstanbul", "日本語", "😀", "é", " ", "\x1c", "\x85", "\x00", "​", "ﬁ", "!!!", "$%^", "<|endoftext|>", "<|startoftext|>", "<|END|>", "_", "a" * 70, "zq" * 40, "internationalisation", "힣", "Ⱥ", "ǅ", "'", "''s", "x's"]
    return ["", None, " ", "a", *("".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(600))]


def test_ids_and_decoding_equal_the_library(content):
    lib = Tokenizer.from_str(content)
    vocabulary = bpe.Vocabulary(content)
    some = texts()
    words = sorted({w for t in some[:300] for p in vocabulary.split(t or "") if isinstance(p, str) for w in vocabulary.words(p)})
    lexicon = bpe.Transducer.build((w.encode(), vocabulary.merge(w.encode())) for w in words)
    for enc in (bpe.Encoder(vocabulary), bpe.Encoder(vocabulary, lexicon)):
        got = [x.tolist() for x in enc.batch(some)]
        for t, g in zip(some, got, strict=True):
            want = lib.encode(t or "", add_special_tokens=False).ids
            assert g == want, t
            assert vocabulary.decode(g) == lib.decode(want, skip_special_tokens=False)


def test_every_code_point_equals_the_library(content):
    """Alone, between letters and beside capitals; then random strings of the range that is split here."""
    lib, enc, rng = Tokenizer.from_str(content), bpe.Encoder(bpe.Vocabulary(content)), random.Random(11)
    points = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    near = ["".join(chr(rng.randrange(0x250)) for _ in range(rng.randrange(1, 24))) for _ in range(100_000)]
    for some in (points, [f"a{c}b" for c in points], [f"A{c}{c}'s{c} {c}9" for c in points], near):
        for t, g, w in zip(some, enc.batch(some), lib.encode_batch(some, add_special_tokens=False), strict=True):
            assert g.tolist() == w.ids, ascii(t)


def test_long_words_merge_alike(content):
    v, rng = bpe.Vocabulary(content), random.Random(1)
    for _ in range(60):
        w = "".join(rng.choices("aeinrst", k=rng.randrange(1, 48))).encode()
        assert v._merge_long([v.inner[b] for b in w[:-1]] + [v.last[w[-1]]]) == v.merge(w)
    assert len(v.merge(b"ab" * 30_000)) > 1


def test_words_merged_side_by_side(content):
    v, rng = bpe.Vocabulary(content), random.Random(3)
    words = ["".join(rng.choices("aeinrstñ'9", k=rng.randrange(1, 60))).encode() for _ in range(900)] + [b"", b"a", b"the", b"the"]
    lengths, ids = v.merge_many(words)
    ends = np.cumsum(lengths)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths)] == [v.merge(w) for w in words]
    assert [x.tolist() for x in v.merge_many([])] == [[], []]


def test_transducer_shares_suffixes_and_maps(tmp_path):
    rng = random.Random(2)
    stems = ["".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(300)]
    words = {(s + e).encode(): [len(s), hash(e) % 99] for s in stems for e in ("", "s", "ing", "ingly", "tion")}
    built = bpe.Transducer.build(words.items())
    (tmp_path / "x.bin").write_bytes(built.packed())
    for t in (built, bpe.Transducer.load(str(tmp_path / "x.bin"))):
        asked = [*words, b"", b"zzz", b"abq", b"x" * 100]
        ranks = t.ranks(asked).tolist()
        assert sorted(ranks[: len(words)]) == list(range(len(words))) and set(ranks[len(words) :]) == {-1}
        assert [t.outputs(r) for r in ranks[: len(words)]] == list(words.values())
    assert len(built.final) < sum(len(w) for w in words) / 3
    empty = bpe.Transducer.build([])
    (tmp_path / "e.bin").write_bytes(empty.packed())
    assert bpe.Transducer.load(str(tmp_path / "e.bin")).ranks([b"a", b""]).tolist() == [-1, -1]


def test_tables(spark, content):
    lib = Tokenizer.from_str(content)
    some = [*texts()[:200], "Əliyev ƁAƊƗ Ɛwe ƆKAN" * 3, "word Ɓ " * 120_000]
    rows = [(i, t, "x", "y") for i, t in enumerate(some)] + [(None, "a b", None, None), (3, "again", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((i if i is not None else -1, np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t, _, _ in rows)
    for n in (0, 50):
        got = bpe.encode(spark, df, PATH, n).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in got) == want
    trip = bpe.round_trip(spark, df, PATH, 50).collect()
    assert sorted(r.ids_sha256 for r in trip) == sorted(hashlib.sha256(b).hexdigest() for _, b in want)
    back = bpe.decode(bpe.encode(spark, df, PATH, 0), PATH).collect()
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in back) == sorted(r.decoded_sha256 for r in trip)
    read = bpe.decode(bpe.encode(spark, spark.createDataFrame([(1, "Hello,  World!", None, None)], SCHEMA), PATH, 0), PATH, readable=True)
    assert read.first().text == "hello , world !"
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(spark, none, PATH).collect() == [] and bpe.round_trip(spark, none, PATH).collect() == []


def test_flat_files(spark, content):
    import zlib

    lib = Tokenizer.from_str(content)
    odd = ["Əliyev ƁAƊƗ Ɛwe ƆKAN" * 3, "ȺȾ" * 9, "word Ɓ " * 120_000]  # capitals with far lower cases; a very long text
    some = [*texts()[:150], *odd]
    rows = [(1000 - i, t, "x", "y") for i, t in enumerate(some)] + [(None, "a b", None, None), (990, "again", None, None)]
    got = token_files.write_and_read(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), PATH).collect()
    assert len(got) == len(rows)
    ids = [([*lib.encode(t or "", add_special_tokens=False).ids, 2], d) for d, t, _, _ in rows]
    crc = sorted((d if d is not None else -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x, d in ids)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == crc
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_files.write_and_read(spark, spark.createDataFrame([], SCHEMA), PATH).collect() == []
