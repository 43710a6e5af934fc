import hashlib
import os
import sys

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from polygate.llm import decontam, secret_scan  # noqa: E402
from polygate.llm.queries import tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the synthetic tables are absent")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tables[-1].columns == columns and tables[-1].dtypes == docs.dtypes
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    # 1: labelled ones are kept as labelled, nearly always
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    assert sum((d in rows[1]) == bool(q) for d, q in labels.items()) > 0.95 * len(labels)
    # 2: one of each set of equal texts stays, the smallest
    first = {}
    for d in sorted(rows[1]):
        first.setdefault(rows[1][d].text.lower().split().__str__(), d)
    assert set(rows[2]) <= set(first.values()) and len(rows[2]) > 0.8 * len(first)
    # 3: just those with an item go
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    plain = lambda t: " ".join(decontam._TOKEN.sub(lambda m: "" if m.group()[0] in ".!?" else m.group(), t).lower().split())
    squeeze = lambda t: " ".join("".join(c if c.isalnum() else " " for c in plain(t)).split())
    dirty = {d for d, r in rows[2].items() if any(squeeze(t) in squeeze(r.text) for _, t in items)}
    assert set(rows[2]) - set(rows[3]) == dirty
    # 4: all stay; secrets are gone
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        assert r.text == secret_scan.redact(rows[3][d].text, secret_scan.spans(rows[3][d].text))
        assert r.n_chars == (rows[3][d].n_chars if r.text == rows[3][d].text else len(r.text))
    # 5: as the library encodes
    lib = Tokenizer.from_file(tokenizer())
    assert set(rows[5]) == set(rows[4])
    for d, r in rows[5].items():
        ids = lib.encode(rows[4][d].text, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)


def test_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 0").first()
    rows = [tuple(good), tuple(good), (None, good.text, None, None, None), (900001, None, None, None, None), (900002, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    for _, f in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), schema)
    got = sorted(r.doc_id for r in docs.collect())
    assert got.count(0) <= 1 and set(got) <= {0, 900001, 900002}
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == len(got)
    empty = spark.createDataFrame([], schema)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).collect() == []


def test_null_and_repeated_ids_keep_their_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, f in corpus_pipeline.STAGES[:3]:
        kept = spark.createDataFrame(f(spark, kept, SF).collect(), docs.schema)
    good = sorted(kept.collect(), key=lambda r: r.doc_id)[:6]
    dirty = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, *good[0][1:]), (None, *good[1][1:]), (7, *good[2][1:]), (7, *good[3][1:]), (7, *good[3][1:]), (8, *good[4][1:]), (8, good[5].text + " " + dirty, *good[5][2:]), (None, good[5].text + " x " + dirty, *good[5][2:]), (9, *good[3][1:])]
    now = spark.createDataFrame(rows, docs.schema)
    for _, f in corpus_pipeline.STAGES[:3]:
        now = spark.createDataFrame(f(spark, now, SF).collect(), docs.schema)
    assert sorted((r.doc_id or 0, r.text) for r in now.collect()) == sorted((r[0] or 0, r[1]) for r in (*rows[:4], rows[5]))
    assert corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, now, SF), SF).count() == 5
