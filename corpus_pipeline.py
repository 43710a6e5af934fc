"""From raw documents to token ids: five stages, each written as Parquet and read again before the next.

1. quality classifier: rejected documents go;
2. SimHash near-dedup: of each group of copies (five-word shingles, similarity 0.8) the smallest doc_id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. secret scans: secrets are replaced in the text, all documents stay;
5. BPE encoding and decoding: ids and their round trip.

Stages 1 to 4 return the columns of ``documents``.  Rows are followed by a hash of id and text, so each goes or stays for
its own text, whether its id is null or repeats; of rows equal in both, stage 2 leaves one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polygate.llm import bpe, decontam, quality, secret_scan, simhash
from polygate.llm.common import scratch
from polygate.llm.queries import tokenizer


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` and each row's place, by which a row is followed: ids may be null or repeat."""
    return docs.withColumn("_at", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, fitted on the labels, accepts (score 0.3 or more)."""
    scored = quality.classify(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3, rows=True)
    kept = scored.where("predicted = 1").select(F.col("at").alias("_at")).distinct()
    return _placed(docs).join(kept, "_at", "left_semi").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest doc_id's, null ids last."""
    groups = simhash.near_duplicates(spark, docs, shingle=5, max_bits=4, similarity=0.8, rows=True)
    kept = groups.where("at = keep").select(F.col("at").alias("_at")).distinct()
    return _placed(docs).join(kept, "_at", "left_semi").dropDuplicates(["_at"]).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, word for word or with other numbers, names or units."""
    rows = _placed(docs)
    found = decontam.contaminated(spark, rows.select(F.col("_at").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias("_at")).distinct(), "_at", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text by their kind."""
    return secret_scan.redacted(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes: counts and digests of ids and decoded text."""
    return bpe.round_trip(spark, docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding and decoding", bpe_round_trip),
]
#: A fitted classifier, components over any number of links and BPE have no SQL: the tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        path = scratch(spark, f"stage{n + 1}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
