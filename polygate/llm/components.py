"""Connected components of an edge table by alternating large-star and small-star rounds.

Published as "Connected Components in MapReduce and Beyond" (Kiveris et al., 2014).  Every round is a grouped minimum
(partial sums before the shuffle) and a join of two staged tables, whose hot keys adaptive execution can split.  Edges
and labels never reach the driver; only a count and a checksum do, to see when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polygate.llm.common import Staged


def _ordered(df: DataFrame) -> DataFrame:
    """Undirected edges as (hi, lo), without loops and repeats."""
    return df.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _large_star(edges: DataFrame, stage: Staged, n: int) -> DataFrame:
    """Ties each larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").withColumnRenamed("u", "lo")
    least = stage.save(least, f"min{n}")
    out = edges.join(least, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
    return _ordered(out)


def _small_star(edges: DataFrame, stage: Staged, n: int) -> DataFrame:
    """Ties each smaller neighbour of a node, and the node, to the smallest of them."""
    least = stage.save(edges.groupBy("hi").agg(F.min("lo").alias("m")), f"low{n}")
    out = edges.join(least, "hi")
    return _ordered(out.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge, root being the smallest node of its component.

    ``edges`` has two long columns, a and b.  Empty edges give an empty table; loops and repeats don't matter.
    """
    stage = Staged(spark)
    now = stage.save(_ordered(edges.select(F.col("a").alias("hi"), F.col("b").alias("lo"))), "edges0")
    seen, n = None, 0
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if mark == seen or not mark[0]:
            break
        seen, n = mark, n + 1
        big = stage.save(_large_star(now, stage, n), f"large{n}")
        now = stage.save(_small_star(big, stage, n), f"edges{n}")
        stage.drop(f"min{n}", f"low{n}", f"large{n}", f"edges{n - 1}")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.union(now.select("lo", "lo").distinct())
