"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws ``-ln(u) / weight`` with u hashed from the key
and the child's name, and the smallest draw wins, so children get shares in proportion to weights and a change of one
weight moves rows only into or out of that child's subtree.  Growth by one shard adds a region of its own: no older
draw changes, so rows move only into the new shard.

The tree is a column expression (11 hashes a row for 40 shards).  Slots are gapless within a shard: rows are ranked in
small blocks and each block's base is a prefix sum over block counts, so no task sorts a whole shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polygate.llm.common import Staged

#: Rows that a block of slots holds on average.
BLOCK = 250_000


@dataclass(frozen=True)
class Node:
    """A named node; leaves carry a shard number and a weight, inner nodes the sum of their children's weights."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    leaf_weight: float = field(default=1.0)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def tree(shards: int = 40, per_rack: int = 4, per_region: int = 8, weights: dict[int, float] | None = None, grown: int = 0) -> Node:
    """A tree of ``shards`` shards in racks and regions, and ``grown`` more shards in a region each."""
    w = weights or {}
    regions = []
    for a in range(0, shards, per_region):
        racks = []
        for b in range(a, min(a + per_region, shards), per_rack):
            leaves = tuple(Node(f"shard-{s}", shard=s, leaf_weight=w.get(s, 1.0)) for s in range(b, min(b + per_rack, shards)))
            racks.append(Node(f"rack-{b}", leaves))
        regions.append(Node(f"region-{a}", tuple(racks)))
    for s in range(shards, shards + grown):
        leaf = Node(f"shard-{s}", shard=s, leaf_weight=w.get(s, 1.0))
        regions.append(Node(f"region-{s}", (Node(f"rack-{s}", (leaf,)),)))
    return Node("root", tuple(regions))


def _draw(key: Column, node: Node) -> Column:
    """An exponential draw with the node's weight as rate; infinite for weight 0."""
    if node.weight <= 0:
        return F.lit(float("inf"))
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11) + 1) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(node.weight))


def place(key: Column, node: Node) -> Column:
    """The shard of a key, as an int column."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))["i"]
    below = [place(key, c) for c in node.children]
    if all(not c.children for c in node.children):
        return F.element_at(F.array(*below), best + 1)
    # transform over one element evaluates the draws once for all branches
    out = F.transform(F.array(best), lambda i: _branch(i, below))
    return F.element_at(out, 1)


def _branch(i: Column, below: list[Column]) -> Column:
    out = F.when(i == 0, below[0])
    for k, b in enumerate(below[1:], 1):
        out = out.when(i == k, b)
    return out


def shard(spark: SparkSession, docs: DataFrame, now: Node, grown: Node | None = None, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    The law is ``key``: doc_id and the tree decide, so rows that repeat a doc_id share a shard, as do all null ids.
    A null text has the size of the overhead and crc 0, as an empty one.  Slots number a shard's rows from 0 without
    gaps, in no promised order.  ``grown_shard`` is the shard under ``grown``, null without it.  Very long texts count
    with all their bytes; only their size and CRC are moved.  An empty table gives an empty one.
    """
    stage = Staged(spark)
    key = F.col("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id",
        (F.octet_length("text").cast("long") + overhead).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        place(key, now).cast("int").alias("shard"),
        (place(key, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
    )
    rows = stage.save(rows, "placed")  # from here on "part" is data, the same on every read
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(blocks)))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    base = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("rank", rank).join(base, ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), "grown_shard")
