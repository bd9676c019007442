"""Merkle trees in blocks: subtrees of 2^k leaves in one pass, stored, with a small tree over their roots.

A block is an array of 2^k hashes (64 KiB x 4 at k = 12); its subtree is an expression over that array, so no level of it is planned or shuffled by
itself. The roots of the blocks are the leaves of the level above, until one block is left: three levels at k = 12 hold 2^36 leaves. Leaves are
numbered by ranges, then dealt to blocks: these are the only shuffles of all leaves, whatever the size. What is stored are the blocks by level,
sorted by number, so the proof of a leaf reads one block of each level. A node without a partner goes up as it is, as in `attest.merkle_levels`;
roots and proofs are the same.

Defined results: an empty table has no root; a single leaf is its own root with an empty proof; equal hashes are leaves of their own; null hashes are
hashed like the empty text's digest by the caller or not at all (a tree over a null raises). Leaves that are asked for twice get one proof each time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.shared import shared_folder
from veilwork.functions.spans import let
from veilwork.operators.attest import numbered, pair

K = 12
_step = "struct<hash:string,side:string>"


def halved(hashes: Column) -> Column:
    """The next level of an array of hashes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int")), lambda i: pair(F.get(hashes, 2 * i), F.get(hashes, 2 * i + 1)))


def subtree(hashes: Column, k: int) -> Column:
    """The root of an array of at most 2^k hashes."""
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(k)), hashes, lambda level, _: halved(level)), F.lit(0))


def paths(hashes: Column, k: int) -> Column:
    """Each hash of a block of at most 2^k (at, hash, proof): the partners on its way to the block's root. The levels are made once for all."""
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), F.array(hashes), lambda ls, _: F.concat(ls, F.array(halved(F.element_at(ls, -1))))) if k > 1 else F.array(hashes)

    def step(level: Column, i: Column, at: Column) -> Column:
        place = F.call_function("shiftright", at, i)
        other = F.get(level, place.bitwiseXOR(F.lit(1)))
        return F.when(other.isNotNull(), F.struct(other.alias("hash"), F.when(place % 2 == 0, "right").otherwise("left").alias("side")))

    def own(ls: Column) -> Column:
        proof = lambda at: F.filter(F.transform(ls, lambda level, i: step(level, i, at)), lambda s: s.isNotNull())
        return F.transform(F.get(ls, F.lit(0)), lambda h, at: F.struct(at.cast("int").alias("at"), h.alias("hash"), proof(at).alias("proof")))

    return let(levels, own)


@dataclass
class Tree:
    """path/0, path/1, ... hold (block, hashes) of the levels, from the leaves up; the last level is one block."""

    spark: SparkSession
    path: str
    k: int
    leaves: int
    height: int

    def level(self, i: int) -> DataFrame:
        return self.spark.read.schema("block long, hashes array<string>").parquet(f"{self.path}/{i}")

    def root(self) -> str | None:
        row = self.level(self.height - 1).select(subtree(F.col("hashes"), self.k)).head() if self.leaves else None
        return row[0] if row else None

    def levels(self) -> int:
        """Levels of the whole tree, leaves and root included."""
        return (self.leaves - 1).bit_length() + 1 if self.leaves else 0

    def _nodes(self, i: int, wanted: DataFrame | list[int] | None) -> DataFrame:
        """(node, hash, proof) of a level: each node's proof within its block; of a list of leaves the blocks on their way alone."""
        blocks = self.level(i)
        if isinstance(wanted, list):
            blocks = blocks.filter(F.col("block").isin(sorted({j >> (self.k * (i + 1)) for j in wanted})))
        # explode() would put a filter on the array below itself, and the array would be computed for it once more.
        each = blocks.select("block", F.explode_outer(paths(F.col("hashes"), self.k)).alias("p")).filter("p is not null")
        return each.select((F.col("block") * (1 << self.k) + F.col("p.at")).alias("node"), "p.hash", "p.proof")

    def proofs(self, wanted: DataFrame | list[int] | None = None) -> DataFrame:
        """(leaf, hash, proof) of the leaves asked for: a list of numbers, whose blocks alone are read, a table with idx, or all."""
        if self.height == 0:
            return self.spark.createDataFrame([], f"leaf long, hash string, proof array<{_step}>")
        asked = None
        if wanted is not None:
            asked = self.spark.createDataFrame([(i,) for i in wanted], "leaf long") if isinstance(wanted, list) else wanted.select(F.col("idx").cast("long").alias("leaf"))
        out = self._nodes(0, wanted).withColumnRenamed("node", "leaf")
        out = out if asked is None else asked.join(out, "leaf")
        for i in range(1, self.height):
            above = self._nodes(i, wanted).select(F.col("node").alias("block"), F.col("proof").alias("more"))
            met = out.withColumn("block", F.shiftright("leaf", self.k * i)).join(above, "block")
            out = met.select("leaf", "hash", F.concat("proof", "more").alias("proof"))
        return out.select("leaf", "hash", "proof")


def _blocks(nodes: DataFrame, k: int, path: str) -> None:
    """nodes (idx, hash) as (block, hashes), sorted by block; a block has at most 2^k."""
    block = F.shiftright("idx", k).alias("block")
    whole = nodes.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("n"))
    whole.select("block", F.transform("n", lambda x: F.coalesce(x["hash"], F.raise_error(F.lit("a leaf has no hash")).cast("string"))).alias("hashes")).sortWithinPartitions("block").write.parquet(path)


def built(rows: DataFrame, order: str, hash_: str, path: str | None = None, k: int = K) -> Tree:
    """The tree over rows in order, written to path (a folder of the shared one by default, which the caller may delete)."""
    spark = rows.sparkSession
    path = path or f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    nodes, height, leaves = numbered(rows, order, hash_), 0, None
    while True:
        _blocks(nodes, k, f"{path}/{height}")
        level = spark.read.schema("block long, hashes array<string>").parquet(f"{path}/{height}")
        count = level.count()
        if leaves is None:
            leaves = level.agg(F.sum(F.size("hashes"))).head()[0] or 0
        height += 1
        if count <= 1:
            break
        nodes = level.select(F.col("block").alias("idx"), subtree(F.col("hashes"), k).alias("hash"))
    tree = Tree(spark, path, k, leaves, height if leaves else 0)
    spark.createDataFrame([(json.dumps({"k": k, "leaves": leaves, "height": tree.height}),)], "about string").coalesce(1).write.text(f"{path}/about")
    return tree


def opened(spark: SparkSession, path: str) -> Tree:
    """A tree that is there."""
    about = json.loads(spark.read.text(f"{path}/about").head()[0])
    return Tree(spark, path, about["k"], about["leaves"], about["height"])
