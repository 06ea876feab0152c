"""Merkle trees (RFC 6962): leaves are hashed with the prefix 00, nodes with 01."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.session import cut_lineage


def leaf(payload_hash: Column) -> Column:
    """Leaf hash (hex) of a ``sha256:`` token's digest."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex(F.substring(payload_hash, 8, 64))), 256)


def node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def _up(level: DataFrame, keys: list[str]) -> DataFrame:
    """The next level: pairs are hashed, an odd last node rises as it is."""
    pairs = level.groupBy(*keys, F.floor(F.col("index") / 2).cast("bigint").alias("index_")).agg(F.min_by("hash", "index").alias("l"), F.max_by("hash", "index").alias("r"), F.count(F.lit(1)).alias("n"))
    return pairs.select(*keys, F.col("index_").alias("index"), F.when(F.col("n") == 1, F.col("l")).otherwise(node(F.col("l"), F.col("r"))).alias("hash"))


def roots(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Root of each key's tree: keys, root, n. leaves: keys, index (from 0, without holes), hash.

    Level by level, each a grouping by half the index, so a tree of n leaves takes
    log2 n shuffles of a halving size and no task sees a whole tree. Lineage is cut
    every eight levels. Keys without leaves have no row.
    """
    top = leaves.groupBy(*keys).agg((F.max("index") + 1).alias("n"))
    most = top.agg(F.max("n")).first()[0] or 0
    level, depth = leaves.select(*keys, "index", "hash"), 0
    while (1 << depth) < most:
        level, depth = _up(level, keys), depth + 1
        if depth % 8 == 0:
            level = cut_lineage(level)
    return level.select(*keys, F.col("hash").alias("root")).join(top, keys)


def included(leaf_hash: Column, index: Column, size: Column, proof: Column) -> Column:
    """The root a proof (array of hex hashes) leads to; null if index or proof don't fit the tree's size."""
    start = F.struct(index.cast("bigint").alias("f"), (size - 1).cast("bigint").alias("s"), leaf_hash.alias("r"))

    def step(a: Column, p: Column) -> Column:
        odd = a["f"].bitwiseAND(F.lit(1)) == 1
        onto_right = odd | (a["f"] == a["s"])
        # on the right edge all levels at which the node had no sibling are skipped
        zeros = F.when(onto_right & ~odd & (a["f"] != 0), F.length(F.regexp_extract(F.bin(a["f"]), "(0*)$", 1))).otherwise(0)
        down = lambda x: F.floor(x / F.pow(F.lit(2), zeros + 1)).cast("bigint")
        return F.struct(down(a["f"]).alias("f"), down(a["s"]).alias("s"), F.when(onto_right, node(p, a["r"])).otherwise(node(a["r"], p)).alias("r"))

    end = F.aggregate(proof, start, step)
    return F.when((index >= 0) & (index < size) & (end["s"] == 0), end["r"])
