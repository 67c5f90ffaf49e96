"""Connected components by large-star and small-star steps over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import discard, materialize

#: A key with more than this share of all rows is broadcast instead of shuffled: at most as many keys as its inverse.
HOT = 1 / 1000


def join_hot(rows: DataFrame, found: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` join ``found`` (one row a key) where the few keys of ``hot`` would land in one task: these are broadcast."""
    few = F.broadcast(hot.select(key))
    part = rows.join(few, key, "left_semi").join(F.broadcast(found.join(few, key, "left_semi")), key, how)
    return part.unionByName(rows.join(few, key, "left_anti").join(found.join(few, key, "left_anti"), key, how))


def state(edges: DataFrame) -> tuple:
    """Equal for equal sets of distinct (u, v), of any number (a sum of hashes would overflow)."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connect(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of the links (a, b): the least node it is connected to."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    seen = state(edges)
    for _ in range(most):
        if not seen[0]:
            break
        many = max(1.0, 2 * seen[0] * HOT)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        # Large star: neighbours above u hang on the least of all.
        large = join_hot(both.where("v > u"), least.drop("n"), "u", least.where(F.col("n") > many))
        large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        discard(edges, least)
        # Small star: u and the neighbours below it hang on the least of those.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(below.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        discard(large)
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
