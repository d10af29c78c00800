"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lookup, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, longs): the least node reachable.

    Every round is a few shuffles of at most twice the edges.  A node with
    very many neighbours only ever needs their minimum, which is combined
    before the shuffle, and gets it back by a skew-safe lookup.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    for _ in range(most_rounds):
        total, *state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not total or [total, *state] == mark:
            break
        mark = [total, *state]
        # Large star: every larger neighbour of u is tied to u's least neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("w"))
        star = lookup(both, stored(least, "cc-least"), ["a"], "w", 2 * total)
        large = star.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "cc-large")
        # Small star: every smaller neighbour of u, and u, are tied to the least of them.
        n = large.count()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w"))
        star = lookup(large, stored(least, "cc-least"), ["a"], "w", n)
        small = star.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
