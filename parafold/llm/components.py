"""Connected components by alternating large and small stars.

Every step is a pair of DataFrame joins on written tables, so that a hub that
many edges share is split over tasks as a skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _star(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """Link what is around each node ``u`` to the least node there.

    ``edges`` are (u, v); of the large star v > u is linked, of the small star,
    whose edges all have v < u, everything is.
    """
    least = work.save(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}_least")
    return edges.join(least, "u")


def _stars(pairs: DataFrame) -> bool:
    """Whether each node of ``pairs`` (a, b) is a root or has one root: then no step changes anything."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("below")), F.struct(F.col("b").alias("u"), F.lit(0).alias("below")))).alias("e")
    nodes = pairs.select(ends).groupBy("e.u").agg(F.sum("e.below").alias("below"), F.min("e.below").alias("least"))
    return nodes.where("below > 1 OR below = 1 AND least = 0").isEmpty()


def components(edges: DataFrame, work: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node.

    Loops and nulls are left out; a node without edges has no row.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = work.save(pairs, f"{name}_0")
    step = 0
    while not _stars(pairs):
        step += 1
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, work, f"{name}_{step}l").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = work.save(large, f"{name}_{step}l")
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), work, f"{name}_{step}s")
        linked = small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = work.save(linked.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct(), f"{name}_{step}")
        work.drop(f"{name}_{step - 1}", f"{name}_{step}l", f"{name}_{step}l_least", f"{name}_{step}s_least")
        pairs = after
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
