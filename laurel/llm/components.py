"""Connected components of a stored edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.session import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up, or only edges from below: then the upper ends are the roots."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    both = (F.sum("up") > 1) | ((F.sum("up") > 0) & (F.min("up") == 0))
    return ends.groupBy("node").agg(both.alias("both")).where("both").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Every round links each node's neighbours to its smallest neighbour (first the larger ones, then the smaller ones),
    with joins and grouped minima only; rounds are stored tables, so lost executors cost one round at most. The number
    of rounds grows with the logarithm of the longest path; the first round that leaves stars only is the last. Edges
    with a null end are ignored.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                 "edges")
    while not _are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = stored(large, "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = stored(large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                     .union(small.select("u", "m")).distinct(), "small")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
