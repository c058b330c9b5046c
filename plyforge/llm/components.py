"""Connected components of an edge table by alternating large-star and small-star steps, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm import common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge in ``edges`` (a, b: longs without nulls).

    Each round is written to the shared folder, so that lineage stays short. The minimum of a node's neighbours is taken
    by partial aggregation and written as well: edges then meet it in a plain join of two tables, which adaptive execution
    splits where a node is hot, or broadcasts where the minima are few.
    Rounds grow as the logarithm of the longest path; the result is checked for stillness, and an error is raised if
    ``most_rounds`` don't bring it.
    """
    now = common.saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u points to the least of u and its neighbours.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.saved(large.where("u <> v").distinct(), "large-star")
        # Small star: of every u, the smaller neighbours and u itself point to the least of them.
        least = common.saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = common.saved(small.distinct(), "small-star")
        # Still, if nobody is both a child and a root and each child has one root: then all are stars.
        still = after.groupBy("u").count().where("count > 1").isEmpty() and after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        now = after
        if still:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components are not still after {most_rounds} rounds")
