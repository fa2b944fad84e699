"""Connected components of a link table, in Spark (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs -> (u, v, m): m is the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
    return pairs.join(least, pairs["u"] == least["w"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _least(both).where(F.col("v") > F.col("u"))
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _least(down)
    moved = found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of any order -> ``node``, ``component`` (the smallest
    node reachable) for every node that has an edge to another one.

    An empty table gives an empty result; an edge without one of its nodes, or
    to the node itself, counts for nothing; repeated edges count once.  Each round is written to the shared folder, so a lost executor costs one
    round; the rounds are logarithmic in the longest chain.
    """
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "components")
    while True:
        after = written(_small_star(_large_star(edges)), "components")
        # both are distinct: none lost means none new
        same = after.count() == edges.count() and not edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        if same:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = after
