"""Connected components of a graph given as edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.sources.store import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Least node of its component (b) for every node (a) that is not itself the least.

    edges: columns a and b, non-null longs. Rounds go on until every edge points at a root, and
    each is stored, so losing executors never costs more than one round. The number of rounds
    grows with the logarithm of the longest path.
    """
    clean = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    if clean.isEmpty():
        return clean
    while True:
        after = stored(
            _small_star(_large_star(clean).distinct()).where("a <> b").distinct(), "edges"
        )
        # every node points at one root, and no root points further: nothing left to do
        nodes, rows = after.agg(F.count_distinct("a"), F.count("*")).first()
        inner = after.select("b").join(after.select(F.col("a").alias("b")), "b", "left_semi")
        clean = after
        if nodes == rows and inner.isEmpty():
            return clean
