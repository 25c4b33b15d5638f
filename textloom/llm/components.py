"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, skew_join, written


#: Edges of a node that are joined in one task.
FEW = 50_000


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return skew_join(both, least, "a", 2 * total, FEW).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = skew_join(edges, least, "a", total, FEW)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a that isn't the smallest of its component, b being that smallest.

    ``edges`` has long columns a > b.  The centre of a large star is joined by broadcast, not in one task.  Nothing but edge counts and checksums reaches the driver.
    """
    now, before = written(edges.distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now
        before = state
        if not state[0]:
            return now
        stars = written(_large_star(now, state[0]), "edges")
        after = written(_small_star(stars, stars.count()), "edges")
        drop_written(stars)
        drop_written(now)
        now = after
