"""Connected components by alternating large and small stars; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the smallest of all of them.

    The smallest is a partial aggregation joined back, so a node with very many neighbours is
    split like any hot join key.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.join(low, "a")
    if large:
        out = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of (a, b), component being the smallest id reachable.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest
    path. Ends when the set of links no longer changes (its size and hash sum are compared).
    """
    stars = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    while True:
        stars = materialize(_star(_star(stars, True), False), "links")
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    roots = stars.select(F.col("b").alias("id")).distinct()
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))
