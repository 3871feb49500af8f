"""Connected components of a graph of any size by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleryloom.llm.common import salted_join
from galleryloom.session import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of (a > b): every node hands its larger (or smaller) neighbours to its least neighbour."""
    if large:
        directed = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        directed = edges
    least = directed.groupBy("a").agg(F.min("b").alias("_least"), F.count(F.lit(1)).alias("_load"))
    least = least.withColumn("_least", F.least("_least", "a"))
    joined = salted_join(directed, least, "a", "_load", F.col("b"), "inner")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_least").alias("b"))
        return moved.where("a <> b").distinct()
    moved = joined.select(F.col("b").alias("a"), F.col("_least").alias("b"))
    kept = least.select("a", F.col("_least").alias("b"))
    return moved.union(kept).where("a <> b").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links → (node, component): the least node reachable, for every node that has a link.

    Each round is written to the shared folder, so a lost executor costs one round. The number of
    rounds grows with the logarithm of the longest chain. NULL ends and loops are ignored.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(ordered, "links")
    state = _digest(current)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        current = materialize(_star(_star(current, large=True), large=False), "links")
        following = _digest(current)
        if following == state:
            break
        state = following
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select(F.col("b"), F.col("b")).distinct())
