"""Connected components of an edge table by alternating large-star and small-star steps, all of it in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import Scratch, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b. Neighbours hang below the least of them; the least is found by a partial aggregate and joined
    back, so the many edges of one node may be split over tasks."""
    if large:
        seen = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges
    least = seen.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.withColumn("m", F.least("a", "m"))
        moved = seen.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = seen.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, root for each node that has an edge and isn't the least of its component; edges: (a, b) in any order.

    Self-loops and repeated edges are ignored. Each round is written to scratch or the shared folder, so a lost executor costs a round at
    most.
    """
    store = scratch.store if scratch else materialise
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        edges = store(_star(_star(edges, True), False))
