"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated in each task) and a join back on the node that splits nodes of
many edges, so none is gathered; edges are written to the shared folder after each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, join_split, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node but roots; ``edges`` has columns a and b."""
    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == mark or not state["n"]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark, before = state, now
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = materialise(join_split(both, least.drop("n"), "u", least.select("u", "n"), 2 * state["n"]).filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        small = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        moved = join_split(large, small.drop("n"), "b", small.select("b", "n"), 2 * state["n"]).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        now = materialise(moved.filter("a < b").distinct())
        discard(before), discard(large)
