"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise


def _state(e: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether they are stars round smallest nodes: a node is a leaf once, or a centre."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    seen = ends.groupBy("v").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    rows, wrong = seen.agg(F.coalesce(F.sum("leaf"), F.lit(0)), F.coalesce(F.sum((F.col("leaf") + F.col("centre") > 1).cast("int")), F.lit(0))).first()
    return rows, wrong == 0


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (a, b) but the roots; a root is its component's smallest node.

    The centre of a star isn't gathered in a task. Only edge tables move between executors; each round is written to the
    shared folder. The rounds end as soon as the edges are stars, before the first if they are so already. An error is
    raised if ``most_rounds`` aren't enough.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        rows, stars = _state(e)
        if stars:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = hot_join(both.where("b > a"), low, "a", 2 * rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        # A centre with a larger number than its neighbours is one node with many links here.
        small = hot_join(large, low, "a", rows)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = materialise(small.distinct(), "edges")
    raise RuntimeError("components did not settle")
