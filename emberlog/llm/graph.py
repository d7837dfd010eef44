"""Connected components by contraction, in joins of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the
    smallest node of the component.

    Each round, every node points to its smallest neighbour below it, pointers
    are doubled until they end at nodes without one, and the edges are
    rewritten between those. Rounds are few: a chain folds within one.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    roots = stage(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    )
    while not edges.isEmpty():
        up = stage(edges.groupBy("a").agg(F.min("b").alias("up")))
        while True:
            over = up.select(F.col("a").alias("up"), F.col("up").alias("over"))
            up = stage(up.join(over, "up", "left").select("a", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
            moved = not up.where("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break
        roots = stage(
            roots.join(up.withColumnRenamed("a", "root"), "root", "left")
            .select("node", F.coalesce("up", "root").alias("root"))
        )
        left = up.select("a", F.col("up").alias("ra"))
        right = up.select(F.col("a").alias("b"), F.col("up").alias("rb"))
        edges = stage(
            edges.join(left, "a", "left").join(right, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x != y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        )
    return roots
