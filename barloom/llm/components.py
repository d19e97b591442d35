"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, persisted

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    A round points every node at its smallest neighbour, follows the pointers twice, and relabels the links; what
    remains between different labels is the next round's input. Hubs are met by aggregation and by plain joins of written
    tables, which adaptive execution splits where one key holds many rows; no component is gathered. Each round is written to the shared folder, and the round before it deleted.
    """
    edges = persisted(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    assign = persisted(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            return assign
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        step = persisted(step, "step")
        up = step.select(F.col("a").alias("m"), F.col("m").alias("up"))
        twice = step.join(up, "m", "left").select("a", F.coalesce("up", "m").alias("m"))
        to = persisted(twice.join(up, "m", "left").select("a", F.coalesce("up", "m").alias("to")), "step")
        moved = persisted(assign.join(to.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        left = edges.join(to, "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        right = left.join(to.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("to", "b").alias("b")).where("a <> b")
        rest = persisted(right.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        discard(step, to, assign, edges)
        assign, edges = moved, rest
    raise RuntimeError("links did not contract")
