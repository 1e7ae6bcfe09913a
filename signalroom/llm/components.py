"""Connected components of a table of links, by contraction. Nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def roots(parents: DataFrame) -> DataFrame:
    """node and root, from a forest of node and a smaller parent, by pointer doubling. Roots have no row."""
    current = materialize(parents, "parents")
    while True:
        up = current.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = current.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))
        jumped = materialize(jumped, "parents")
        current = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return current.withColumnRenamed("parent", "root")


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest number reachable, for all nodes of links (a, b) but the roots."""
    spark = links.sparkSession
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    found = spark.createDataFrame([], "node bigint, root bigint")
    while not edges.isEmpty():
        step = roots(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        # what was settled before moves along, and the contracted links remain
        moved = found.join(step.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        found = materialize(moved.unionByName(step), "roots")
        a = edges.join(step.toDF("a", "ra"), "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
        b = a.join(step.toDF("b", "rb"), "b", "left").select("a", F.coalesce("rb", "b").alias("b"))
        edges = materialize(b.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return found
