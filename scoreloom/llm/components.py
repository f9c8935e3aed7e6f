"""Connected components of an edge table by alternating large and small stars.

Each round joins every edge with the smallest neighbour of its node and writes the new edges to the shared
folder (``spark.checkpoint.dir``), over the table of two rounds ago, so two tables exist at a time and a lost
executor costs a re-read. Minima are combined before their exchange and written, so both sides of each join are plain
exchanges and adaptive execution can split the rows of a hub. The number of rounds grows with the
logarithm of the number of nodes, also for chains.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_folder


class Steps:
    """Written tables of a loop: each name has two places that are used in turn."""

    def __init__(self, spark):
        self.spark, self.turn = spark, {}
        self.folder = f"{checkpoint_folder(spark)}/scoreloom-steps-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.turn[name] = turn = self.turn.get(name, 0) + 1
        path = f"{self.folder}/{name}-{turn % 2}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: then the roots are found."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("below").alias("n"), F.max("root").alias("root")).filter("n + root > 1").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge ``a, b`` (longs); the root is the component's smallest node."""
    steps = Steps(edges.sparkSession)
    lower, upper = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    now = steps.write("edges", edges.filter("a <> b").select(upper, lower).distinct())
    while not _stars(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = steps.write("least", both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = steps.write("large", large.filter("a <> b"))
        least = steps.write("least", large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = steps.write("edges", small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
