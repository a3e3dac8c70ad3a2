"""Connected components for duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the component's smallest node. Labels spread and jump until they rest."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("r")).select("node", F.least("node", "r").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        met = labels.join(near, "node").select("node", F.least("root", "seen").alias("next"), "root")
        over = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = checkpointed(met.join(over, "next", "left").select("node", F.coalesce(F.least("next", "far"), "next").alias("root"), F.col("root").alias("old")))
        if not new.where("root <> old").head(1):
            return new.select("node", "root")
        labels = new.select("node", "root")
