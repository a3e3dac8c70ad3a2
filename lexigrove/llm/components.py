"""Connected components of a graph held in DataFrames, with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.base import drop, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, jumps pointers until they rest, and contracts the graph, so
    long chains take rounds in proportion to their length's logarithm. Sums and joins are by node; a hub with very many
    neighbours is combined on the map side.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("root")))
        if not up.head(1):
            return found if found is not None else up
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = written(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            moved = bool(jumped.where("moved").head(1))
            drop(up)
            up = jumped
            if not moved:
                break
        up_ = up.select("node", "root")
        if found is None:
            found = up_
        else:
            later = up_.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = written(found.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        a = up_.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up_.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(a, "a").join(b, "b").where("ra <> rb")
        edges = written(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if not edges.head(1):
            return found
