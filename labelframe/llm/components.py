"""Distributed connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelframe.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; nodes of a component share a root, one of them.

    In each round every node takes, among itself and its neighbours, the one whose freshly salted
    hash is least, and the graph is contracted along these choices. The expected number of nodes
    falls by a constant factor whatever the shape (paths and stars alike), so rounds grow with the
    logarithm of the largest component. All steps are joins and partial ``min`` aggregates: no
    adjacency list is ever collected, and a node with very many links is only a skewed join key.
    Lineage is cut in each round in the shared checkpoint folder. Null ends are dropped.
    """
    live = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, step = None, 0
    while not live.isEmpty():
        step += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        chosen = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("root"))
        chosen = cut(chosen)
        left, right = chosen.select(F.col("node").alias("a"), F.col("root").alias("ra")), chosen.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = cut(live.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if labels is None:
            labels = chosen
        else:
            on = chosen.select(F.col("node").alias("was"), F.col("root").alias("now"))
            labels = cut(labels.join(on, labels["root"] == on["was"], "left").select("node", F.coalesce("now", "root").alias("root")))
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))
