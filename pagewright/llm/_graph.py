"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._session import cut_pairs


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of ``edges`` (a, b: long); label is the smallest node reachable.

    Nodes that are missing from the result are their own label.

    First every node hangs on its smallest neighbour, if that is smaller, and
    its other smaller neighbours are linked to that one instead; what hangs and
    has nothing larger beside it is settled by where it hangs. On the core that
    remains, each round takes the least label among neighbours, then the label
    of that label, so that chains halve. Sums over a node's neighbours are
    combined before the shuffle, and joins may split a hot node. Rounds end in
    the shared checkpoint folder. Edges with a null end and loops link nothing.
    """
    down = cut_pairs(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    hangs = cut_pairs(down.groupBy("a").agg(F.min("b").alias("on")))
    across = down.join(hangs, "a").where("b <> on").select(F.col("b").alias("a"), F.col("on").alias("b")).distinct()
    inner = hangs.join(down.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", F.col("on").alias("b"))
    core = across.unionByName(inner).distinct()
    labels = _settle(cut_pairs(core.unionByName(core.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    leaves = hangs.join(labels.select(F.col("node").alias("a")), "a", "left_anti")
    settled = leaves.join(labels.select(F.col("node").alias("on"), "label"), "on", "left").select(F.col("a").alias("node"), F.coalesce("label", "on").alias("label"))
    return cut_pairs(labels.unionByName(settled))


def _settle(both: DataFrame) -> DataFrame:
    """Labels of a graph whose edges are there in both directions."""
    labels = cut_pairs(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        moved = cut_pairs(step.join(ahead, "label", "left").select("node", "was", F.least("label", F.coalesce("ahead", "label")).alias("label")))
        labels = moved.select("node", "label")
        if not moved.where("label <> was").head(1):
            return labels
