"""Components of an edge table, and chains of merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources.tables import checkpointed


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that can be reached), for nodes and undirected edges (a, b).

    Each round takes the least label among neighbours, then the label's own label (pointer jumping), so long chains
    shorten by more than a half each time. Rounds are checkpointed in the shared folder, and end when no label changes.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct())
    labels = nodes.select(F.col(node).alias("node"), F.col(node).alias("label")).distinct()
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        once = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = once.select(F.col("node").alias("at"), F.col("low").alias("jumped"))
        new = once.join(jump, F.col("low") == F.col("at"), "left").select("node", F.col("label").alias("was"), F.least("low", F.coalesce("jumped", "low")).alias("label"))
        new = checkpointed(new)
        changed = not new.where("label <> was").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels.select(F.col("node").alias(node), F.col("label").alias("component"))
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def merge_targets(merges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """source, target: where a chain of merges (source, target) ends; null for a chain that runs in a circle."""
    one = merges.select("source", F.col("target").alias("__next"))
    found = merges.select("source", "target", F.lit(False).alias("done"))
    for _ in range(most_rounds):
        step = found.join(one.withColumnRenamed("source", "__s"), F.col("target") == F.col("__s"), "left")
        found = checkpointed(
            step.select(
                "source",
                F.when(F.col("target") == F.col("source"), F.lit(None)).when(F.col("__next").isNull(), F.col("target")).otherwise(F.col("__next")).alias("target"),
                (F.col("target").isNull() | F.col("__next").isNull()).alias("done"),
            )
        )
        if found.where("not done").isEmpty():
            break
    return found.select("source", F.when(F.col("done"), F.col("target")).alias("target"))
