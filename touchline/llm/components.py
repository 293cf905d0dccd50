"""Connected components of a graph given as an edge table, by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.runtime import checkpointed


def connected(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) for every node of edges(a long, b long).

    Each round every node takes the least label among its neighbours, then the
    label of that label, so the rounds grow with the logarithm of the longest
    path. Every round is written to the checkpoint folder. A hub's edges only
    meet in a minimum (combined before the shuffle) or in a join whose other
    side has one row a node, which adaptive execution can split.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("seen"))
        step = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("up"))
        step = checkpointed(step.join(up, F.col("label") == F.col("n")).select("node", "old", F.least("label", "up").alias("label")))
        changed = step.where("old <> label").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
