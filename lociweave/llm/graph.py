"""Connected components of an edge table by minimum labels and pointer jumping, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges: a, b (long). Returns node, label for every node of an edge: the least node of its component.

    With rounds, stops after so many: equal labels then still mean one component, different ones may not mean two.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    done = 0
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "m").alias("next"))
        # A node's label is a node too: follow it once.
        via = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = step.join(via, "next").select("node", "label", F.least("next", "far").alias("new"))
        step = materialize(step)
        done += 1
        changed = step.where("new <> label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed or done == rounds:
            return labels
