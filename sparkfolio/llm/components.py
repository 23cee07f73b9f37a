"""Connected components of an edge table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): label is the smallest node of the component; nodes without edges are left out.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label.
    Labels are aggregated before they are shuffled, so a node with very many edges is one row of each task.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = stored(hooked, "labels")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(hooked.join(up, "label").select("node", "old", F.col("up").alias("label")), "labels")
        changed = not new.where("old <> label").isEmpty()
        dropped(hooked)
        dropped(labels)
        labels = new
        if not changed:
            dropped(both)
            return labels
