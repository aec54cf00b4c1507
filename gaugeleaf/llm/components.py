"""Connected components of an edge table that stays on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node it can reach) for every node of edges (a long, b long).

    Each round takes the smallest label among a node's neighbours and then the
    label's own label (pointer jumping), so long chains shrink geometrically.
    Both steps are joins with partial aggregation, which adaptive execution
    splits where one node has very many edges.  Only the number of changed
    labels reaches the driver.  Rounds are cut by tables in the shared folder.
    """
    both = materialize(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        offers = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        nearer = labels.join(offers, "node").select("node", F.col("component").alias("was"), F.least("component", "offer").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = nearer.join(target, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("was <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
