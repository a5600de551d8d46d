"""Connected components of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.plans.lineage import cut

MOST_ROUNDS = 40


def component_labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, label) of every node that has an edge to another; label is the smallest id of its component.

    Each round a node takes the smallest label among its neighbours and itself, then the label of that label,
    so paths shorten by half or more a round. Rounds end when none changes; each is cut to a checkpoint.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(e.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("label")))
    for _ in range(MOST_ROUNDS):
        seen = e.join(labels.select(F.col("id").alias("y"), F.col("label").alias("l")), "y").groupBy(F.col("x").alias("id")).agg(F.min("l").alias("l"))
        lower = labels.join(seen, "id").select("id", "label", F.least("label", "l").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("further"))
        lower = cut(lower.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("further", "new")).alias("new")))
        changed = lower.where("new < label").limit(1).count()
        labels = lower.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
