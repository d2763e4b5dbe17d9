"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import discard, table


def components(edges: DataFrame) -> DataFrame:
    """v and label (smallest id of its component) for every id in ``edges`` (a, b long).

    Each round takes the smallest label among a vertex and its neighbours and then the label of that label,
    so paths halve. Rounds are written to the shared folder. Loops and repeated edges are harmless; nulls are
    left out; no edges: no rows. Grouping a hub's neighbours combines before the shuffle.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = table(edges.union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "v"), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "v")
        moved = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("further"))
        after = table(moved.join(jump, "to").select("v", F.least("to", "further").alias("label"), (F.least("to", "further") < F.col("label")).alias("changed")), "cc-labels")
        discard(labels)
        labels = after.select("v", "label")
        labels.stored_at = after.stored_at
        if after.where("changed").isEmpty():
            discard(both)
            return labels
