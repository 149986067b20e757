"""Connected components over an edge table, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (a long, b long). Returns (node, label): the smallest node of its component.

    Each round is joins and a minimum with map-side combine, so a hot centre costs no more than its
    edges; the labels are written between rounds. Null ends and self-loops are ignored.
    """
    edges = edges.where("a <> b")
    both = Written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = Written(both.read().groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        old = labels.read()
        near = both.read().join(old.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = old.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        parent = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(parent, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("was")).alias("changed"))
        after = Written(jumped)
        labels.drop()
        labels = after
        if not after.read().where("changed").limit(1).count():
            both.drop()
            return after.read().select("node", "label")
