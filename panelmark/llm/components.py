"""Connected components of a graph of any size, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each linked node's component; ``links`` has columns a and b.

    Each round gives a node the smallest label among its neighbours, then the label of
    its label, so that rounds grow with the logarithm of a chain's length. Minima are
    combined before the shuffle; the join on a node with very many links is one that
    Spark's skew handling splits. Each round is written to the shared folder, which cuts the
    lineage; only the number of changed labels reaches the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = staged(both, "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy("b").agg(F.min("label").alias("near"))
        nearest = labels.join(near, labels.node == near.b).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = nearest.join(ahead, "label").select("node", "old", F.least("label", "further").alias("label"))
        moved = staged(moved, "labels")
        changed = moved.filter("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
