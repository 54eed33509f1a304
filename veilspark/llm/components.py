"""Connected components of a graph of long ids, by least labels and pointer jumping; nothing comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of `edges` (a, b); a component is named by its least node.

    Each round gives a node the least label of its neighbours and then the label of its label, so that labels cross
    long chains in a logarithmic number of rounds. A hot node is a hot key of joins only, which Spark splits; sums are
    partial first. Each round ends in a written table.
    """
    both = kept(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        least = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "l", F.least("l", "m").alias("m"))
        # A label is a node too; what it is labelled now is smaller or the same.
        up = labels.select(F.col("node").alias("m"), F.col("l").alias("j"))
        moved = least.join(up, "m", "left").select("node", F.least("m", F.coalesce("j", "m")).alias("n"), "l")
        after = kept(moved.select("node", F.col("n").alias("l"), (F.col("n") != F.col("l")).alias("changed")), "labels")
        labels = after.select("node", "l")
        if not after.where("changed").limit(1).count():
            return labels.withColumnRenamed("l", "component")
