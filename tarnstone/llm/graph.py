"""Connected components of an edge list, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, settled


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each component. `edges` has columns a and b of type long.

    Labels spread over edges by minimum and are then followed to the label's own label until none changes, so the number of
    rounds grows with the logarithm of the longest chain. Each round is a reliable checkpoint. Nodes of many edges, and
    labels that many nodes have, are looked up in a broadcast of bounded size. Self-loops and repeated edges do no harm.
    """
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    both = settled(both.distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(F.col("a").alias("b"), F.least("a", "m").alias("label"), "degree"))
    while True:
        near = lookup(both, labels, "b", "degree", ready=True).groupBy(F.col("a").alias("b")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "b").select("b", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        held = spread.groupBy("label").agg(F.count("*").alias("many"))
        further = held.join(spread.select(F.col("b").alias("label"), F.col("label").alias("next")), "label")
        fresh = settled(lookup(spread, further, "label", "many").select("b", "degree", "old", F.least("label", "next").alias("label")))
        labels = fresh.select("b", "label", "degree")
        if fresh.where("old <> label").isEmpty():
            return labels.select(F.col("b").alias("node"), F.col("label").alias("component"))
