"""Connected components of an undirected graph, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node it reaches) for all ends of ``edges`` (a, b: long).

    Each round hooks every node to the least label around it and then halves the way to the root, so
    long chains close in a logarithmic number of rounds. Messages are combined before the shuffle,
    and no list of neighbours is ever built, so a node with very many edges costs no more memory.
    """
    pairs = edges.select("a", "b").where("a <> b").distinct()
    both = cut_lineage(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        # The least label of the neighbours, for the node and for the root it hangs on.
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("to"))
        roots = hooked.groupBy(F.col("label").alias("root")).agg(F.min("to").alias("root_to"))
        step = cut_lineage(
            hooked.join(roots, F.col("label") == F.col("root"))
            .select("node", F.col("label").alias("was"), F.least("to", "root_to").alias("label"))
        )
        upper = step.select(F.col("node").alias("parent"), F.col("label").alias("above"))
        after = cut_lineage(
            step.join(upper, F.col("label") == F.col("parent"), "left").select("node", "was", F.least("label", "above").alias("label"))
        )
        changed = not after.where("label <> was").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels
