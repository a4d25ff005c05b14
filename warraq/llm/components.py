"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, saved


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b), the root being the component's least node.

    Labels spread to neighbours and then jump to the label of their label, so that
    rounds grow with the logarithm of a component's width. Each round is written to
    the shared folder; only its number of changes comes to the driver.
    """
    both = links.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = saved(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = saved(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")).withColumn("fresh", F.lit(True)), "labels")
    while True:
        # only labels that the last round changed are news to the neighbours
        news = labels.where("fresh").select(F.col("node").alias("other"), F.col("root").alias("r"))
        near = both.join(news, "other").groupBy("node").agg(F.min("r").alias("r"))
        spread = labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        spread = saved(spread, "spread")
        # a root is always a node, so that the jump finds it; only roots that have one themselves are looked up
        roots = spread.select("root").distinct()
        jump = labels.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("up")).join(roots, "root", "left_semi")
        new = join_hot(spread, jump, "root", "left").select("node", "old", "root", F.coalesce("up", "root").alias("up")).select("node", F.least("root", "up").alias("root"), (F.least("root", "up") < F.col("old")).alias("fresh"))
        labels = saved(new, "labels")
        if not labels.where("fresh").limit(1).count():
            return labels.select("node", "root")
