"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``, long); the root is the smallest node reachable.

    Each round gives every node the smallest label among itself and its neighbours, then
    follows that label to its own label. Label chains halve, so the rounds grow with the
    logarithm of the longest path. A node with very many links is summed up inside each
    task before it is shuffled.
    """
    both = written(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = written(
            nearer.join(up, "root", "left").select("node", "before", F.least("root", F.coalesce("above", "root")).alias("root"))
        )
        labels = moved.select("node", "root")
        if moved.where("root <> before").isEmpty():
            return labels
