"""Connected components of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours and then that label's own label, so labels
    travel along stars in one round and along chains in a logarithmic number.  Every round is stored; the driver sees
    only the number of labels that changed.  No links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        smaller = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        roots = labels.select(F.col("node").alias("via"), F.col("component").alias("root"))
        moved = stored(
            smaller.join(roots, "via").select("node", "old", F.least("via", "root").alias("component")), "labels"
        )
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
