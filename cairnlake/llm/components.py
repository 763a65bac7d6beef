"""Connected components as DataFrame joins, for links that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b): the smallest node of each.

    Each round takes the least label among neighbours and then the label of
    that label, so rounds grow with the logarithm of the longest path. Labels
    are written to the shared folder after each round. Loops and repeated
    edges do no harm; null ends are dropped.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("step"))
        onward = least.select(F.col("node").alias("step"), F.col("step").alias("onward"))
        labels_next = saved(least.join(onward, "step").select("node", "was", F.col("onward").alias("component")), "labels")
        changed = labels_next.filter("was <> component").limit(1).count()
        labels = labels_next.select("node", "component")
        if not changed:
            return labels
