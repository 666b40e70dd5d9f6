"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import delete_table, hot_join, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b): label is the smallest
    node reachable.  Each pass sends labels along links, then lets every node
    take its label's label; passes end when nothing changes."""
    links = links.filter("a <> b")
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        moved = materialize(moved, "moved")
        sizes = moved.groupBy("label").agg(F.count("*").alias("nodes"))
        heads = labels.select(F.col("node").alias("label"), F.col("label").alias("head")).join(sizes, "label")
        jumped = materialize(hot_join(moved, heads, "label", "nodes").select("node", "old", F.least("label", "head").alias("label")), "labels")
        delete_table(moved)
        changed = jumped.filter("old <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
