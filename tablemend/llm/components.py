"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node in ``links`` (a, b): the smallest node it can reach.

    Each round takes the smallest label among neighbours, then the label of that label, and is
    written to the shared folder; rounds end when no label changes.  Nothing but that count
    reaches the driver.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct())
    state = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        least = state.union(near).groupBy("node").agg(F.min("label").alias("label"))
        least = cut_lineage(least)
        beyond = least.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = cut_lineage(least.join(beyond, "label", "left").select("node", F.least("label", "beyond").alias("label")))
        moved = after.join(state.withColumnRenamed("label", "before"), "node").where("label != before")
        if moved.isEmpty():
            return after
        state = after
