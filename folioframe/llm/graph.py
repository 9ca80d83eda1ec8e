"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import Tables, join_counted


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of ``edges`` (a, b).

    Each round takes the smallest label among the neighbours and then the label of that label, so that chains halve.
    Labels and edges meet in joins that deal out hubs, minima are combined in the tasks, and each round ends in a
    written table, which the next one removes.
    """
    with Tables() as own:
        both = own.stash(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
        degrees = own.stash(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("k")), "degrees")
        labels, held = own.stash(degrees.select("id", "k", F.least("id", "b").alias("component")), "labels"), Tables()
        while True:
            near = join_counted(both, labels.withColumnRenamed("id", "b"), ["b"], F.col("a")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
            now = Tables()
            lower = now.stash(labels.join(near, "id").select("id", "k", F.col("component").alias("before"), F.least("component", "near").alias("component")), "lower")
            beyond = lower.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
            jump = lower.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(beyond, "component")
            new = now.stash(join_counted(lower, jump, ["component"], F.col("id"), "n").select("id", "k", "before", F.col("beyond").alias("component")), "labels")
            held.drop()
            held, labels = now, new.select("id", "k", "component")
            if new.where("before <> component").isEmpty():
                return labels.select("id", "component")
