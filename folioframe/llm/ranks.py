"""Ranks within groups of any size: rows are sorted by ranges, so that one group may lie in many partitions.

A window over a group would bring a third of all rows into one task where one key holds them. Here the rows of a
group are pieces, one for each range partition that holds some; only the pieces, of a count each, meet in windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.shared import Tables


def sort_rows(df: DataFrame, group: list[str], order: list[str], own: Tables) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of ``df`` sorted by group and order, nulls first; ties are ordered as they come in.

    rows have a place ``_m``, ascending in that order, and the partition ``_pid``; pieces (group, _pid) have its
    first place, how many rows of the group stand before it, and the group's count ``n``. ``df`` should be a written
    table: finding the ranges reads it once more.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order, "_tie"]
    apart = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    rows = own.stash(apart.drop("_tie").withColumn("_m", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_m", 33)), "sorted")
    counts = rows.groupBy(*group, "_pid").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_k"))
    in_group = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_k").over(in_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = counts.select(*group, "_pid", "_first", before.alias("_before"), F.sum("_k").over(in_group).alias("n"))
    return rows, own.stash(pieces, "pieces")


def with_ranks(rows: DataFrame, pieces: DataFrame, group: list[str]) -> DataFrame:
    """The rows with ``rank``, from 0 within the group, ``n``, and whatever else the pieces carry.

    A piece has no more rows than its partition, so the join is even; null groups meet as well.
    """
    renamed = pieces.select(*(F.col(c).alias(f"_of_{c}") for c in group), F.col("_pid").alias("_of_pid"), *(c for c in pieces.columns if c not in {*group, "_pid"}))
    same = F.col("_pid") == F.col("_of_pid")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = rows.join(renamed, same).withColumn("rank", F.col("_m") - F.col("_first") + F.col("_before"))
    return out.drop("_m", "_pid", "_first", "_before", "_of_pid", *(f"_of_{c}" for c in group))
