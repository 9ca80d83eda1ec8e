"""Numbers over rows in order, by ranges, so that no window holds all rows of a large key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, by: str, part_rows: int = 1_000_000) -> list[float]:
    """Values of a numeric column that cut the table into ranges of about ``part_rows`` rows, sparse or dense."""
    parts = -(-df.count() // part_rows)
    if parts < 2:
        return []
    return sorted(set(df.approxQuantile(by, [i / parts for i in range(1, parts)], 0.25 / parts)))


def range_of(value: Column, bounds: list[float]) -> Column:
    """How many bounds are at most the value, by halving steps; null stands in range 0."""
    if not bounds:
        return F.lit(0)
    cuts, steps = F.array(*map(F.lit, bounds)), [2**k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    x = value.cast("double")
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) <= x, at + s).otherwise(at))


def running(df: DataFrame, keys: list[str], order: list, by: str, value: Column, name: str, bounds: list[float]) -> DataFrame:
    """With ``name``: the sum of ``value`` up to each row within its key; ``by`` must come first in ``order``.

    Sums of each key's ranges are added up first; a task holds one range of a key, or one row for each range.
    """
    placed = df.withColumn("_range", range_of(F.col(by), bounds))
    sums = placed.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(k).alias("_key_" + k) for k in keys), F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(before["_key_" + k]) for k in keys], placed["_range"] == before["_at"])
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.withColumn("_upto", F.sum(value).over(inner))
    out = upto.join(before, same, "left").withColumn(name, F.col("_before") + F.col("_upto"))
    return out.select(*df.columns, name)


def row_numbers(df: DataFrame, keys: list[str], order: list, by: str, name: str, bounds: list[float]) -> DataFrame:
    """With ``name``: the place of each row within its key, from 1."""
    return running(df, keys, order, by, F.lit(1).cast("bigint"), name, bounds)
