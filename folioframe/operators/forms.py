"""Form fields and comments as tables: filling, resetting, merging names, states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import ranges

FILLABLE = ["text", "check", "radio", "choice"]


def fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Fields with ``value`` from values (doc, name, new_value); read-only fields, other kinds and values outside the options stay."""
    joined = fields.join(values, ["doc", "name"], "left")
    ok = F.col("new_value").isNotNull() & ~F.col("read_only") & F.col("kind").isin(FILLABLE) & ((F.size("options") == 0) | F.array_contains("options", F.col("new_value")))
    changed = F.coalesce(ok & ~F.col("value").eqNullSafe(F.col("new_value")), F.lit(False))
    return joined.withColumn("changed", changed).withColumn("value", F.when(changed, F.col("new_value")).otherwise(F.col("value"))).drop("new_value")


def reset(fields: DataFrame) -> DataFrame:
    """Fillable fields back at their default, or empty."""
    to = F.coalesce("default", F.lit(""))
    changes = F.col("kind").isin(FILLABLE) & ~F.col("read_only") & ~F.col("value").eqNullSafe(to)
    return fields.withColumn("changed", changes).withColumn("value", F.when(changes, to).otherwise(F.col("value")))


def merged_names(fields: DataFrame) -> DataFrame:
    """With ``new_name``: the k-th document (a number) that uses a name gets name_k, from the second on."""
    k = F.col("_k")
    placed = ranges.row_numbers(fields, ["name"], ["doc"], "doc", "_k", ranges.range_bounds(fields, "doc"))
    return placed.withColumn("new_name", F.when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), k.cast("string")))).drop("_k")


def latest_state(states: DataFrame) -> DataFrame:
    """(doc, target, model, state, author): the newest state of each target and model; of equal dates the later row."""
    newest = F.max_by(F.struct("state", "author"), F.struct("modified", "idx"))
    return states.groupBy("doc", "target", "model").agg(newest.alias("s")).select("doc", "target", "model", "s.state", "s.author")
