"""Rules over tables: each is a function from a table to issues (doc, severity, rule, page, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(df: DataFrame, where: Column, severity: int, rule: str, message: Column | str, doc: str = "doc", page: Column | None = None) -> DataFrame:
    """The rows for which ``where`` holds, as issues."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(where).select(F.col(doc).alias("doc"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), (page if page is not None else F.lit(None)).cast("bigint").alias("page"), text.alias("message"))


def report(found: DataFrame, most: int = 8) -> DataFrame:
    """At most ``most`` issues for each document and rule, then one row that says how many more there are."""
    w = Window.partitionBy("doc", "rule").orderBy(F.col("page").asc_nulls_first(), "message")
    ranked = found.withColumn("k", F.row_number().over(w))
    hidden = ranked.where(F.col("k") > most).groupBy("doc", "rule").agg(F.count(F.lit(1)).alias("n"))
    rest = hidden.select("doc", F.lit(0).alias("severity"), "rule", F.lit(None).cast("bigint").alias("page"), F.concat(F.col("n").cast("string"), F.lit(" more")).alias("message"))
    return ranked.where(F.col("k") <= most).drop("k").unionByName(rest)


def summary(found: DataFrame) -> DataFrame:
    """Counts by severity and rule, with totals."""
    return found.rollup("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("n_docs"))
