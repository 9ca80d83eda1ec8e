"""Reading the corpus tables. Spark's Parquet reader prunes columns and takes the filters down by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition that windows and sorts hold at once.
PART_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, keys: list[str], n_rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows dealt out by ``keys``, to more partitions as they grow, so that a task's memory does not.

    Windows, groupings and joins by these keys, and windows and groupings by more, go on from there without a shuffle.
    """
    return rows.repartition(max(n_rows, 0) // part_rows + 1, *keys)
