"""The folder that driver and executors share, for tables between steps and checkpoints of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, see ``ensure_checkpoints``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        ensure_checkpoints(spark)
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Have a checkpoint folder set: that of the cluster, or a temporary one in a local session (elsewhere an error)."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-folioframe-"))


def written(rows: DataFrame, what: str) -> DataFrame:
    """The rows written in the shared folder and read again: what several steps read is worked out once."""
    rows.write.parquet(path := shared_folder(rows.sparkSession, what))
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
