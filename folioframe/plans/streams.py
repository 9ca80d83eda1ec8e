"""Queries of streams, and of file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.plans import Registry
from folioframe.plans.structure import WORDS_SQL
from folioframe.sources.scratch import shared_folder
from folioframe.sources.sinks import file_inventory
from folioframe.streaming import incremental

NEEDLES = ["the", "of", "la", "der"]


def register(r: Registry) -> None:
    @r.add("z1_revision_stream", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
    def z1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Newest event of each user, from the events read as a stream."""
        newest = incremental.newest_revisions(incremental.file_stream(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])
        return incremental.run_to_table(newest, shared_folder(spark, "z1"), ["user_id"])

    @r.add("z2_search_stream", f"SELECT source, needle, count(*) AS n FROM (SELECT source, unnest({WORDS_SQL.format('text')}) AS needle FROM documents) WHERE needle IN ('the', 'of', 'la', 'der') GROUP BY source, needle")
    def z2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Counts of a few words by source, from the documents read as a stream."""
        hits = incremental.running_hits(incremental.file_stream(spark, sf_dir, "documents"), NEEDLES, "source")
        return incremental.run_to_table(hits, shared_folder(spark, "z2"), ["source", "needle"])

    @r.add("a2_file_inventory")
    def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Files of the data directory by kind; their bytes are not read."""
        return file_inventory(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
