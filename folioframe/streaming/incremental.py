"""Structured Streaming: newest revisions of a log, and search counts, kept up to date as files arrive.

State is one row for each key (a revision, a count), so it grows with the keys and not with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioframe.functions.text import words


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """The table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a glob, as the stream reads folders or patterns; the table may be one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def newest_revisions(log: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key; rows that come late but are older change nothing."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return log.groupBy(key).agg(newest.alias("r")).select(key, *[f"r.{c}" for c in columns])


def running_hits(docs: DataFrame, needles: list[str], by: str) -> DataFrame:
    """(by, needle, n): how often each needle has stood as a word so far."""
    found = docs.select(by, F.explode(words(F.col("text"))).alias("needle")).where(F.col("needle").isin(needles))
    return found.groupBy(by, "needle").agg(F.count(F.lit(1)).alias("n"))


class KeyedTable:
    """A table with one row for each key that grows by changes: a folder for each batch, and snapshots now and then.

    ``changes/batch=n`` holds the rows that batch n put in or altered, ``snapshot/upto=n`` all rows as of batch n. What
    holds is the newest snapshot with later changes laid over it. A batch that runs again after a failure replaces its
    own folder, and a folder counts once its writer has marked it as whole.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str]) -> None:
        self.spark, self.folder, self.schema, self.keys = spark, folder, schema, keys

    def _numbers(self, kind: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(str(f.getPath().getParent().getName()).partition("=")[2]) for f in found)

    def put(self, rows: DataFrame, batch: int) -> None:
        """Rows that are new or altered; several rows of a key in one batch are an error of the caller's."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")

    def _newest(self, upto: int | None = None) -> DataFrame:
        spark = self.spark
        snapshots = [n for n in self._numbers("snapshot/upto") if upto is None or n <= upto]
        base = snapshots[-1] if snapshots else -1
        later = [n for n in self._numbers("changes/batch") if n > base and (upto is None or n <= upto)]
        parts = [spark.read.schema(self.schema).parquet(f"{self.folder}/snapshot/upto={base}").withColumn("_batch", F.lit(base))] if snapshots else []
        parts += [spark.read.schema(self.schema).parquet(f"{self.folder}/changes/batch={n}").withColumn("_batch", F.lit(n)) for n in later]
        if not parts:
            return spark.createDataFrame([], self.schema)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = every.groupBy(*self.keys).agg(F.max_by(F.struct(*(F.col(c) for c in rest)), "_batch").alias("_r"))
        return newest.select(*(F.col(c) if c in self.keys else F.col(f"_r.{c}").alias(c) for c in self.schema.names))

    def rows(self) -> DataFrame:
        """What holds now: one row for each key."""
        return self._newest()

    def snapshot(self, batch: int) -> None:
        """Write what holds as of a batch, so that reading lays few changes over it."""
        self._newest(batch).write.mode("overwrite").parquet(f"{self.folder}/snapshot/upto={batch}")


def run_to_table(stream: DataFrame, folder: str, keys: list[str] | None = None, snapshot_every: int = 16) -> DataFrame:
    """Run what is there in micro-batches; each writes only the keys that it altered into a ``KeyedTable``, whose rows return.

    Keys are the first column unless named. Called again with the same folder, the stream goes on where it ended, and so does the table.
    """
    table = KeyedTable(stream.sparkSession, folder, stream.schema, keys or stream.columns[:1])

    def put(df: DataFrame, batch: int) -> None:
        table.put(df, batch)
        if batch % snapshot_every == snapshot_every - 1:
            table.snapshot(batch)

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/_progress").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.rows()
