"""Where intermediate tables go, joins on keys that may be hot, and how Arrow text columns are seen as bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised operators look at together.
BLOCK_BYTES = 1 << 20
#: Rows, of a few numbers each, that are sent to every task at most; beyond, they are joined by shuffle.
SENT = 1_000_000
#: A key of fewer rows is never dealt out over several tasks.
LEAST_HOT = 500

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    In a local session, as in tests, a temporary folder of this machine is set where the setting is absent; on a
    cluster its absence is an error, as executors would each write to a folder of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-folioframe-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder; it is removed when the driver's Python ends, unless it was before."""
    path = f"{shared_dir(spark)}/folioframe/{what}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def stash(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet under the shared folder and read again: lineage ends here.

    Lost executors cost no more than the reading, and later steps need not run the earlier ones anew.
    """
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, what))
    return spark.read.schema(df.schema).parquet(path)


def remove(paths: list[str]) -> None:
    """Delete paths that ``scratch`` gave."""
    for path in paths:
        if spark := _written.pop(path, None):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Intermediate tables of one job: ``stash`` writes them, leaving the ``with`` removes all but those to ``keep``."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Tables:
        return self

    def stash(self, df: DataFrame, what: str) -> DataFrame:
        out = stash(df, what)
        self.paths.append(next(reversed(_written)))
        return out

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        """Written like the others, and left to the caller."""
        return stash(df, what)

    def drop(self) -> None:
        """Remove what has been written so far."""
        remove(self.paths)
        self.paths = []

    def __exit__(self, *_: object) -> None:
        self.drop()


@atexit.register
def _tidy() -> None:
    try:
        remove(list(_written))
    except Exception:  # the session may be gone already, and its folder with it
        return


def few(df: DataFrame) -> bool:
    """Whether its rows, of one or two short values each, are few enough to be sent to every task; they are counted."""
    return df.limit(SENT + 1).count() <= SENT


def sized(df: DataFrame) -> DataFrame:
    """With the broadcast hint if it is ``few``."""
    return F.broadcast(df) if few(df) else df


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], by: Column, n: str = "k", hint: str | None = None) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has a row for each key and the count ``n`` of the key's rows in big.

    A key of more rows than an average partition is dealt out over several, by a hash of ``by``, and its row of
    ``small`` goes to each of those. There are fewer hot keys than partitions, so their list is broadcast. A ``hint``
    of the join's kind keeps that from changing with the size of ``small``.
    """
    spark = big.sparkSession
    total = small.agg(F.sum(n)).head()[0] or 0
    limit = max(LEAST_HOT, int(total) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = F.ceil(F.col(n) / limit).cast("int")
    hot = small.where(F.col(n) > limit).select(*keys, parts.alias("_parts"))
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts").cast("bigint")), F.lit(0).cast("bigint"))).drop("_parts")
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)))
    return dealt.join(copies if hint is None else copies.hint(hint), [*keys, "_part"]).drop("_part")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, at


def blocks(column: pa.Array, most: int = BLOCK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows in runs of about ``most`` bytes (one row at least) and at most ``rows``: (first, end, bytes, offsets from 0)."""
    data, at = utf8(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        j = j if rows is None else min(j, i + rows)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
