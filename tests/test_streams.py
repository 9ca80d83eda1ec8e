"""Keyed tables that streams keep up to date: only altered keys are written, restarts and repeated batches change nothing."""

import tempfile

from pyspark.sql import functions as F

from folioframe.streaming import incremental as inc


def files(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, v long, ord long").coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_a_stream_in_batches_goes_on_and_writes_only_what_it_alters(spark):
    source, out = tempfile.mkdtemp(prefix="spark-in-") + "/t", tempfile.mkdtemp(prefix="spark-out-")
    files(spark, source, [[("a", 1, 1), ("b", 1, 1)], [("a", 2, 2)], [("b", 9, 0), ("c", 3, 3)]])

    def run():
        rows = spark.readStream.schema("k string, v long, ord long").option("maxFilesPerTrigger", 1).parquet(source)
        return inc.run_to_table(inc.newest_revisions(rows, "k", ["ord"], ["v"]), out, ["k"], snapshot_every=2)

    assert sorted(map(tuple, run().collect())) == [("a", 2), ("b", 1), ("c", 3)]
    files(spark, source, [[("c", 4, 4), (None, 7, 1)]])
    assert sorted(map(tuple, run().collect()), key=str) == sorted([("a", 2), ("b", 1), ("c", 4), (None, 7)], key=str)
    assert sorted(map(tuple, run().collect()), key=str) == sorted([("a", 2), ("b", 1), ("c", 4), (None, 7)], key=str)  # nothing new
    table = inc.KeyedTable(spark, out, spark.createDataFrame([], "k string, v long").schema, ["k"])
    batches = table._numbers("changes/batch")
    assert len(batches) >= 4 and table._numbers("snapshot/upto")
    written = [spark.read.parquet(f"{out}/changes/batch={n}").count() for n in batches]
    assert sum(written) <= 7 and written[-1] <= 2  # not the whole table in each batch


def test_a_batch_that_runs_again_and_one_that_broke_off(spark):
    out = tempfile.mkdtemp(prefix="spark-out-")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n long")
    table = inc.KeyedTable(spark, out, rows().schema, ["k"])
    assert table.rows().count() == 0
    table.put(rows(("a", 1), ("b", 1)), 0)
    table.put(rows(("a", 2)), 1)
    table.put(rows(("a", 2)), 1)
    table.snapshot(1)
    table.put(rows(("b", 5)), 2)
    spark.createDataFrame([("b", 99)], "k string, n long").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/changes/batch=3")
    assert sorted(map(tuple, table.rows().collect())) == [("a", 2), ("b", 5)]
    assert table.rows().agg(F.sum("n")).head()[0] == 7
