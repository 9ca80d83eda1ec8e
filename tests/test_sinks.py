"""Writers and readers of files."""

from folioframe.sources import sinks
from folioframe.streaming import incremental


def test_parts_and_tables(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"doc-{k // 2}") for k in range(6)], "page long, part_name string")
    sinks.write_parts(pages, f"{tmp_path}/parts")
    assert sorted(p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()) == [f"part_name=doc-{k}" for k in range(3)]
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 2, "d")], "table int, row int, col int, text string")
    sinks.write_tables(cells, f"{tmp_path}/tables", 2)
    assert {(r.c1, r.c2) for r in spark.read.csv(f"{tmp_path}/tables", header=True).collect()} == {("a", "b"), (None, "d")}


def test_tables_of_any_width_and_texts_that_need_quotes(spark, tmp_path):
    cells = [(1, 1, k, f"x{k}") for k in range(1, 201)] + [(1, 2, 150, 'say "a, b"'), (2, 1, 1, "line\nend"), (2, 3, 2, None), (2, 3, 1, "")]
    sinks.write_tables(spark.createDataFrame(cells, "table int, row int, col int, text string"), f"{tmp_path}/tables")
    first, second = (spark.read.csv(f"{tmp_path}/tables/table={k}", header=True, multiLine=True, escape='"').collect() for k in (1, 2))
    assert len(first[0]) == 200 and first[0]["c200"] == "x200" and first[1]["c150"] == 'say "a, b"' and first[1]["c1"] is None
    assert [tuple(r) for r in second] == [("line\nend", None), (None, None)]
    assert len(list((tmp_path / "tables" / "table=1").glob("*.txt"))) == 1


def test_outline_file(spark, tmp_path):
    (tmp_path / "o.txt").write_text("One\t1\n\tTwo\t3\n\n\tno page\nBad\t0\n")
    rows = sinks.outline_rows(spark, str(tmp_path / "o.txt")).orderBy("ord").collect()
    assert [(r.depth, r.title, r.page, r.ok) for r in rows] == [(0, "One", 1, True), (1, "Two", 3, True), (1, "", None, False), (0, "Bad", 0, False)]


def test_inventory_and_kinds(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.txt").write_text("x")
    assert {r.kind for r in sinks.file_inventory(spark, str(tmp_path)).collect()} == {"pdf", "text"}
    df = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"none"),)], "content binary")
    assert [r.k for r in df.select(sinks.kind_by_content(df.content).alias("k")).collect()] == ["pdf", None]


def test_stream_takes_the_newest(spark, tmp_path):
    schema = "k long, ts long, v string"
    for i, rows in enumerate([[(1, 5, "new"), (2, 1, "a")], [(1, 3, "late"), (2, 2, "b")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log.parquet")
        del i
    stream = incremental.file_stream(spark, str(tmp_path), "log", 1)
    out = incremental.run_to_table(incremental.newest_revisions(stream, "k", ["ts"], ["ts", "v"]), f"{tmp_path}/out")
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "new"), (2, "b")]
