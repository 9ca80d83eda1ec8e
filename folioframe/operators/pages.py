"""Page tables: selecting, ordering, splitting, merging, numbering. All work within a document's own rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators import ranges


def renumber(pages: DataFrame, order: list, doc: str = "doc", page: str = "page") -> DataFrame:
    """Pages counted anew from 1 within each document."""
    return pages.withColumn(page, F.row_number().over(Window.partitionBy(doc).orderBy(*order)).cast("long"))


def delete(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the pages (doc, page) of ``gone``; documents that would lose all pages are left whole."""
    left = pages.join(gone, ["doc", "page"], "left_anti")
    emptied = pages.select("doc").distinct().join(left.select("doc").distinct(), "doc", "left_anti")
    return renumber(left.unionByName(pages.join(emptied, "doc", "left_semi")), ["page"])


def move(pages: DataFrame, block: Column, before: Column) -> DataFrame:
    """Pages of ``block`` stand, in their order, before page ``before``."""
    place = F.when(block, 1).when(F.col("page") < before, 0).otherwise(2)
    return renumber(pages.withColumn("_place", place), ["_place", "page"]).drop("_place")


def parts_by_marks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """With ``part`` and ``title``: a part starts at each marked page (doc, page, title), of which the first wins."""
    first = marks.groupBy("doc", "page").agg(F.min_by("title", "ord").alias("_title"))
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    joined = pages.join(first, ["doc", "page"], "left")
    return joined.withColumn("part", F.count("_title").over(w)).withColumn("title", F.last("_title", ignorenulls=True).over(w)).drop("_title")


def parts_by_size(pages: DataFrame, most: int, weight: str = "weight") -> DataFrame:
    """(doc, page, part): greedy parts of at most ``most``; a page beyond that is a part of its own."""
    listed = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", F.col(weight).cast("long").alias("w")))).alias("ps"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).cast("long").alias("part"), F.array().cast("array<struct<page:bigint,part:bigint>>").alias("out"))

    def put(acc: Column, p: Column) -> Column:
        full = (acc["sum"] > 0) & (acc["sum"] + p["w"] > most)
        part = acc["part"] + full.cast("long")
        return F.struct(F.when(full, p["w"]).otherwise(acc["sum"] + p["w"]).alias("sum"), part.alias("part"), F.concat(acc["out"], F.array(F.struct(p["page"].cast("long").alias("page"), part.alias("part")))).alias("out"))

    return listed.select("doc", F.explode(F.aggregate("ps", start, put, lambda acc: acc["out"])).alias("x")).select("doc", "x.page", "x.part")


def number_across(docs: DataFrame, order: Column, pages: str = "n_pages", start: int = 1, part_rows: int = 1_000_000) -> DataFrame:
    """With ``first`` and ``last`` numbers, each document going on where the one before stopped.

    ``order`` is a number for each document, dense or not; ranges of it of about ``part_rows`` documents are summed first.
    """
    ordered = docs.withColumn("_order", order).withColumn("_all", F.lit(0))
    bounds = ranges.range_bounds(ordered, "_order", part_rows)
    last = F.col("_last") + (start - 1)
    out = ranges.running(ordered, ["_all"], ["_order"], "_order", F.col(pages), "_last", bounds)
    return out.withColumn("last", last).withColumn("first", last - F.col(pages) + 1).drop("_order", "_all", "_last")


def labels(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """With the range (style, prefix, start, first_page) that holds for each page: the last that starts at or before it."""
    marks = spans.select("doc", F.col("first_page").alias("page"), F.struct("style", "prefix", "start", "first_page").alias("_range"))
    joined = pages.join(marks, ["doc", "page"], "left")
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("range", F.last("_range", ignorenulls=True).over(w)).drop("_range")


def combined(files: DataFrame, keys: list[str], written: Callable[[DataFrame, str], DataFrame], per_page: int = 40, width: int = 60) -> DataFrame:
    """(keys, file, title, n_pages, contents, entry_page, start): files put together behind a contents page, pages from 1.

    Files (keys, ord, file, title, n_pages) follow one another. An entry is its title and the page at which its file
    starts, broken at ``width``; the contents take as many pages as all entries fill, which moves the starts, which may
    lengthen the entries: so lengths are worked out again until none of them changes, nine times at most, of which the
    last counts (lengths that go to and fro end so).
    """
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(files.withColumn("_before", F.coalesce(F.sum("n_pages").over(w), F.lit(0))), "placed")
    lines = F.ceil(F.length(F.concat("title", F.lit(" "), (F.col("_before") + F.col("contents") + 1).cast("string"))) / width)
    lengths = placed.select(*keys).distinct().withColumn("contents", F.lit(1).cast("bigint"))
    for k in range(9):
        now = placed.join(lengths, keys).groupBy(*keys, "contents").agg(F.ceil(F.sum(lines) / per_page).alias("_now"))
        found = written(now.select(*keys, F.col("_now").alias("contents"), (F.col("_now") != F.col("contents")).alias("_moved")), f"contents-{k}")
        lengths = found.drop("_moved")
        if found.where("_moved").isEmpty():
            break
    out = placed.join(lengths, keys).withColumn("_lines", lines)
    entry = F.floor(F.coalesce(F.sum("_lines").over(w), F.lit(0)) / per_page) + 1
    return out.select(*keys, "file", "title", "n_pages", "contents", entry.alias("entry_page"), (F.col("_before") + F.col("contents") + 1).alias("start"))
