"""Queries of the text-structure operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions.text import ends_sentence, header_key, words
from folioframe.operators import layout
from folioframe.plans import Registry
from folioframe.plans.scalars import LINES_SQL, lines
from folioframe.sources.tables import dealt, table

#: Characters that a task sorts.
GLYPHS = 2_000_000

ROWS_SQL = """
    SELECT doc_id AS doc, (n // 50 + 1)::BIGINT AS page, (n % 50 + 1)::BIGINT AS line, row_text FROM (
        SELECT doc_id, row_text, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS n FROM (
            SELECT doc_id, i, unnest(pieces) AS row_text, generate_subscripts(pieces, 1) AS j FROM (
                SELECT doc_id, i, CASE WHEN length(x) = 0 THEN [''] ELSE list_transform(range(0, (length(x) - 1) // 80 + 1), lambda k: substr(x, k * 80 + 1, 80)) END AS pieces FROM (
                    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))))
"""
WORDS_SQL = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paginate(table(spark, sf_dir, "documents"))


def n_chars(spark: SparkSession, sf_dir: str) -> int:
    """How many characters the documents have, to tell how many tasks their rows need."""
    return table(spark, sf_dir, "documents").agg(F.sum("n_chars")).head()[0] or 0


def glyphs(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """Each character of wrapped documents; the rows are dealt by ``keys`` before, so that characters are not shuffled."""
    return layout.glyphs(dealt(wrapped(spark, sf_dir), keys, n_chars(spark, sf_dir), GLYPHS))


def register(r: Registry) -> None:
    @r.add("a1_corpus_scan", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr' AND n_chars > 1000")
    def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Columns and filters go down to the Parquet scan."""
        return table(spark, sf_dir, "documents").where("lang = 'fr' AND n_chars > 1000").select("doc_id", "source", "n_chars")

    @r.add("w1_paginate", f"SELECT doc, page, line, md5(row_text) AS row_md5 FROM ({ROWS_SQL})")
    def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
        return wrapped(spark, sf_dir).select("doc", "page", "line", F.md5(F.col("row_text").cast("binary")).alias("row_md5"))

    @r.add(
        "w2_w4_lines_and_words",
        f"""
        SELECT doc, page, line, count(*) AS n_words, string_agg(w, ' ' ORDER BY i) AS text
        FROM (SELECT doc, page, line, unnest(string_split(row_text, ' ')) AS w, generate_subscripts(string_split(row_text, ' '), 1) AS i FROM ({ROWS_SQL}))
        WHERE w <> '' GROUP BY doc, page, line
        """,
    )
    def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Glyphs on a grid, back to words and lines."""
        return layout.lines_and_words(wrapped(spark, sf_dir))

    @r.add(
        "w2_glyph_lines",
        f"SELECT doc, page, count(*) AS n_lines FROM ({ROWS_SQL}) WHERE length(row_text) > 0 GROUP BY doc, page",
    )
    def w2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
        return layout.lines_of(layout.baselines(glyphs(spark, sf_dir, ["doc", "page"]))).groupBy("doc", "page").agg(F.max("line_no").alias("n_lines"))

    @r.add(
        "w5_upper_median",
        f"SELECT doc, page, list_sort(list(length(row_text)))[len(list(row_text)) // 2 + 1] AS median FROM ({ROWS_SQL}) GROUP BY doc, page",
    )
    def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
        return wrapped(spark, sf_dir).groupBy("doc", "page").agg(layout.upper_median(F.collect_list(F.length("row_text"))).cast("long").alias("median"))

    @r.add(
        "w6_page_pitch",
        f"""
        SELECT doc, page, coalesce(list_sort(list(gap) FILTER (WHERE gap > 5 AND gap <= 30))[len(list(gap) FILTER (WHERE gap > 5 AND gap <= 30)) // 2 + 1], 12.0)::DOUBLE AS pitch
        FROM (SELECT doc, page, 12.0 * (line - lag(line) OVER (PARTITION BY doc, page ORDER BY line)) AS gap FROM ({ROWS_SQL}) WHERE length(row_text) > 0) GROUP BY doc, page
        """,
    )
    def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Median step between baselines of a page, of steps between half and three sizes."""
        y = F.col("line") * 12.0
        gap = y - F.lag(y).over(Window.partitionBy("doc", "page").orderBy("line"))
        rows = wrapped(spark, sf_dir).where("length(row_text) > 0").withColumn("gap", gap)
        steps = F.collect_list(F.when((F.col("gap") > 5) & (F.col("gap") <= 30), F.col("gap")))
        return rows.groupBy("doc", "page").agg(F.coalesce(F.when(F.size(steps) > 0, layout.upper_median(steps)), F.lit(12.0)).alias("pitch"))

    @r.add(
        "w7_fragments",
        """
        SELECT doc_id, line_no, unnest(string_split(line, ' | ')) AS fragment, generate_subscripts(string_split(line, ' | '), 1) AS k FROM ("""
        + LINES_SQL
        + """) WHERE contains(line, ' | ')""",
    )
    def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines cut at the wide gaps that bars stand in."""
        cut = lines(spark, sf_dir).where(F.contains("line", F.lit(" | "))).select("doc_id", "line_no", F.posexplode(F.split("line", r" \| ", -1)).alias("k", "fragment"))
        return cut.select("doc_id", "line_no", "fragment", (F.col("k") + 1).cast("long").alias("k"))

    @r.add(
        "w9_paragraphs",
        f"""
        WITH b AS (SELECT *, coalesce(regexp_matches(lag(line) OVER w, '[.!?:;»”")]$') OR lag(line) OVER w = '' , true) AS brk FROM ({LINES_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        p AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS par FROM b)
        SELECT doc_id, par::BIGINT AS par, min(line_no) AS first_line, max(line_no) AS last_line, sum(length(line))::BIGINT AS n_chars FROM p GROUP BY doc_id, par
        """,
    )
    def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Paragraphs: a new one after a line that ends a sentence or is empty."""
        w = Window.partitionBy("doc_id").orderBy("line_no")
        before = F.lag("line").over(w)
        runs = layout.islands(lines(spark, sf_dir), F.coalesce(ends_sentence(before) | (before == ""), F.lit(True)), w, "par")
        return runs.groupBy("doc_id", "par").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum(F.length("line")).alias("n_chars"))

    @r.add(
        "b7_join_lines",
        f"""
        SELECT doc_id, md5(string_agg(piece, '' ORDER BY line_no)) AS joined_md5 FROM (
            SELECT doc_id, line_no, CASE WHEN nxt IS NULL THEN line WHEN line LIKE '%-' AND regexp_matches(nxt, '^[a-zà-ÿ]') THEN left(line, length(line) - 1) ELSE line || ' ' END AS piece
            FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM ({LINES_SQL}))) GROUP BY doc_id
        """,
    )
    def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines joined by blanks, without a hyphen that the next line continues in lower case."""
        after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
        piece = F.when(after.isNull(), F.col("line")).when(F.col("line").endswith("-") & after.rlike("^[a-zà-ÿ]"), F.expr("left(line, length(line) - 1)")).otherwise(F.concat("line", F.lit(" ")))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda s: s["piece"]), "")
        return lines(spark, sf_dir).withColumn("piece", piece).groupBy("doc_id").agg(F.md5(text.cast("binary")).alias("joined_md5"))

    @r.add(
        "w11_heading_level",
        f"""
        SELECT doc_id, line_no, CASE WHEN n >= 3 * m THEN 1 WHEN n >= 2 * m THEN 2 WHEN n >= 1.5 * m THEN 3 END AS level
        FROM (SELECT doc_id, line_no, length(line) AS n, list_sort(list(length(line)) OVER (PARTITION BY doc_id))[count(*) OVER (PARTITION BY doc_id) // 2 + 1] AS m FROM ({LINES_SQL})) WHERE n >= 1.5 * m AND m > 0
        """,
    )
    def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Levels by how far a line's measure (its length here) exceeds the document's upper median."""
        rows = lines(spark, sf_dir).select("doc_id", "line_no", F.length("line").alias("n"))
        medians = rows.groupBy("doc_id").agg(layout.upper_median(F.collect_list("n")).alias("m"))
        level = F.when(F.col("n") >= 3 * F.col("m"), 1).when(F.col("n") >= 2 * F.col("m"), 2).when(F.col("n") >= 1.5 * F.col("m"), 3)
        return rows.join(medians, "doc_id").where("m > 0").select("doc_id", "line_no", level.alias("level")).where("level IS NOT NULL")

    @r.add(
        "w12_page_edges",
        f"""
        SELECT doc, page, line, row_text FROM (SELECT *, max(line) OVER (PARTITION BY doc, page) AS last FROM ({ROWS_SQL}))
        WHERE (line <= 5 OR line > last - 5) AND length(trim(row_text)) BETWEEN 1 AND 20
        """,
    )
    def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Short rows in the top or bottom tenth of a page."""
        last = F.max("line").over(Window.partitionBy("doc", "page"))
        rows = wrapped(spark, sf_dir).withColumn("last", last)
        return rows.where((F.col("line") <= 5) | (F.col("line") > F.col("last") - 5)).where(F.length(F.trim("row_text")).between(1, 20)).select("doc", "page", "line", "row_text")

    @r.add(
        "w13_repeated_lines",
        """
        WITH l AS (
            SELECT doc_id, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '#', 'g'), '[ \\t]+', ' ', 'g')) AS line_key
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
            WHERE length(line) BETWEEN 1 AND 160
        )
        SELECT line_key, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM l
        WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= 2
        """,
    )
    def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Short lines whose key occurs in two documents or more: boilerplate of the corpus."""
        some = (
            table(spark, sf_dir, "documents")
            .select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
            .where(F.length("line").between(1, 160))
            .select("doc_id", header_key(F.col("line")).alias("line_key"))
            .where(F.col("line_key") != "")
        )
        per_doc = some.groupBy("line_key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        return per_doc.groupBy("line_key").agg(F.count("doc_id").alias("n_docs"), F.sum("n").alias("n_lines")).where(F.col("n_docs") >= 2)

    @r.add(
        "w15_aligned_rows",
        f"""
        WITH c AS (SELECT doc_id, line_no, len(string_split(line, ' | ')) AS k FROM ({LINES_SQL})),
        i AS (SELECT *, sum(CASE WHEN k = pk AND line_no = pl + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT *, lag(k) OVER w AS pk, lag(line_no) OVER w AS pl FROM c WHERE k >= 2 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)))
        SELECT doc_id, min(line_no) AS first_line, count(*) AS n_rows, any_value(k)::BIGINT AS n_columns FROM i GROUP BY doc_id, run HAVING count(*) >= 2
        """,
    )
    def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Tables: two or more consecutive lines of the same number of fragments."""
        cells = lines(spark, sf_dir).select("doc_id", "line_no", F.size(F.split("line", r" \| ", -1)).cast("long").alias("k")).where("k >= 2")
        w = Window.partitionBy("doc_id").orderBy("line_no")
        goes_on = (F.lag("k").over(w) == F.col("k")) & (F.lag("line_no").over(w) == F.col("line_no") - 1)
        runs = layout.islands(cells.withColumn("begins", ~F.coalesce(goes_on, F.lit(False))), F.col("begins"), w, "run")
        return runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_rows"), F.first("k").alias("n_columns")).where("n_rows >= 2").drop("run")

    @r.add(
        "w16_clusters",
        """
        SELECT l_suppkey, cluster::BIGINT AS cluster, count(*) AS n, round(avg(v), 6) AS mean FROM (
            SELECT l_suppkey, v, sum(CASE WHEN v - pv <= 25 THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM (
                SELECT l_suppkey, l_extendedprice AS v, lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS pv FROM lineitem)) GROUP BY l_suppkey, cluster
        """,
    )
    def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = layout.clusters(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("v")), ["l_suppkey"], "v", 25.0)
        return found.withColumn("mean", F.round("mean", 6))

    @r.add(
        "w17_grid_cells",
        """
        SELECT l_suppkey, floor(l_quantity / 10)::BIGINT AS col, floor(l_discount * 50 + 0.000001)::BIGINT AS row, count(*) AS n, string_agg(l_orderkey || '-' || l_linenumber, ' ' ORDER BY l_orderkey, l_linenumber) AS cell
        FROM lineitem GROUP BY 1, 2, 3
        """,
    )
    def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Points placed in the cells of a grid, one text for each cell."""
        rows = table(spark, sf_dir, "lineitem")
        cell = F.struct("l_orderkey", "l_linenumber")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda s: F.concat_ws("-", s["l_orderkey"].cast("string"), s["l_linenumber"].cast("string"))), " ")
        return rows.groupBy("l_suppkey", F.floor(F.col("l_quantity") / 10).alias("col"), F.floor(F.col("l_discount") * 50 + 0.000001).alias("row")).agg(F.count(F.lit(1)).alias("n"), text.alias("cell"))

    @r.add("w20_word_bag", f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS word FROM documents) GROUP BY doc_id, word")
    def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))

    @r.add(
        "a4_text_sink",
        f"SELECT doc, page, md5(string_agg(row_text, chr(10) ORDER BY line)) AS page_md5 FROM ({ROWS_SQL}) GROUP BY doc, page",
    )
    def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
        """One text for each page from its ordered rows."""
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "row_text"))), lambda s: s["row_text"]), "\n")
        return wrapped(spark, sf_dir).groupBy("doc", "page").agg(F.md5(text.cast("binary")).alias("page_md5"))
