"""Queries of comparison, page assembly and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers as N
from folioframe.functions.text import safe_file_name, words
from folioframe.operators import compare, pages, ranges
from folioframe.plans import Registry
from folioframe.plans.scalars import LINES_SQL, lines
from folioframe.plans.structure import ROWS_SQL, WORDS_SQL, wrapped
from folioframe.sources.scratch import ensure_checkpoints, written
from folioframe.sources.tables import table

PAGES_SQL = f"SELECT doc, page, count(*) AS n_rows, sum(length(row_text))::BIGINT AS weight, md5(string_agg(row_text, chr(10) ORDER BY line)) AS body FROM ({ROWS_SQL}) GROUP BY doc, page"
NEXT_SQL = f"""SELECT pair, side, pos, word FROM (SELECT doc_id - doc_id % 2 AS pair, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
    FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS ws FROM documents))"""

#: Documents in a task that compares their words.
DOCS_DEALT = 2_000


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, n_rows, weight, body) of wrapped documents."""
    body = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "row_text"))), lambda s: s["row_text"]), "\n").cast("binary"))
    return wrapped(spark, sf_dir).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("row_text")).alias("weight"), body.alias("body"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, side, pos, word): each even document and the one after it, as old and new."""
    doc = F.col("doc_id")
    side = F.when(doc % 2 == 0, "old").otherwise("new")
    rows = table(spark, sf_dir, "documents").select((doc - doc % 2).alias("pair"), side.alias("side"), F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return rows.select("pair", "side", (F.col("pos") + 1).cast("long").alias("pos"), "word")


def register(r: Registry) -> None:
    bags_sql = f"SELECT doc_id AS doc, word, count(*) AS n FROM (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS word FROM documents) GROUP BY ALL"

    @r.add(
        "d1_dice",
        f"""
        WITH b AS ({bags_sql}), t AS (SELECT doc, sum(n) AS total FROM b GROUP BY doc), p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 2 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)),
        s AS (SELECT p.a, p.b, sum(least(x.n, y.n)) AS shared FROM p JOIN b x ON x.doc = p.a JOIN b y ON y.doc = p.b AND y.word = x.word GROUP BY p.a, p.b)
        SELECT p.a, p.b, round(CASE WHEN coalesce(u.total, 0) + coalesce(v.total, 0) = 0 THEN 1.0 ELSE 2 * coalesce(shared, 0)::DOUBLE / (coalesce(u.total, 0) + coalesce(v.total, 0)) END, 9) AS dice
        FROM p LEFT JOIN s USING (a, b) LEFT JOIN t u ON u.doc = p.a LEFT JOIN t v ON v.doc = p.b
        """,
    )
    def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = table(spark, sf_dir, "documents").select("doc_id")
        pairs = ids.where("doc_id % 2 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(ids.select(F.col("doc_id").alias("b")), "b")
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
        return compare.dice_of_documents(pairs.select("a", "b"), docs, words).withColumn("dice", F.round("dice", 9))

    @r.add(
        "d2_near_pairs",
        f"""
        WITH b AS ({bags_sql}), t AS (SELECT doc, sum(n) AS total FROM b GROUP BY doc),
        s AS (SELECT x.doc AS a, y.doc AS b, sum(least(x.n, y.n)) AS shared FROM b x JOIN b y ON x.word = y.word AND x.doc < y.doc GROUP BY 1, 2),
        k AS (SELECT doc_id AS doc, coalesce(bag, '') AS bag FROM documents LEFT JOIN (SELECT doc, string_agg(word || ':' || n, ' ' ORDER BY word) AS bag FROM b GROUP BY doc) ON doc = doc_id), f AS (SELECT bag, min(doc) AS a FROM k GROUP BY bag)
        SELECT a, b, round(2 * shared::DOUBLE / (u.total + v.total), 9) AS dice FROM s JOIN t u ON u.doc = a JOIN t v ON v.doc = b WHERE 2 * shared::DOUBLE / (u.total + v.total) >= 0.8 AND a IN (SELECT a FROM f) AND b IN (SELECT a FROM f)
        UNION ALL SELECT a, doc, 1.0 FROM k JOIN f USING (bag) WHERE doc > a
        """,
    )
    def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Near pairs of different word bags, and copies with the first of their class."""
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
        return compare.near_links_of_documents(docs, words, 0.8, written).withColumn("dice", F.round("dice", 9))

    @r.add(
        "d5_common_prefix",
        f"""
        WITH t AS ({NEXT_SQL}), j AS (SELECT pair, pos, o.word = n.word AS same FROM (SELECT * FROM t WHERE side = 'old') o FULL JOIN (SELECT * FROM t WHERE side = 'new') n USING (pair, pos))
        SELECT pair, coalesce(min(CASE WHEN same THEN NULL ELSE pos END) - 1, max(pos))::BIGINT AS n_equal FROM j GROUP BY pair
        """,
    )
    def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How many words two neighbouring documents begin with alike."""
        t = neighbours(spark, sf_dir)
        old, new = (t.where(F.col("side") == s).select("pair", "pos", F.col("word").alias(s)) for s in ("old", "new"))
        differs = F.when(~F.coalesce(F.col("old") == F.col("new"), F.lit(False)), F.col("pos"))
        return old.join(new, ["pair", "pos"], "full").groupBy("pair").agg(F.coalesce(F.min(differs) - 1, F.max("pos")).alias("n_equal"))

    @r.add(
        "d6_anchors",
        f"""
        WITH o AS MATERIALIZED (SELECT doc_id, word, min(pos) AS pos FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS ws FROM documents)) GROUP BY doc_id, word HAVING count(*) = 1)
        SELECT x.doc_id AS pair, x.word, x.pos AS old_pos, y.pos AS new_pos FROM (SELECT * FROM o WHERE doc_id % 2 = 0) x JOIN (SELECT *, doc_id - 1 AS pair FROM o WHERE doc_id % 2 = 1) y ON x.doc_id = y.pair AND x.word = y.word
        """,
    )
    def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compare.anchors(neighbours(spark, sf_dir))

    @r.add("d7_d8_word_diff")
    def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Changes between neighbouring documents of one opening line; tests rebuild the new text from them."""
        doc = F.col("doc_id")
        docs = table(spark, sf_dir, "documents").select((doc - doc % 2).alias("pair"), F.when(doc % 2 == 0, "old").otherwise("new").alias("side"), "text")
        return compare.diff_of_documents(docs, words, docs.count() // DOCS_DEALT + 1)

    side_sql = f"SELECT doc_id - doc_id % 2 AS pair, doc_id % 2 AS side, line FROM ({LINES_SQL})"

    @r.add(
        "d9_line_diff",
        f"""
        WITH l AS ({side_sql}), c AS (SELECT pair, line, sum(CASE WHEN side = 0 THEN 1 ELSE -1 END) AS d FROM l GROUP BY pair, line)
        SELECT pair, CASE WHEN d > 0 THEN 'removed' ELSE 'added' END AS kind, md5(line) AS line_md5, abs(d)::BIGINT AS n FROM c WHERE d <> 0
        """,
    )
    def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines of only one side, as multisets."""
        doc = F.col("doc_id")
        rows = lines(spark, sf_dir).select((doc - doc % 2).alias("pair"), (doc % 2).alias("side"), "line")
        d = rows.groupBy("pair", "line").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("d")).where("d <> 0")
        return d.select("pair", F.when(F.col("d") > 0, "removed").otherwise("added").alias("kind"), F.md5(F.col("line").cast("binary")).alias("line_md5"), F.abs("d").alias("n"))

    @r.add(
        "d10_moved_lines",
        f"""
        WITH l AS (SELECT doc_id - doc_id % 2 AS pair, doc_id % 2 AS side, line_no, lower(trim(line)) AS k FROM ({LINES_SQL}) WHERE len(string_split(trim(line), ' ')) >= 3),
        n AS (SELECT *, row_number() OVER (PARTITION BY pair, side, k ORDER BY line_no) AS r FROM l)
        SELECT o.pair, md5(o.k) AS key_md5, o.line_no AS old_at, w.line_no AS new_at FROM n o JOIN n w ON o.pair = w.pair AND o.k = w.k AND o.r = w.r AND o.side = 0 AND w.side = 1 WHERE o.line_no <> w.line_no
        """,
    )
    def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines of three words or more that stand elsewhere in the next document."""
        doc = F.col("doc_id")
        rows = lines(spark, sf_dir).where(F.size(F.split(F.trim("line"), " ")) >= 3).select((doc - doc % 2).alias("pair"), (doc % 2).alias("side"), F.lower(F.trim("line")).alias("key"), F.col("line_no").alias("at"))
        found = compare.moved(rows.where("side = 0"), rows.where("side = 1"), ["pair"]).where("old_at <> new_at")
        return found.select("pair", F.md5(F.col("key").cast("binary")).alias("key_md5"), "old_at", "new_at")

    @r.add(
        "d11_change_counts",
        f"""
        WITH d AS ({r.sql['d9_line_diff']}), m AS (SELECT pair, count(*) AS moved FROM ({r.sql['d10_moved_lines']}) GROUP BY pair), c AS (SELECT pair, coalesce(sum(n) FILTER (WHERE kind = 'added'), 0)::BIGINT AS added, coalesce(sum(n) FILTER (WHERE kind = 'removed'), 0)::BIGINT AS removed FROM d GROUP BY pair)
        SELECT pair, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, least(coalesce(added, 0), coalesce(removed, 0)) AS replaced, coalesce(moved, 0) AS moved FROM c FULL JOIN m USING (pair)
        """,
    )
    def d11c(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines added, removed and moved between neighbouring documents; as many are replaced as are both added and removed."""
        changes = r.queries["d9_line_diff"](spark, sf_dir)
        n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
        both = changes.groupBy("pair").agg(n("added"), n("removed")).join(r.queries["d10_moved_lines"](spark, sf_dir).groupBy("pair").agg(F.count(F.lit(1)).alias("moved")), "pair", "full")
        return both.na.fill(0, ["added", "removed", "moved"]).select("pair", "added", "removed", F.least("added", "removed").alias("replaced"), "moved")

    sim_sql = f"""SELECT o.doc - o.doc % 2 AS pair, o.page AS old_page, n.page AS new_page, o.body = n.body AS same, abs(o.weight - n.weight)::BIGINT AS d FROM ({PAGES_SQL}) o JOIN ({PAGES_SQL}) n ON o.doc + 1 = n.doc AND o.doc % 2 = 0"""

    def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
        """(pair, old_page, new_page, sim) of neighbouring documents: the Dice likeness of pages that share a row."""
        rows = wrapped(spark, sf_dir).withColumn("pair", F.col("doc") - F.col("doc") % 2)
        n = rows.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n"))
        counts = rows.groupBy("pair", "doc", "page", "row_text").agg(F.count(F.lit(1)).alias("k"))
        old = counts.where("doc % 2 = 0").select("pair", "row_text", F.col("page").alias("old_page"), F.col("k").alias("x"))
        new = counts.where("doc % 2 = 1").select("pair", "row_text", F.col("page").alias("new_page"), F.col("k").alias("y"))
        both = old.join(new, ["pair", "row_text"]).groupBy("pair", "old_page", "new_page").agg(F.sum(F.least("x", "y")).alias("both"))
        sized = both.join(n.select(F.col("doc").alias("pair"), F.col("page").alias("old_page"), F.col("n").alias("no")), ["pair", "old_page"]).join(n.select((F.col("doc") - 1).alias("pair"), F.col("page").alias("new_page"), F.col("n").alias("nn")), ["pair", "new_page"])
        return sized.select("pair", "old_page", "new_page", (2 * F.col("both") / (F.col("no") + F.col("nn"))).alias("sim"))

    @r.add("d3_page_alignment")
    def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Pages of neighbouring documents in their best order-keeping alignment."""
        return compare.align_pages(similar(spark, sf_dir).where("sim > 0.1"), 0.1)

    @r.add("d4_moved_pages")
    def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Pages of neighbouring documents paired greedily by likeness, in rounds of pairs best on both sides."""
        ensure_checkpoints(spark)
        return compare.mutual_best(similar(spark, sf_dir).where("sim > 0.1")).withColumn("sim", F.round("sim", 9))

    @r.add(
        "d11_difference_counts",
        f"""
        WITH p AS ({sim_sql}), n AS (SELECT doc - doc % 2 AS pair, count(*) FILTER (WHERE doc % 2 = 0) AS n_old, count(*) FILTER (WHERE doc % 2 = 1) AS n_new FROM ({PAGES_SQL}) GROUP BY 1),
        m AS (SELECT pair, count(*) FILTER (WHERE same AND old_page = new_page) AS n_same FROM p GROUP BY pair)
        SELECT pair, n_old, n_new, coalesce(n_same, 0) AS n_same, n_old = n_new AND coalesce(n_same, 0) = n_old AS identical FROM n LEFT JOIN m USING (pair)
        """,
    )
    def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = page_table(spark, sf_dir).withColumn("pair", F.col("doc") - F.col("doc") % 2).withColumn("side", F.col("doc") % 2)
        slots = p.groupBy("pair", "page").agg(F.max(F.when(F.col("side") == 0, F.col("body"))).alias("o"), F.max(F.when(F.col("side") == 1, F.col("body"))).alias("n"))
        counts = slots.groupBy("pair").agg(F.count("o").alias("n_old"), F.count("n").alias("n_new"), F.count_if(F.col("o") == F.col("n")).alias("n_same"))
        return counts.withColumn("identical", (F.col("n_old") == F.col("n_new")) & (F.col("n_same") == F.col("n_old")))

    @r.add(
        "d12_summary_top",
        f"""SELECT doc_id, string_agg(substr(line, 1, 72), ' / ' ORDER BY line_no) FILTER (WHERE rn <= 3) || CASE WHEN max(n) > 3 THEN ' … and ' || (max(n) - 3) || ' more' ELSE '' END AS summary
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM ({LINES_SQL})) GROUP BY doc_id""",
    )
    def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The first three extracts of a document, and how many more there are."""
        ranked = lines(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
        heads = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("line_no", F.substring("line", 1, 72).alias("t"))))), lambda s: s["t"]), " / ")
        tail = F.when(F.max("n") > 3, F.concat(F.lit(" … and "), (F.max("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
        return ranked.groupBy("doc_id").agg(F.concat(heads, tail).alias("summary"))

    @r.add(
        "g1_merge",
        f"""SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc, page) AS page, doc, p.page AS old_page FROM ({PAGES_SQL}) p JOIN documents ON doc_id = doc""",
    )
    def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Pages of all documents of a source in one run."""
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
        p = page_table(spark, sf_dir).select("doc", F.col("page").alias("old_page")).join(docs, "doc")
        bounds = ranges.range_bounds(docs, "doc", 100_000)
        return ranges.row_numbers(p, ["source"], ["doc", "old_page"], "doc", "page", bounds).select("source", "page", "doc", "old_page")

    @r.add("g4_delete", f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page) AS page, body FROM ({PAGES_SQL}) p WHERE page % 3 <> 1 OR doc IN (SELECT doc FROM ({PAGES_SQL}) GROUP BY doc HAVING count(*) = 1)")
    def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every third page deleted; documents of one page stay whole."""
        p = page_table(spark, sf_dir).select("doc", "page", "body")
        return pages.delete(p, p.where("page % 3 = 1").select("doc", "page"))

    @r.add("g5_reorder", f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page DESC) AS page, body FROM ({PAGES_SQL})")
    def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pages.renumber(page_table(spark, sf_dir).select("doc", "page", "body"), [F.desc("page")])

    @r.add("g6_move_block", f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN page IN (3, 5) THEN 1 WHEN page < 2 THEN 0 ELSE 2 END, page) AS page, body FROM ({PAGES_SQL})")
    def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pages.move(page_table(spark, sf_dir).select("doc", "page", "body"), F.col("page").isin(3, 5), F.lit(2))

    @r.add("g7_extract", f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page) AS page, body FROM ({PAGES_SQL}) WHERE page BETWEEN 2 AND 4")
    def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pages.renumber(page_table(spark, sf_dir).where("page BETWEEN 2 AND 4").select("doc", "page", "body"), ["page"])

    @r.add("g9_rotate", f"SELECT doc, page, (page * 90 + CASE WHEN page % 2 = 0 THEN 270 ELSE 0 END) % 360 AS rotate FROM ({PAGES_SQL})")
    def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
        return page_table(spark, sf_dir).select("doc", "page", F.pmod(F.col("page") * 90 + F.when(F.col("page") % 2 == 0, -90).otherwise(0), F.lit(360)).alias("rotate"))

    @r.add(
        "g10_a7_split_every",
        f"""SELECT doc, page, (page - 1) // 4 + 1 AS part, 'doc-' || lpad(((page - 1) // 4 + 1)::VARCHAR, length(((max(page) OVER (PARTITION BY doc) - 1) // 4 + 1)::VARCHAR)::INT, '0') || ' ' || doc AS part_name FROM ({PAGES_SQL})""",
    )
    def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Parts of four pages, and the names under which a partitioned writer puts them."""
        part = F.floor((F.col("page") - 1) / 4) + 1
        total = F.max(part).over(Window.partitionBy("doc")).cast("string")
        name = F.concat(F.lit("doc-"), F.lpad(part.cast("string"), F.length(total), F.lit("0")), F.lit(" "), F.col("doc").cast("string"))
        return page_table(spark, sf_dir).select("doc", "page", part.alias("part"), safe_file_name(name).alias("part_name"))

    mark_sql = f"SELECT doc, page, line AS ord, row_text AS title FROM ({ROWS_SQL}) WHERE length(row_text) BETWEEN 1 AND 25"

    @r.add(
        "g11_split_by_marks",
        f"""
        WITH m AS (SELECT doc, page, arg_min(title, ord) AS title FROM ({mark_sql}) GROUP BY doc, page), p AS (SELECT p.doc, p.page, m.title FROM ({PAGES_SQL}) p LEFT JOIN m USING (doc, page))
        SELECT doc, page, count(title) OVER w AS part, last_value(title IGNORE NULLS) OVER w AS title FROM p WINDOW w AS (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING)
        """,
    )
    def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A part starts at each page with a short row, its title."""
        rows = wrapped(spark, sf_dir)
        marks = rows.where(F.length("row_text").between(1, 25)).select("doc", "page", F.col("line").alias("ord"), F.col("row_text").alias("title"))
        return pages.parts_by_marks(page_table(spark, sf_dir).select("doc", "page"), marks)

    @r.add(
        "g12_split_by_size",
        f"""
        WITH RECURSIVE p AS (SELECT doc, page, weight FROM ({PAGES_SQL})), g AS (
            SELECT doc, page, weight AS total, 1::BIGINT AS part FROM p WHERE page = 1
            UNION ALL SELECT p.doc, p.page, CASE WHEN total > 0 AND total + weight > 9000 THEN weight ELSE total + weight END, part + (total > 0 AND total + weight > 9000)::INT FROM g JOIN p ON p.doc = g.doc AND p.page = g.page + 1)
        SELECT doc, page, part FROM g
        """,
    )
    def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pages.parts_by_size(page_table(spark, sf_dir), 9000)

    count_sql = f"SELECT doc, count(*) AS n_pages FROM ({PAGES_SQL}) GROUP BY doc"

    @r.add(
        "g14_n5_number_across",
        f"""SELECT doc, n_pages, (sum(n_pages) OVER (ORDER BY doc) - n_pages + 1)::BIGINT AS first, (sum(n_pages) OVER (ORDER BY doc))::BIGINT AS last FROM ({count_sql})""",
    )
    def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
        """First and last page number of each document in one run over all."""
        counts = page_table(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"))
        return pages.number_across(counts, F.col("doc"))

    range_sql = "SELECT doc_id AS doc, 1 AS first_page, 'r' AS style, '' AS prefix, 1 AS start FROM documents UNION ALL SELECT doc_id, 3, 'D', '', 1 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 6, 'A', 'Annex-', 1 FROM documents WHERE doc_id % 3 = 0"

    @r.add(
        "n1_page_labels",
        f"""
        WITH l AS (SELECT p.doc, p.page, x.style, x.prefix, (x.start + p.page - x.first_page)::BIGINT AS n FROM ({PAGES_SQL}) p ASOF JOIN ({range_sql}) x ON p.doc = x.doc AND p.page >= x.first_page)
        SELECT doc, page, prefix || CASE style WHEN 'D' THEN n::VARCHAR WHEN 'A' THEN repeat(chr((65 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT)
            ELSE repeat('c', (n // 100)::INT) || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n % 100 // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] END AS label FROM l
        """,
    )
    def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Labels from ranges: roman first, decimal from page 3 of even documents, letters from page 6 of each third."""
        doc = F.col("doc_id").alias("doc")
        docs = table(spark, sf_dir, "documents")
        rows = [("r", "", 1, "doc_id >= 0"), ("D", "", 3, "doc_id % 2 = 0"), ("A", "Annex-", 6, "doc_id % 3 = 0")]
        spans = None
        for style, prefix, first, where in rows:
            some = docs.where(where).select(doc, F.lit(first).cast("long").alias("first_page"), F.lit(style).alias("style"), F.lit(prefix).alias("prefix"), F.lit(1).alias("start"))
            spans = some if spans is None else spans.unionByName(some)
        n = F.col("range.start") + F.col("page") - F.col("range.first_page")
        label = F.when(F.col("range.style") == "D", n.cast("string")).when(F.col("range.style") == "A", N.letters(n, "A")).otherwise(F.lower(N.roman(n)))
        return pages.labels(page_table(spark, sf_dir).select("doc", "page"), spans).select("doc", "page", F.concat("range.prefix", label).alias("label"))

    @r.add("n4_bates", f"SELECT doc, page, 'B' || lpad((row_number() OVER (PARTITION BY doc ORDER BY page) + 99)::VARCHAR, 6, '0') AS bates FROM ({PAGES_SQL}) WHERE page % 2 = 1")
    def n4(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Numbers from 100 on the odd pages of each document."""
        n = F.row_number().over(Window.partitionBy("doc").orderBy("page")) + 99
        return page_table(spark, sf_dir).where("page % 2 = 1").select("doc", "page", N.bates_label(n, 6, "B").alias("bates"))

    @r.add("n6_header_text", f"SELECT doc, page, 'doc ' || doc AS top_left, page || ' / ' || max(page) OVER (PARTITION BY doc) AS bottom_right FROM ({PAGES_SQL})")
    def n6(spark: SparkSession, sf_dir: str) -> DataFrame:
        total = F.max("page").over(Window.partitionBy("doc")).cast("string")
        return page_table(spark, sf_dir).select("doc", "page", F.concat(F.lit("doc "), F.col("doc").cast("string")).alias("top_left"), F.concat(F.col("page").cast("string"), F.lit(" / "), total).alias("bottom_right"))

    entry_sql = "ceil(length(concat(title, ' ', before + contents + 1)) / 30.0)"

    @r.add(
        "g14_contents_page",
        f"""
        WITH RECURSIVE p AS MATERIALIZED (
            SELECT source, doc_id, title, n_pages, coalesce(sum(n_pages) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM (SELECT source, doc_id, substr(split_part(text, chr(10), 1), 1, 10 + doc_id % 40) AS title FROM documents) JOIN (SELECT doc AS doc_id, count(*) AS n_pages FROM ({PAGES_SQL}) GROUP BY doc) USING (doc_id)
        ), l AS (
            SELECT DISTINCT source, 1::BIGINT AS contents, 0 AS k FROM p
            UNION ALL SELECT source, ceil(sum({entry_sql}) / 12.0)::BIGINT, k + 1 FROM l JOIN p USING (source) WHERE k < 9 GROUP BY source, k
        ), e AS (SELECT p.*, contents, {entry_sql} AS n_lines FROM p JOIN l USING (source) WHERE k = 9)
        SELECT source, doc_id, title, n_pages, contents, (coalesce(sum(n_lines) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 12 + 1)::BIGINT AS entry_page, before + contents + 1 AS start FROM e
        """,
    )
    def g14_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The documents of each source behind contents pages, whose length depends on the numbers on them."""
        counts = page_table(spark, sf_dir).groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_pages"))
        title = F.substring(F.element_at(F.split("text", "\n", 2), 1), F.lit(1), (10 + F.col("doc_id") % 40).cast("int"))
        files = table(spark, sf_dir, "documents").select("source", "doc_id", title.alias("title")).join(counts, "doc_id").select("source", F.col("doc_id").alias("ord"), F.col("doc_id").alias("file"), "title", "n_pages")
        return pages.combined(files, ["source"], written, 12, 30).withColumnRenamed("file", "doc_id")
