"""Queries of structure rules, profiles, ruled tables, columns, text units and page objects.

The given tables hold no drawn pages: an order stands for a page (eight to a document) and its line items for what is drawn
on it, so that all of it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions.text import ends_sentence
from folioframe.operators import audit, layout, search
from folioframe.plans import Registry
from folioframe.plans.models import FIELDS_SQL, fields
from folioframe.plans.scalars import LINES_SQL, lines
from folioframe.plans.structure import ROWS_SQL, wrapped
from folioframe.sources.tables import dealt, table

DRAWN_SQL = "(SELECT l_orderkey // 8 AS doc, l_orderkey % 8 AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS ord, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q, l_returnflag AS f FROM lineitem)"
PAGE_SQL = "(SELECT o_orderkey // 8 AS doc, o_orderkey % 8 AS page, * FROM orders)"


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, ord, p, s, q, f): line items as what is drawn on pages, numbered on each page."""
    k, items = F.col("l_orderkey"), table(spark, sf_dir, "lineitem")
    rows = items.select(F.floor(k / 8).alias("doc"), (k % 8).alias("page"), "l_linenumber", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), "l_quantity", F.col("l_returnflag").alias("f"))
    ord = F.row_number().over(Window.partitionBy("doc", "page").orderBy("l_linenumber", "p", "s", "l_quantity", "f"))
    return dealt(rows, ["doc", "page"], items.count()).select("doc", "page", ord.cast("bigint").alias("ord"), "p", "s", F.col("l_quantity").cast("bigint").alias("q"), "f")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with (doc, page)."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("doc", F.floor(k / 8)).withColumn("page", k % 8)


def register(r: Registry) -> None:
    none = "NULL::BIGINT AS page"

    @r.add(
        "u1_document_tagged",
        f"""
        WITH t AS (SELECT page_id AS doc, regexp_matches(html, '<(article|main)[ >]') AS has_root, len(regexp_extract_all(html, '<p[ >]')) AS n, regexp_matches(html, '<html lang="[a-z]+"') AS marked, len(regexp_extract_all(html, '<p[ >]')) <> len(regexp_extract_all(html, '</p>')) AS suspect FROM pages)
        SELECT doc, 2 AS severity, 'document-tagged' AS rule, {none}, 'no structure root' AS message FROM t WHERE NOT has_root UNION ALL SELECT doc, 2, 'document-tagged', NULL, 'empty structure' FROM t WHERE has_root AND n = 0
        UNION ALL SELECT doc, 2, 'document-tagged', NULL, 'not marked' FROM t WHERE NOT marked UNION ALL SELECT doc, 1, 'document-tagged', NULL, 'suspect marks' FROM t WHERE suspect
        """,
    )
    def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Web pages as documents: a root, something in it, a language, paragraphs that are closed."""
        n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
        roots = table(spark, sf_dir, "pages").select(
            F.col("page_id").alias("doc"), F.col("html").rlike("<(article|main)[ >]").alias("has_root"), n("<p[ >]").alias("n_nodes"), F.col("html").rlike('<html lang="[a-z]+"').alias("marked"), (n("<p[ >]") != n("</p>")).alias("suspect")
        )
        return audit.tagged(roots)

    @r.add(
        "u4_figure_alt",
        f"""SELECT doc, 2 AS severity, 'figure-alt' AS rule, page, kind || ' without alternative text' AS message FROM (SELECT doc, page, ['Figure', 'Formula', 'P'][(o_orderkey % 3 + 1)::INT] AS kind, CASE WHEN o_orderpriority LIKE '1%' THEN NULL WHEN o_orderpriority LIKE '2%' THEN ' ' ELSE o_orderpriority END AS alt, CASE WHEN o_custkey % 2 = 1 THEN 'x' END AS actual FROM {PAGE_SQL})
        WHERE kind <> 'P' AND trim(coalesce(alt, '')) = '' AND actual IS NULL""",
    )
    def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        kind = F.element_at(F.array(*map(F.lit, ["Figure", "Formula", "P"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
        alt = F.when(first == "1", F.lit(None)).when(first == "2", " ").otherwise(F.col("o_orderpriority"))
        return audit.figures(sheets(spark, sf_dir).select("doc", "page", kind.alias("kind"), alt.alias("alt"), F.when(F.col("o_custkey") % 2 == 1, "x").alias("actual")))

    @r.add(
        "u7_table_headers",
        f"""
        WITH n AS (SELECT doc, page, count(*) FILTER (WHERE f = 'A') AS th, count(*) FILTER (WHERE f = 'A' AND s % 2 = 0) AS bare, count(*) FILTER (WHERE f <> 'A') AS td, count(*) FILTER (WHERE f <> 'A' AND p % 2 = 1) AS named FROM {DRAWN_SQL} GROUP BY doc, page)
        SELECT doc, 2 AS severity, 'table-headers' AS rule, page, 'table without TH' AS message FROM n WHERE th = 0 UNION ALL SELECT doc, 1, 'table-headers', page, bare || ' TH without scope' FROM n WHERE bare > 0 AND named < td
        """,
    )
    def u7(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = drawn(spark, sf_dir).select("doc", "page", F.lit(1).alias("node"), F.when(F.col("f") == "A", "TH").otherwise("TD").alias("kind"), F.when(F.col("s") % 2 == 1, "Row").alias("scope"), F.when(F.col("p") % 2 == 1, "h").alias("headers"))
        return audit.table_headers(cells)

    @r.add(
        "u10_untagged_content",
        f"""
        WITH n AS (SELECT doc, page, count(*) FILTER (WHERE p % 4 <> 0 AND s % 3 = 0 AND f <> 'A') AS texts, count(*) FILTER (WHERE p % 4 = 0 AND s % 3 = 0 AND f <> 'A') AS images FROM {DRAWN_SQL} WHERE doc % 5 <> 0 GROUP BY doc, page)
        SELECT doc, 2 AS severity, 'untagged-content' AS rule, page, texts || ' texts' AS message FROM n WHERE texts > 0 UNION ALL SELECT doc, 2, 'untagged-content', page, images || ' images' FROM n WHERE texts > 0 AND images > 0
        """,
    )
    def u10(spark: SparkSession, sf_dir: str) -> DataFrame:
        marks = drawn(spark, sf_dir).select("doc", "page", (F.col("p") % 4 == 0).alias("image"), F.when(F.col("s") % 3 != 0, F.col("ord")).alias("mcid"), (F.col("f") == "A").alias("artifact"))
        roots = sheets(spark, sf_dir).select("doc", (F.col("doc") % 5 != 0).alias("has_root")).distinct()
        return audit.untagged(marks, roots)

    _lin = lambda c: f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.03928 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
    lum = lambda a: f"({_lin(a + 'r')} * 0.2126 + {_lin(a + 'g')} * 0.7152 + {_lin(a + 'b')} * 0.0722)"
    _hex = lambda a: "'#' || " + " || ".join(f"lpad(upper(to_hex({a}{c})), 2, '0')" for c in "rgb")

    @r.add(
        "u11_contrast",
        f"""
        WITH m AS (SELECT *, p % 256 AS r, s * 7 % 256 AS g, p * 13 % 256 AS b, p % 400 AS x0 FROM {DRAWN_SQL}), t AS (SELECT *, 8 + s % 12 AS size, f = 'R' AS bold FROM m WHERE ord % 2 = 0 AND p % 5 <> 0), z AS (SELECT *, q * 20 AS edge FROM m WHERE ord % 2 = 1),
        k AS (SELECT t.doc, t.page, t.ord, arg_max(z.r, z.ord) AS br, arg_max(z.g, z.ord) AS bg, arg_max(z.b, z.ord) AS bb FROM t JOIN z ON z.doc = t.doc AND z.page = t.page AND z.ord < t.ord AND edge >= t.x0 + 60 - 0.5 GROUP BY ALL),
        c AS (SELECT t.*, coalesce(br, 255) AS br, coalesce(bg, 255) AS bg, coalesce(bb, 255) AS bb FROM t LEFT JOIN k USING (doc, page, ord))
        SELECT DISTINCT doc, 1 AS severity, 'contrast' AS rule, page, {_hex('')} || ' on ' || {_hex('b')} AS message FROM c
        WHERE (greatest({lum('')}, {lum('b')}) + 0.05) / (least({lum('')}, {lum('b')}) + 0.05) < CASE WHEN size >= 18 OR bold AND size >= 14 THEN 3.0 ELSE 4.5 END
        """,
    )
    def u11(spark: SparkSession, sf_dir: str) -> DataFrame:
        colours = drawn(spark, sf_dir).select("*", (F.col("p") % 256).alias("r"), (F.col("s") * 7 % 256).alias("g"), (F.col("p") * 13 % 256).alias("b"))
        x = F.col("p") % 400
        box = lambda x0, y0, x1, y1: [F.lit(v).alias(n) if isinstance(v, int) else v.alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))]
        runs = colours.where("ord % 2 = 0").select("doc", "page", "ord", *box(x, 100, x + 60, 112), "r", "g", "b", (8 + F.col("s") % 12).alias("size"), (F.col("f") == "R").alias("bold"), (F.col("p") % 5 == 0).alias("artifact"))
        return audit.contrast(runs, colours.where("ord % 2 = 1").select("doc", "page", "ord", *box(0, 0, F.col("q") * 20, 800), "r", "g", "b"))

    @r.add(
        "u12_image_only_text",
        f"""
        WITH c AS (SELECT doc, page, sum(length(trim(row_text))) AS n, least((doc * 7 + page * 13) % 700, 600) * 800 / 480000 AS part FROM ({ROWS_SQL}) GROUP BY doc, page)
        SELECT doc, 2 AS severity, 'image-only-text' AS rule, page, round(part * 100)::BIGINT || ' %' AS message FROM c WHERE n < 20 AND part >= 0.4
        """,
    )
    def u12(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Wrapped documents, each page with an image whose width follows from its number."""
        counts = wrapped(spark, sf_dir).groupBy("doc", "page").agg(F.sum(F.length(F.trim("row_text"))).alias("n_chars")).withColumn("width", F.lit(600)).withColumn("height", F.lit(800))
        images = counts.select("doc", "page", F.lit(-50).alias("x0"), F.lit(0).alias("y0"), ((F.col("doc") * 7 + F.col("page") * 13) % 700).alias("x1"), F.lit(800).alias("y1"))
        return audit.image_only(counts, images)

    @r.add("u13_font_tounicode", f"SELECT doc_id AS doc, 2 AS severity, 'font-tounicode' AS rule, {none}, coalesce(source, '?') || ': ' || u || ' of ' || n AS message FROM (SELECT doc_id, source, length(text) AS n, length(regexp_replace(text, '[\\x20-\\x7E\\n]', '', 'g')) AS u FROM documents) WHERE u > 0")
    def u13(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Sources as fonts, whose glyphs beyond plain ASCII are unmapped."""
        glyphs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("font"), F.length("text").alias("shown"), F.length(F.regexp_replace("text", r"[\x20-\x7E\n]", "")).alias("unmapped"))
        return audit.unmapped_fonts(glyphs)

    @r.add(
        "u14_field_tu",
        f"""SELECT doc::BIGINT AS doc, 2 AS severity, 'field-tu' AS rule, {none}, name || ' without description' AS message FROM ({FIELDS_SQL}) WHERE "default" IS NULL
        UNION ALL SELECT doc, 2, 'field-tu', NULL, name || ' outside the structure' FROM ({FIELDS_SQL}) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    )
    def u14(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = fields(spark, sf_dir).select("doc", "name", F.col("c_custkey").alias("widget"), F.col("default").alias("alternate"))
        return audit.field_descriptions(f, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("widget")))

    features = {
        "encryption": "o_orderstatus = 'P'", "javascript": "o_orderpriority LIKE '1%'", "embedded-files": "o_orderpriority LIKE '2%'", "external-actions": "o_orderpriority LIKE '3%'", "transparency": "o_custkey % 3 = 0",
        "fonts-embedded": "o_orderkey % 7 = 0", "trimbox": "o_orderkey % 5 = 0", "accessibility": "o_orderkey % 2 = 0", "xmp-metadata": "o_orderkey % 11 = 0",
    }
    banned_sql = ", ".join(f"('{p}', '{f}')" for p, fs in audit.FORBIDDEN.items() for f in fs)
    limit_sql = ", ".join(f"('{p}', {v})" for p, v in audit.MAX_VERSION.items() if v is not None)
    flight_sql = f"""SELECT doc, profile, feature AS rule FROM (SELECT o_orderkey AS doc, unnest(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in features.items())}], lambda x: x IS NOT NULL)) AS feature FROM orders) JOIN (VALUES {banned_sql}) b(profile, feature) USING (feature)
        UNION ALL SELECT o_orderkey, profile, 'version' FROM orders JOIN (VALUES {limit_sql}) l(profile, most) ON 13 + o_custkey % 8 > most"""

    def flight(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders")
        found = F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in features.items())))
        return audit.preflight(orders.select(F.col("o_orderkey").alias("doc"), (13 + F.col("o_custkey") % 8).alias("version")), orders.select(F.col("o_orderkey").alias("doc"), F.explode(found).alias("feature")))

    @r.add("u17_preflight", flight_sql)
    def u17(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Orders as documents with versions and features, against six profiles."""
        return flight(spark, sf_dir)

    @r.add(
        "u18_metadata_rule",
        f"""
        WITH t AS (SELECT page_id AS doc, regexp_matches(html, '<h1') AS packet, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS part, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS info FROM pages)
        SELECT doc, 2 AS severity, 'xmp-metadata' AS rule, {none}, 'no packet' AS message FROM t WHERE NOT packet UNION ALL SELECT doc, 2, 'xmp-metadata', NULL, 'other profile' FROM t WHERE packet AND part <> 'en'
        UNION ALL SELECT doc, 2, 'xmp-metadata', NULL, 'other title' FROM t WHERE packet AND trim(info) <> '' AND title <> info
        """,
    )
    def u18(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Web pages whose heading is the packet's title; the language is the declared part."""
        part = lambda p: F.regexp_extract("html", p, 1)
        packets = table(spark, sf_dir, "pages").select(
            F.col("page_id").alias("doc"), F.col("html").rlike("<h1").alias("packet"), part('<html lang="([a-z]+)"').alias("part"), F.lit("en").alias("needed"), part("(?s)<h1[^>]*>(.*?)</h1>").alias("title"), part("(?s)<title>(.*?)</title>").alias("info_title")
        )
        return audit.metadata(packets)

    mend = ["javascript", "external-actions", "embedded-files", "version", "trimbox", "xmp-metadata"]

    @r.add("u19_fix_plan", f"""SELECT doc, profile, count(*) FILTER (WHERE rule IN {tuple(mend)}) AS fixed, count(*) FILTER (WHERE rule NOT IN {tuple(mend)}) AS "left", count(*) FILTER (WHERE rule NOT IN {tuple(mend)}) = 0 AS conforming FROM ({flight_sql}) GROUP BY doc, profile""")
    def u19(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.fix_plan(flight(spark, sf_dir), mend)

    @r.add("a12_page_objects", f"SELECT doc, page, CASE f WHEN 'A' THEN 'image' WHEN 'R' THEN 'path' ELSE 'text' END AS kind, count(*) AS n, count(*) FILTER (WHERE NOT (p % 100 >= 10 AND p % 100 + q <= 100)) AS n_clipped, max(ord) AS deepest FROM {DRAWN_SQL} GROUP BY ALL")
    def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = F.when(F.col("f") == "A", "image").when(F.col("f") == "R", "path").otherwise("text")
        x = F.col("p") % 100
        clip = [F.lit(v).alias(n) for v, n in ((10, "cx0"), (0, "cy0"), (100, "cx1"), (90, "cy1"), (20, "y0"), (32, "y1"))]
        return audit.object_inventory(drawn(spark, sf_dir).select("doc", "page", kind.alias("kind"), x.alias("x0"), (x + F.col("q")).alias("x1"), F.col("ord").alias("depth"), *clip))

    @r.add(
        "w18_combs",
        f"""
        WITH b AS (SELECT doc, page, ord * 20 + p % 5 AS x0, ord * 20 + p % 5 + 10 + p % 6 AS x1, 20 * (s % 2) AS y0, 20 * (s % 2) + 12 AS y1 FROM {DRAWN_SQL}),
        g AS (SELECT *, coalesce(x0 - lag(x1) OVER w > 0.75 * least(lag(x1 - x0) OVER w, x1 - x0), false) AS cut FROM b WINDOW w AS (PARTITION BY doc, page, y0 ORDER BY x0)),
        u AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc, page, y0 ORDER BY x0) AS run FROM g),
        n AS (SELECT doc, page, y0, run, count(*) AS k, count(*) FILTER (WHERE (x1 - x0) / 12.0 > 0.75 AND (x1 - x0) / 12.0 < 1.34) AS sq, min(x0) AS x0, max(x1) AS x1 FROM u GROUP BY ALL)
        SELECT doc, page, dense_rank() OVER (PARTITION BY doc, page ORDER BY y0 DESC) AS row, run::BIGINT AS run, CASE WHEN k >= 3 THEN 'comb' ELSE 'check' END AS kind, CASE WHEN k >= 3 THEN k ELSE sq END AS n, x0, x1 FROM n QUALIFY k >= 3 OR sq > 0
        """,
    )
    def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, y = F.col("ord") * 20 + F.col("p") % 5, 20 * (F.col("s") % 2)
        return audit.combs(drawn(spark, sf_dir).select("doc", "page", x.alias("x0"), (x + 10 + F.col("p") % 6).alias("x1"), y.alias("y0"), (y + 12).alias("y1")))

    @r.add(
        "w14_ruled_grids",
        f"""
        WITH h AS (SELECT doc, page, s % 2 * 200 AS x0, s % 2 * 200 + 150 AS x1, ord * 20 AS y FROM {DRAWN_SQL}), v AS (SELECT doc, page, p % 8 * 50 AS x, 0 AS a, q * 4 AS b FROM {DRAWN_SQL}),
        n AS (SELECT doc, page, x0, x1, min(y) AS y0, max(y) AS y1, count(DISTINCT y) AS lines FROM h GROUP BY doc, page, x0, x1 HAVING count(DISTINCT y) >= 2),
        c AS (SELECT n.doc, n.page, n.x0, count(DISTINCT x) AS edges FROM n JOIN v ON v.doc = n.doc AND v.page = n.page AND x BETWEEN x0 - 3 AND x1 + 3 AND 2 * (least(b, y1) - greatest(a, y0)) >= y1 - y0 GROUP BY ALL)
        SELECT doc, page, x0, x1, y0, y1, lines - 1 AS n_rows, edges - 1 AS n_columns FROM n JOIN c USING (doc, page, x0) WHERE edges >= 2
        """,
    )
    def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = drawn(spark, sf_dir)
        x = F.col("s") % 2 * 200
        return audit.ruled_grids(d.select("doc", "page", x.alias("x0"), (x + 150).alias("x1"), (F.col("ord") * 20).alias("y")), d.select("doc", "page", (F.col("p") % 8 * 50).alias("x"), F.lit(0).alias("y0"), (F.col("q") * 4).alias("y1")))

    @r.add(
        "w8_gutters",
        f"""
        WITH b AS (SELECT doc, page, s % 2 * 300 + p % 20 AS x0, s % 2 * 300 + p % 20 + 100 + q AS x1, ord * 14 AS y FROM {DRAWN_SQL}),
        g AS (SELECT DISTINCT doc, page, reach AS "left", x0 AS "right" FROM (SELECT *, max(x1) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b) WHERE x0 - reach >= 8),
        k AS (SELECT g.doc, g.page, "left", "right" FROM g JOIN b USING (doc, page) GROUP BY ALL HAVING count(DISTINCT y) FILTER (WHERE x1 <= "left") >= 2 AND count(DISTINCT y) FILTER (WHERE x0 >= "right") >= 2)
        SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY "right" - "left" DESC, "left") = 1
        """,
    )
    def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The gutter between two columns, from the boxes of what is drawn."""
        x = F.col("s") % 2 * 300 + F.col("p") % 20
        return audit.gutters(drawn(spark, sf_dir).select("doc", "page", x.alias("x0"), (x + 100 + F.col("q")).alias("x1"), (F.col("ord") * 14).alias("y0")), 8)

    @r.add(
        "w10_across_columns",
        f"""
        WITH e AS (SELECT doc, page, arg_max(trim(row_text), line) AS tail, arg_min(row_text, line) AS head FROM ({ROWS_SQL}) GROUP BY doc, page)
        SELECT doc, page FROM (SELECT *, lead(head) OVER (PARTITION BY doc ORDER BY page) AS nxt FROM e) WHERE tail <> '' AND NOT regexp_matches(tail, '[.!?:;»”")]$') AND regexp_matches(nxt, '^[a-zà-ÿ]')
        """,
    )
    def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Pages of wrapped documents as columns: where the last paragraph runs on at the head of the next."""
        edges = wrapped(spark, sf_dir).groupBy("doc", "page").agg(F.max_by(F.trim("row_text"), "line").alias("tail"), F.min_by("row_text", "line").alias("head"))
        after = F.lead("head").over(Window.partitionBy("doc").orderBy("page"))
        return edges.withColumn("after", after).where((F.col("tail") != "") & ~ends_sentence(F.col("tail")) & F.col("after").rlike("^[a-zà-ÿ]")).select("doc", "page")

    @r.add(
        "w19_text_units",
        f"""
        WITH b AS (SELECT *, coalesce(regexp_matches(lag(line) OVER w, '[.!?:;»”")]$') OR lag(line) OVER w = '' , true) AS brk FROM ({LINES_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        p AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS par FROM b), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, par) AS k FROM p)
        SELECT doc_id, min(line_no) AS first_line, count(*) AS n_lines, CASE WHEN any_value(k) > 1 THEN 'paragraph' ELSE 'line' END AS kind, sum(len(string_split(line, ' | '))::BIGINT)::BIGINT AS n_edit FROM n WHERE line <> '' GROUP BY doc_id, par
        """,
    )
    def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines of a paragraph together, every other line alone; and into how many pieces wide gaps cut them for edits."""
        w = Window.partitionBy("doc_id").orderBy("line_no")
        before = F.lag("line").over(w)
        runs = layout.islands(lines(spark, sf_dir), F.coalesce(ends_sentence(before) | (before == ""), F.lit(True)), w, "par")
        full = F.col("line") != ""
        units = runs.groupBy("doc_id", "par").agg(F.min(F.when(full, F.col("line_no"))).alias("first_line"), F.count_if(full).alias("n_lines"), F.count(F.lit(1)).alias("k"), F.sum(F.when(full, F.size(F.split("line", r" \| ", -1)))).alias("n_edit"))
        return units.where("n_lines > 0").select("doc_id", "first_line", "n_lines", F.when(F.col("k") > 1, "paragraph").otherwise("line").alias("kind"), "n_edit")

    phrase = "of the"

    @r.add("e4_editable_ranges", f'SELECT doc_id, match, min(line_no) AS line_no, min(start) AS start, min("end") AS "end" FROM ({r.sql["e2_match_pieces"]}) GROUP BY doc_id, match HAVING count(*) = 1')
    def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Only matches that stay on one line can be edited in place."""
        found = search.pieces(search.find_across_lines(table(spark, sf_dir, "documents"), phrase, "doc_id"), lines(spark, sf_dir), "doc_id")
        return found.groupBy("doc_id", "match").agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("line_no", "start", "end"))).where("n = 1").drop("n")

    style_sql = "list_transform(string_split(line, ' '), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN 'digits' WHEN regexp_matches(w, '^[A-Z]') THEN 'capital' ELSE 'plain' END)"

    @r.add("e6_style_runs", f"SELECT doc_id, line_no, len(list_distinct(st)) AS n_styles, 1 + len(list_filter(range(2, len(st) + 1), lambda i: st[i] <> st[i - 1])) AS n_runs, len(list_distinct(st)) <= 1 AS uniform FROM (SELECT doc_id, line_no, {style_sql} AS st FROM ({LINES_SQL}) WHERE line <> '')")
    def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Words of a line in styles (by their first letter): how many styles and runs, and whether one suffices."""
        style = lambda w: F.when(w.rlike("^[0-9]"), "digits").when(w.rlike("^[A-Z]"), "capital").otherwise("plain")
        rows = lines(spark, sf_dir).where("line <> ''").withColumn("st", F.transform(F.split("line", " ", -1), style))
        changes = F.zip_with(F.slice("st", F.lit(2), F.size("st")), F.slice("st", F.lit(1), F.size("st") - 1), lambda a, b: a != b)
        n = F.size(F.array_distinct("st"))
        return rows.select("doc_id", "line_no", n.cast("bigint").alias("n_styles"), (1 + F.size(F.filter(changes, lambda x: x))).cast("bigint").alias("n_runs"), (n <= 1).alias("uniform"))

    @r.add("k6_reading_order_text", "SELECT page_id, md5(array_to_string(l, '|')) AS text_md5, len(l) AS n_parts FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '>([^<]+)', 1) AS l FROM pages)")
    def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The text of a page's elements in the order of its structure."""
        plain = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
        rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all(plain, F.lit(">([^<]+)"), F.lit(1)).alias("l"))
        return rows.select("page_id", F.md5(F.array_join("l", "|").cast("binary")).alias("text_md5"), F.size("l").cast("bigint").alias("n_parts"))
