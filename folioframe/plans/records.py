"""Further queries of inventories, selections, destinations, edits, inherited values and verdicts.

Rows that the data directory lacks are derived in Spark from its tables, as each query says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers as N
from folioframe.functions.text import words
from folioframe.operators import geometry, search, trees
from folioframe.plans import Registry
from folioframe.plans.assembly import PAGES_SQL, page_table
from folioframe.plans.models import COMMENTS_SQL, ENGLISH, FIELDS_SQL, FRENCH, PIXELS_SQL, TAGS_SQL, comments, fields, pixels
from folioframe.plans.scalars import LINES_SQL, lines
from folioframe.plans.structure import WORDS_SQL
from folioframe.sources.scratch import ensure_checkpoints
from folioframe.sources.sinks import first_of_each
from folioframe.sources.tables import table

BOX_SQL = "SELECT l_orderkey, l_linenumber, l_suppkey AS page, l_partkey % 100 AS x0, l_orderkey % 80 AS y0, l_partkey % 100 + l_quantity::BIGINT AS x1, l_orderkey % 80 + 12 AS y1 FROM lineitem"
#: Private element names and the standard roles they stand for.
ROLES = {"article": "Art", "nav": "TOC", "footer": "Note", "p": "P", "h1": "H1", "ul": "L", "li": "LI", "a": "Link", "b": "Span", "div": "Div"}


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles written from line items: the supplier is the page."""
    x0, y0 = F.col("l_partkey") % 100, F.col("l_orderkey") % 80
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity").cast("bigint")).alias("x1"), (y0 + 12).alias("y1"))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a rectangle, 0 if it is turned inside out."""
    return F.greatest(x1 - x0, F.lit(0)) * F.greatest(y1 - y0, F.lit(0))


def nearest(rows: DataFrame, templates: DataFrame, best: int = 2, block: int = 1000) -> DataFrame:
    """(vec_id, label, k, d): the ``best`` templates (label, m) nearest to each row (vec_id, embedding).

    Rows stay where they are: each meets the templates in blocks of about ``block``, of which one at a time is sent to all
    tasks, and keeps the best of every block.
    """
    blocks = -(-templates.count() // block)
    kept = F.array().cast("array<struct<d:double,label:int>>")
    out = rows.withColumn("_best", kept)
    for k in range(blocks):
        some = templates.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k).agg(F.collect_list(F.struct("label", "m")).alias("_block"))
        square = lambda t: F.aggregate(F.zip_with("embedding", t["m"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
        found = F.transform("_block", lambda t: F.struct(F.sqrt(square(t)).alias("d"), t["label"].cast("int").alias("label")))
        out = out.crossJoin(F.broadcast(some)).withColumn("_best", F.slice(F.array_sort(F.concat("_best", found)), 1, best)).drop("_block")  # one row
    return out.select("vec_id", F.posexplode("_best").alias("_k", "s")).select("vec_id", "s.label", (F.col("_k") + 1).alias("k"), "s.d")


def register(r: Registry) -> None:
    @r.add(
        "a9_attachment_inventory",
        """SELECT doc, name, stream, src FROM (SELECT *, row_number() OVER (PARTITION BY doc, coalesce(stream, name) ORDER BY src, k) AS n FROM (
            SELECT c_custkey AS doc, 'seg' AS name, c_mktsegment AS stream, 0 AS src, 0 AS k FROM customer
            UNION ALL SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, 1, o_orderkey FROM orders)) WHERE n = 1""",
    )
    def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Attachments of documents (customers) and of pages (orders), none listed twice."""
        docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit("seg").alias("name"), F.col("c_mktsegment").alias("stream"), F.lit(0).alias("src"), F.lit(0).cast("bigint").alias("k"))
        pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("stream"), F.lit(1).alias("src"), F.col("o_orderkey").alias("k"))
        both = docs.unionByName(pages).withColumn("key", F.coalesce("stream", "name"))
        return first_of_each(both, ["doc", "key"], ["src", "k"]).select("doc", "name", "stream", "src")

    @r.add("a10_once_a_page", "SELECT page_id, t AS target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS t FROM pages) GROUP BY page_id, t")
    def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A resource that a page uses several times is listed once, with how often."""
        return search.hrefs(table(spark, sf_dir, "pages")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))

    @r.add("a11_media_kinds", "SELECT user_id AS page, CASE event_type WHEN 'click' THEN 'sound' WHEN 'view' THEN 'video' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
    def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = F.when(F.col("event_type") == "click", "sound").when(F.col("event_type") == "view", "video").otherwise("other")
        return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))

    @r.add("a13_upsert_delete", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS content FROM customer WHERE c_custkey % 7 <> 0")
    def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rows replaced by key and rows deleted by key; deletion wins."""
        old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("content"))
        put = old.where("c_custkey % 5 = 0").select("c_custkey", F.lit("new").alias("content"))
        gone = old.where("c_custkey % 7 = 0").select("c_custkey")
        return old.join(put, "c_custkey", "left_anti").unionByName(put).join(gone, "c_custkey", "left_anti")

    @r.add("b22_field_values", f"SELECT c_custkey, CASE kind WHEN 'check' THEN (lower(value) IN ('yes', 'building'))::VARCHAR WHEN 'choice' THEN array_to_string(string_split(lower(value), 'i'), '|') ELSE value END AS parsed FROM ({FIELDS_SQL})")
    def b22(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Text as a value of its field's kind: boxes as booleans, choices as lists."""
        kind, value = F.col("kind"), F.col("value")
        parsed = F.when(kind == "check", F.lower(value).isin("yes", "building").cast("string")).when(kind == "choice", F.array_join(F.split(F.lower(value), "i"), "|")).otherwise(value)
        return fields(spark, sf_dir).select("c_custkey", parsed.alias("parsed"))

    @r.add(
        "b23_rectangles",
        f"""
        WITH b AS (SELECT *, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM ({BOX_SQL}) WINDOW w AS (PARTITION BY page ORDER BY l_orderkey, l_linenumber, x0, x1))
        SELECT page, sum(greatest(least(x1, px1) - greatest(x0, px0), 0) * greatest(least(y1, py1) - greatest(y0, py0), 0))::BIGINT AS shared, sum((greatest(x1, px1) - least(x0, px0)) * (greatest(y1, py1) - least(y0, py0)))::BIGINT AS hull,
            count(*) FILTER (WHERE x0 >= px0 AND y0 >= py0 AND x1 <= px1 AND y1 <= py1) AS inside FROM b WHERE px0 IS NOT NULL GROUP BY page
        """,
    )
    def b23(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Intersection, union and containment of each rectangle with the one before it."""
        w = Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "x0", "x1")
        b = boxes(spark, sf_dir)
        for c in ("x0", "y0", "x1", "y1"):
            b = b.withColumn(f"p{c}", F.lag(c).over(w))
        shared = area(F.greatest("x0", "px0"), F.greatest("y0", "py0"), F.least("x1", "px1"), F.least("y1", "py1"))
        hull = area(F.least("x0", "px0"), F.least("y0", "py0"), F.greatest("x1", "px1"), F.greatest("y1", "py1"))
        inside = (F.col("x0") >= F.col("px0")) & (F.col("y0") >= F.col("py0")) & (F.col("x1") <= F.col("px1")) & (F.col("y1") <= F.col("py1"))
        return b.where("px0 IS NOT NULL").groupBy("page").agg(F.sum(shared).alias("shared"), F.sum(hull).alias("hull"), F.count_if(inside).alias("inside"))

    @r.add("c1_page_selection", f"SELECT doc, page, body FROM ({PAGES_SQL}) WHERE (doc, page) IN (SELECT (doc_id, (doc_id % 3 + 1)::BIGINT) FROM documents WHERE lang = 'en')")
    def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The pages that a selection of the documents names."""
        wanted = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 3 + 1).alias("page"))
        return page_table(spark, sf_dir).select("doc", "page", "body").join(wanted, ["doc", "page"], "left_semi")

    @r.add("c2_markup_filter", f"SELECT doc, idx, author FROM ({COMMENTS_SQL}) WHERE author = 'user' AND parent IS NOT NULL")
    def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comments(spark, sf_dir).where("author = 'user' AND parent IS NOT NULL").select("doc", "idx", "author")

    @r.add("c3_fillable", f"SELECT doc, count(*) AS n, count(DISTINCT kind) AS kinds FROM ({FIELDS_SQL}) WHERE NOT read_only AND kind IN ('text', 'check', 'radio', 'choice') GROUP BY doc")
    def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fields(spark, sf_dir).where("NOT read_only AND kind IN ('text', 'check', 'radio', 'choice')").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("kinds"))

    @r.add("c5_permission_gate", "SELECT o_orderkey FROM orders WHERE (o_custkey >> 4) & 1 = 1 OR o_orderstatus = 'O'")
    def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "orders").where((F.shiftright("o_custkey", 4).bitwiseAND(F.lit(1)) == 1) | (F.col("o_orderstatus") == "O")).select("o_orderkey")

    @r.add("c6_point_in_rectangle", f"SELECT page, s_suppkey % 100 AS x, 40 AS y, count(*) AS n, min(l_orderkey) AS first FROM supplier JOIN ({BOX_SQL}) ON page = s_suppkey AND s_suppkey % 100 BETWEEN x0 AND x1 AND 40 BETWEEN y0 AND y1 GROUP BY page, s_suppkey")
    def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rectangles of a page that hold a point: an equal key and two ranges."""
        points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_suppkey") % 100).alias("x"), F.lit(40).alias("y"))
        held = points.join(boxes(spark, sf_dir), "page").where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
        return held.groupBy("page", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first"))

    @r.add("p3_iban", "SELECT c_custkey, iban, (substr(iban, 5) || '1527' || substr(iban, 3, 2))::HUGEINT % 97 = 1 AS valid FROM (SELECT c_custkey, 'FR' || lpad((c_custkey % 97)::VARCHAR, 2, '0') || lpad((c_custkey * 7919)::VARCHAR, 20, '0') AS iban FROM customer)")
    def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Account numbers written from customer keys, with their check."""
        k = F.col("c_custkey")
        iban = F.concat(F.lit("FR"), F.lpad((k % 97).cast("string"), 2, "0"), F.lpad((k * 7919).cast("string"), 20, "0"))
        rows = table(spark, sf_dir, "customer").select("c_custkey", iban.alias("iban"))
        return rows.select("c_custkey", "iban", (N.mod97(F.concat(F.substr("iban", F.lit(5)), F.substring("iban", 1, 4))) == 1).alias("valid"))

    @r.add("p5_social_security", "SELECT c_custkey, 97 - (1000000000000 + c_custkey * 104729) % 97 = c_custkey % 97 + 1 AS valid FROM customer")
    def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Thirteen digits and a key, written from customer keys: the key is 97 less the remainder by 97."""
        n = F.lit(1000000000000) + F.col("c_custkey") * 104729
        number = F.concat(n.cast("string"), F.lpad((F.col("c_custkey") % 97 + 1).cast("string"), 2, "0"))
        return table(spark, sf_dir, "customer").select("c_custkey", (97 - F.substring(number, 1, 13).cast("bigint") % 97 == F.substring(number, 14, 2).cast("int")).alias("valid"))

    @r.add("p8_literal", "SELECT doc_id, (length(text) - length(regexp_replace(text, '(?i)erin', '', 'g'))) // 4 AS n FROM documents WHERE regexp_matches(text, '(?i)erin')")
    def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A literal, whatever its case, counted without overlap."""
        return table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)erin")).select("doc_id", F.size(F.regexp_extract_all("text", F.lit("(?i)erin"), F.lit(0))).cast("bigint").alias("n"))

    @r.add("p12_sanitise_report", "SELECT user_id, CASE event_type WHEN 'error' THEN 'scripts' WHEN 'purchase' THEN 'attachments' END AS category, count(*) AS removed FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2")
    def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What goes, by category of a small rule table."""
        table_of = spark.createDataFrame([("error", "scripts"), ("purchase", "attachments")], "event_type string, category string")
        return table(spark, sf_dir, "events").join(F.broadcast(table_of), "event_type").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("removed"))

    @r.add("p13_metadata_removal", "SELECT doc_id, k, v FROM (SELECT doc_id, unnest(['lang', 'source', 'n_chars']) AS k, unnest([lang, source, n_chars::VARCHAR]) AS v FROM documents) WHERE v IS NOT NULL")
    def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").withColumn("n", F.col("n_chars").cast("string"))
        return docs.select("doc_id", F.expr("stack(3, 'lang', lang, 'source', source, 'n_chars', n) AS (k, v)")).where("v IS NOT NULL")

    @r.add("l5_destinations", "SELECT o_orderkey, r_name AS page FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
    def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Destinations resolved over three hops; what is not found stays null."""
        t = lambda name: table(spark, sf_dir, name)
        out = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
        return out.select("o_orderkey", F.col("r_name").alias("page"))

    @r.add("l7_links_edited", "SELECT page_id, idx, t AS target FROM (SELECT page_id, unnest(l) AS t, (generate_subscripts(l, 1) - 1)::INT AS idx FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages)) WHERE idx <> 1 UNION ALL SELECT page_id, 999, url FROM pages")
    def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The second link of each page removed, and one to the page itself added."""
        pages = table(spark, sf_dir, "pages")
        links = search.hrefs(pages).select("page_id", "idx", "target")
        gone = links.where("idx = 1").select("page_id", "idx")
        return links.join(gone, ["page_id", "idx"], "left_anti").unionByName(pages.select("page_id", F.lit(999).alias("idx"), F.col("url").alias("target")))

    @r.add("g2_g3_insert", f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY place, page) AS page, body FROM (SELECT doc, page, CASE WHEN page < 2 THEN 0 ELSE 2 END AS place, body FROM ({PAGES_SQL}) UNION ALL SELECT doc_id, 1, 1, 'blank' FROM documents)")
    def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A page put in before the second page of each document."""
        new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).cast("bigint").alias("page"), F.lit("blank").alias("body"), F.lit(1).alias("place"))
        old = page_table(spark, sf_dir).select("doc", "page", "body", F.when(F.col("page") < 2, 0).otherwise(2).alias("place"))
        return old.unionByName(new).select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("place", "page")).cast("bigint").alias("page"), "body")

    @r.add("g8_replace", f"SELECT a.doc, a.page, coalesce(b.body, a.body) AS body FROM ({PAGES_SQL}) a LEFT JOIN ({PAGES_SQL}) b ON b.doc = a.doc + 1 AND b.page = a.page AND a.page % 2 = 0")
    def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Even pages replaced by those of the next document, where it has them."""
        p = page_table(spark, sf_dir).select("doc", "page", "body")
        source = p.where("page % 2 = 0").select((F.col("doc") - 1).alias("doc"), "page", F.col("body").alias("new"))
        return p.join(source, ["doc", "page"], "left").select("doc", "page", F.coalesce("new", "body").alias("body"))

    wanted = ["II", " 2 ", "annex-a", "zzz"]
    wanted_sql = ", ".join(f"('{w}')" for w in wanted)

    @r.add("n2_label_lookup", f"SELECT doc, wanted, arg_min(page, page + CASE WHEN label = trim(wanted) THEN 0 ELSE 1000000000 END) AS page FROM ({r.sql['n1_page_labels']}) JOIN (VALUES {wanted_sql}) w(wanted) ON lower(label) = lower(trim(wanted)) GROUP BY doc, wanted")
    def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The page of each document that a label names: the same letters first, then whatever their case; the first page wins."""
        asked = spark.createDataFrame([(w, w.strip().lower()) for w in wanted], "wanted string, k string")
        hits = r.queries["n1_page_labels"](spark, sf_dir).join(F.broadcast(asked), F.lower("label") == F.col("k"))
        return hits.groupBy("doc", "wanted").agg(F.min_by("page", F.struct(F.col("label") != F.trim("wanted"), F.col("page"))).alias("page"))

    @r.add("n3_range_clean_up", "SELECT doc, first_page, style FROM (SELECT doc, first_page, arg_min(style, k) AS style FROM (SELECT o_custkey AS doc, o_orderkey % 5 AS first_page, o_orderpriority AS style, o_orderkey AS k FROM orders) GROUP BY doc, first_page) UNION ALL SELECT o_custkey, 0, 'D' FROM orders GROUP BY o_custkey HAVING min(o_orderkey % 5) > 0")
    def n3(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Label ranges written from orders: one for each first page, and one at page 0 where there is none."""
        ranges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 5).alias("first_page"), F.col("o_orderpriority").alias("style"), F.col("o_orderkey").alias("k"))
        clean = first_of_each(ranges, ["doc", "first_page"], ["k"]).drop("k")
        missing = ranges.groupBy("doc").agg(F.min("first_page").alias("m")).where("m > 0").select("doc", F.lit(0).cast("bigint").alias("first_page"), F.lit("D").alias("style"))
        return clean.unionByName(missing)

    @r.add("n7_stamps_removed", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS removed, count(*) FILTER (WHERE event_type <> 'view') AS kept FROM events GROUP BY user_id")
    def n7(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = F.col("event_type") == "view"
        return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(view).alias("removed"), F.count_if(~view).alias("kept"))

    @r.add("k5_inherited", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN n_nationkey % 3 = 0 THEN n_name ELSE r_name END AS box FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
    def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The nearest ancestor's value: customers under nations under regions, only some with one of their own."""
        t = lambda name: table(spark, sf_dir, name)
        chain = t("customer").join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t("region")), F.col("r_regionkey") == F.col("n_regionkey"))  # of fixed size
        return chain.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")), "r_name").alias("box"))

    roles_sql = "CASE tag " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items()) + " ELSE tag END"

    @r.add("k7_role_map", f"SELECT {roles_sql} AS role, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM ({TAGS_SQL}) WHERE NOT closing GROUP BY 1")
    def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = spark.createDataFrame(list(ROLES.items()), "tag string, role string")
        rows = trees.tags(table(spark, sf_dir, "pages")).where("NOT closing").join(F.broadcast(known), "tag", "left")
        return rows.groupBy(F.coalesce("role", "tag").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))

    @r.add("k8_auto_tag", f"SELECT role, count(*) AS n FROM (SELECT CASE WHEN contains(line, ' | ') THEN 'Table' WHEN length(line) < 30 THEN 'H' || dense_rank() OVER (PARTITION BY doc_id, length(line) < 30 AND NOT contains(line, ' | ') ORDER BY length(line) // 10 DESC) ELSE 'P' END AS role FROM ({LINES_SQL})) GROUP BY role")
    def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Roles of lines: tables by their bars, short lines as headings of compacted levels, others paragraphs."""
        bars, short = F.contains("line", F.lit(" | ")), F.length("line") < 30
        level = F.dense_rank().over(Window.partitionBy("doc_id", short & ~bars).orderBy(F.floor(F.length("line") / 10).desc()))
        role = F.when(bars, "Table").when(short, F.concat(F.lit("H"), level.cast("string"))).otherwise("P")
        return lines(spark, sf_dir).withColumn("role", role).groupBy("role").agg(F.count(F.lit(1)).alias("n"))

    @r.add("m4_m7_replies_added", f"SELECT doc, idx, parent, author FROM ({COMMENTS_SQL}) UNION ALL SELECT doc, max(idx) + 1, min(idx), 'reviewer' FROM ({COMMENTS_SQL}) GROUP BY doc")
    def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A reply to the first comment of each document, numbered after the last."""
        c = comments(spark, sf_dir)
        new = c.groupBy("doc").agg((F.max("idx") + 1).alias("idx"), F.min("idx").alias("parent")).withColumn("author", F.lit("reviewer"))
        return c.select("doc", "idx", "parent", "author").unionByName(new)

    @r.add("m5_properties_changed", f"SELECT doc, idx, CASE WHEN idx % 4 = 0 THEN 'moderator' ELSE author END AS author, parent FROM ({COMMENTS_SQL})")
    def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Only the given properties change."""
        c = comments(spark, sf_dir).select("doc", "idx", "author", "parent")
        changes = c.where("idx % 4 = 0").select("doc", "idx", F.lit("moderator").alias("a"), F.lit(None).cast("bigint").alias("p"))
        return c.join(changes, ["doc", "idx"], "left").select("doc", "idx", F.coalesce("a", "author").alias("author"), F.coalesce("p", "parent").alias("parent"))

    @r.add("i3_metadata_set", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE lang END AS lang FROM documents")
    def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A null removes a value, an empty text stays one."""
        k = F.col("doc_id") % 4
        return table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, F.lit(None)).when(k == 1, "").otherwise(F.col("lang")).alias("lang"))

    @r.add("i4_signatures", f"SELECT doc, count(*) AS n, count(*) FILTER (WHERE value <> 'HOUSEHOLD') AS signed FROM ({FIELDS_SQL}) WHERE kind = 'signature' GROUP BY doc")
    def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fields(spark, sf_dir).where("kind = 'signature'").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") != "HOUSEHOLD").alias("signed"))

    @r.add("i9_coverage", "SELECT o_orderkey, o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 AS whole FROM orders")
    def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Byte ranges written from orders: two, the first from 0, the last to the file's end, and only the signature between."""
        k = F.col("o_orderkey")
        size = F.lit(1000) + k
        ranges = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(100).cast("bigint").alias("len")), F.struct(F.when(k % 3 == 0, 300).otherwise(164).cast("bigint").alias("start"), (size - F.when(k % 3 == 0, 300).otherwise(164) - F.when(k % 5 == 0, 7).otherwise(0)).alias("len")))
        rows = table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"), ranges.alias("r"))
        one, two = F.get("r", 0), F.get("r", 1)
        whole = (F.size("r") == 2) & (one["start"] == 0) & (two["start"] + two["len"] == F.col("size")) & (two["start"] - one["len"] == 64)
        return rows.select("o_orderkey", whole.alias("whole"))

    @r.add("i11_verdicts", "SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS valid, count(*) AS n FROM lineitem GROUP BY l_orderkey")
    def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("valid"), F.count(F.lit(1)).alias("n"))

    @r.add("u6_heading_levels", f"SELECT doc, ord, level, CASE WHEN prev IS NULL THEN 'first' ELSE 'jump' END AS rule FROM (SELECT *, lag(level) OVER (PARTITION BY doc ORDER BY ord) AS prev FROM (SELECT doc_id AS doc, line_no AS ord, (length(line) % 4 + 1)::INT AS level FROM ({LINES_SQL}))) WHERE prev IS NULL AND level <> 1 OR level > prev + 1")
    def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines as headings: the first not of level 1, and jumps of more than one."""
        rows = lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("line_no").alias("ord"), (F.length("line") % 4 + 1).alias("level"))
        prev = F.lag("level").over(Window.partitionBy("doc").orderBy("ord"))
        return rows.withColumn("prev", prev).where("prev IS NULL AND level <> 1 OR level > prev + 1").select("doc", "ord", "level", F.when(F.col("prev").isNull(), "first").otherwise("jump").alias("rule"))

    listed = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"

    @r.add(
        "u15_passage_language",
        f"""
        WITH c AS (SELECT doc_id, line_no, len(list_filter(w, lambda x: x IN {listed(FRENCH)})) AS fr, len(list_filter(w, lambda x: x IN {listed(ENGLISH)})) AS en FROM (SELECT doc_id, line_no, {WORDS_SQL.format('line')} AS w FROM ({LINES_SQL}) WHERE length(line) >= 40)),
        v AS (SELECT doc_id, line_no, CASE WHEN fr >= 3 AND fr >= 1.5 * en THEN 'fr' WHEN en >= 3 AND en >= 1.5 * fr THEN 'en' END AS voted FROM c)
        SELECT doc_id, line_no, voted, lang FROM v JOIN documents USING (doc_id) WHERE voted <> lang
        """,
    )
    def u15(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Long lines whose function words speak for another language than the document's."""
        w = words(F.col("line"))
        hits = lambda known: F.size(F.filter(w, lambda x: x.isin(known)))
        c = lines(spark, sf_dir).where("length(line) >= 40").select("doc_id", "line_no", hits(FRENCH).alias("fr"), hits(ENGLISH).alias("en"))
        voted = F.when((F.col("fr") >= 3) & (F.col("fr") >= 1.5 * F.col("en")), "fr").when((F.col("en") >= 3) & (F.col("en") >= 1.5 * F.col("fr")), "en")
        return c.select("doc_id", "line_no", voted.alias("voted")).where("voted IS NOT NULL").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("voted <> lang")

    @r.add("x5_nearest_template", """
        WITH c AS (SELECT label, list_transform(range(1, 1 + any_value(len(embedding))), lambda i: list_avg(list_transform(list(embedding), lambda e: e[i]::DOUBLE))) AS m FROM embeddings GROUP BY label),
        d AS (SELECT vec_id, c.label, sqrt(list_sum(list_transform(range(1, len(m) + 1), lambda i: (embedding[i]::DOUBLE - m[i]) * (embedding[i]::DOUBLE - m[i])))) AS d FROM embeddings CROSS JOIN c)
        SELECT vec_id, label, k::INT AS k, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS k FROM d) WHERE k <= 2""")
    def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The best and second best label by distance from its mean, compared with a block of labels at a time."""
        rows = table(spark, sf_dir, "embeddings")
        parts = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
        means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
        return nearest(rows.select("vec_id", "embedding"), means).select("vec_id", "label", "k", F.round("d", 6).alias("distance"))

    @r.add("p6_french_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found FROM orders")
    def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Dates found in sentences written from orders: 1er janvier 2024, or 3/2/2024."""
        months = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
        date, day = F.col("o_orderdate"), F.dayofmonth("o_orderdate")
        spelt = F.concat(F.when(day == 1, "1er").otherwise(day.cast("string")), F.lit(" "), F.element_at(F.array(*map(F.lit, months)), F.month(date)), F.lit(" "), F.year(date).cast("string"))
        short = F.concat_ws("/", day.cast("string"), F.month(date).cast("string"), F.year(date).cast("string"))
        rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("le "), F.when(F.col("o_orderkey") % 2 == 0, spelt).otherwise(short), F.lit(".")).alias("line"))
        form = r"([0-9]{1,2})(?:er)? (" + "|".join(months) + r") ([0-9]{4})"
        month = F.array_position(F.array(*map(F.lit, months)), F.regexp_extract("line", form, 2)).cast("int")
        named = F.make_date(F.regexp_extract("line", form, 3).try_cast("int"), F.nullif(month, F.lit(0)), F.regexp_extract("line", form, 1).try_cast("int"))
        digits = r"([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{4})"
        part = lambda k: F.regexp_extract("line", digits, k).try_cast("int")
        return rows.select("o_orderkey", F.date_format(F.coalesce(named, F.make_date(part(4), part(3), part(1))), "yyyy-MM-dd").alias("found"))

    zone_sql = "SELECT s_suppkey AS page, s_suppkey % 60 AS zx0, s_suppkey % 60 + 20 AS zx1 FROM supplier"

    @r.add("p11_overlap_removal", f"SELECT page, l_orderkey, l_linenumber, x0 FROM ({BOX_SQL}) b WHERE NOT EXISTS (SELECT 1 FROM ({zone_sql}) z WHERE z.page = b.page AND b.x0 < zx1 AND b.x1 > zx0 AND b.y0 < 40 AND b.y1 > 10)")
    def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rectangles that a zone of their page touches are gone."""
        k = F.col("s_suppkey")
        b = boxes(spark, sf_dir).withColumn("page", F.col("page").cast("bigint"))
        zones = table(spark, sf_dir, "supplier").select(k.alias("page"), (k % 60).alias("x0"), F.lit(10).alias("y0"), (k % 60 + 20).alias("x1"), F.lit(40).alias("y1"))
        met = geometry.overlapping(b, zones, ["page"]).where("x0 < o_x1 AND x1 > o_x0 AND y0 < 40 AND y1 > 10")
        rows = ["page", "l_orderkey", "l_linenumber"]
        return b.join(met.select(*rows, *geometry.BOX), [*rows, *geometry.BOX], "left_anti").select(*rows, "x0")

    @r.add("g13_split_by_groups", f"SELECT doc, page, (page % 3)::BIGINT AS part FROM ({PAGES_SQL}) WHERE page <= 6")
    def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Pages dealt into given groups; group members beyond the document's pages are rejected."""
        groups = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(6).cast("bigint"))).alias("page"))
        return groups.join(page_table(spark, sf_dir).select("doc", "page"), ["doc", "page"], "left_semi").select("doc", "page", (F.col("page") % 3).alias("part"))

    @r.add(
        "l3_autolink",
        """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS t FROM pages),
        c AS (SELECT page_id, '/' || split_part(trim(label), ' ', 1) AS t FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a>', 1)) AS label FROM pages))
        SELECT page_id, count(*) AS n, count(*) FILTER (WHERE (page_id, t) NOT IN (SELECT (page_id, t) FROM h)) AS added FROM c GROUP BY page_id""",
    )
    def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Candidate links of each page, one for each entry of its lists, less those that it has already."""
        pages = table(spark, sf_dir, "pages")
        have = search.hrefs(pages).select("page_id", F.col("target").alias("t")).distinct().withColumn("have", F.lit(True))
        labels = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<li><a[^>]*>([^<]*)</a>"), F.lit(1))).alias("label"))
        name = F.element_at(F.split(F.trim("label"), " "), 1)
        found = labels.select("page_id", F.concat(F.lit("/"), name).alias("t")).join(have, ["page_id", "t"], "left")
        return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("have").isNull()).alias("added"))

    @r.add(
        "k4_subtree_removed",
        f"""WITH RECURSIVE c AS ({COMMENTS_SQL}), g AS (SELECT doc, idx FROM c WHERE idx = 2 UNION ALL SELECT c.doc, c.idx FROM g JOIN c ON c.doc = g.doc AND c.parent = g.idx)
        SELECT doc, idx, row_number() OVER (PARTITION BY doc, parent ORDER BY idx) AS ord FROM c WHERE (doc, idx) NOT IN (SELECT (doc, idx) FROM g)""",
    )
    def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Nodes of each tree left when the branch under node 2 is taken out, siblings numbered anew."""
        ensure_checkpoints(spark)
        nodes = comments(spark, sf_dir).select("doc", "idx", "parent")
        out = trees.threads(nodes).where(F.col("path").rlike("(^|/)000000002(/|$)")).select("doc", "idx")
        left = nodes.join(out, ["doc", "idx"], "left_anti")
        return left.select("doc", "idx", F.row_number().over(Window.partitionBy("doc", "parent").orderBy("idx")).cast("bigint").alias("ord"))

    @r.add("t1_t2_orders", f"SELECT page, l_orderkey, l_linenumber, x0, row_number() OVER (PARTITION BY page ORDER BY y1 DESC, x0, l_orderkey, l_linenumber, x1) AS place FROM ({BOX_SQL})")
    def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Reading order: from top to bottom, then from left to right."""
        w = Window.partitionBy("page").orderBy(F.desc("y1"), "x0", "l_orderkey", "l_linenumber", "x1")
        return boxes(spark, sf_dir).select("page", "l_orderkey", "l_linenumber", "x0", F.row_number().over(w).cast("bigint").alias("place"))

    @r.add("u9_reading_order", f"WITH a AS (SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY idx) AS i, row_number() OVER (PARTITION BY doc ORDER BY length(contents), idx) AS j FROM ({COMMENTS_SQL})) SELECT doc, min(i) FILTER (WHERE i <> j) AS first_difference FROM a GROUP BY doc")
    def u9(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The first place at which two orders of a document's items differ."""
        rank = lambda *by: F.row_number().over(Window.partitionBy("doc").orderBy(*by)).cast("bigint")
        a = comments(spark, sf_dir).select("doc", rank("idx").alias("i"), rank(F.length("contents"), "idx").alias("j"))
        return a.groupBy("doc").agg(F.min(F.when(F.col("i") != F.col("j"), F.col("i"))).alias("first_difference"))

    cell_sql = f"SELECT DISTINCT image * 1000 + (x // 8) * 10 + y // 8 AS id, image, x // 8 AS cx, y // 8 AS cy FROM ({PIXELS_SQL}) WHERE r > 200 AND g > 60"

    @r.add(
        "x2_regions",
        f"""
        WITH RECURSIVE c AS ({cell_sql}), e AS (SELECT p.id AS a, q.id AS b FROM c p JOIN c q ON p.image = q.image AND abs(p.cx - q.cx) <= 1 AND abs(p.cy - q.cy) <= 1 AND p.id <> q.id),
        t(a, b) AS (SELECT id, id FROM c UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
        SELECT image, region, count(*) AS n_cells, min(cx)::BIGINT AS x0, min(cy)::BIGINT AS y0, max(cx)::BIGINT AS x1, max(cy)::BIGINT AS y1 FROM (SELECT a AS id, min(b) AS region FROM t GROUP BY a) JOIN c USING (id) GROUP BY image, region
        """,
    )
    def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Cells of marked pixels in connected regions, with their boxes."""
        ensure_checkpoints(spark)
        cx, cy = F.floor(F.col("x") / 8), F.floor(F.col("y") / 8)
        c = pixels(spark, sf_dir).where("r > 200 AND g > 60").select((F.col("image") * 1000 + cx * 10 + cy).alias("id"), "image", cx.alias("cx"), cy.alias("cy")).distinct().checkpoint()
        # each cell meets the nine places around it, so that cells far apart are never paired
        around = F.array(*[F.struct((F.col("cx") + dx).alias("qx"), (F.col("cy") + dy).alias("qy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        near = c.select(F.col("id").alias("a"), "image", F.explode(around).alias("q")).select("a", "image", "q.*")
        edges = near.join(c.select(F.col("id").alias("b"), "image", F.col("cx").alias("qx"), F.col("cy").alias("qy")), ["image", "qx", "qy"]).where("a < b").select("a", "b")
        found = trees.regions(c, edges).join(c, "id")
        return found.groupBy("image", "region").agg(F.count(F.lit(1)).alias("n_cells"), F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.max("cx").alias("x1"), F.max("cy").alias("y1"))
