"""Queries of trees, forms, comments, metadata, rules, pixels, graphs, orders and streams.

Tables that the data directory lacks are derived in Spark from those it has: threads from conversations, fields from
customers, pixels from line items, objects from orders, revisions from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions.text import words
from folioframe.operators import forms, ranges, rules, trees
from folioframe.plans import Registry
from folioframe.plans.scalars import LINES_SQL, lines
from folioframe.plans.structure import WORDS_SQL
from folioframe.sources.scratch import ensure_checkpoints
from folioframe.sources.tables import table

TAGS_SQL = """SELECT page_id, i - 1 AS ord, lower(replace(raw, '/', '')) AS tag, raw LIKE '/%' AS closing FROM (
    SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1) AS l FROM pages))
    WHERE lower(replace(raw, '/', '')) NOT IN ('br', 'hr', 'img', 'input', 'link', 'meta', 'area', 'base', 'col', 'embed', 'source', 'track', 'wbr')"""
#: Function words by which French and English are told apart.
FRENCH = "le la les de des du et en un une que qui dans pour par sur au aux ne pas est il elle ce".split()
ENGLISH = "the of and to in a is that for it as was with be by on not he his but at are this have".split()

FIELDS_SQL = """SELECT (c_custkey // 10) AS doc, 'f' || (c_custkey % 4) || CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '' END AS name, ['text', 'check', 'radio', 'choice', 'button', 'signature'][(c_custkey % 6 + 1)::INT] AS kind,
    c_custkey % 7 = 0 AS read_only, c_mktsegment AS value, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'none' END AS "default", CASE WHEN c_custkey % 6 = 3 THEN ['BUILDING', 'MACHINERY'] ELSE [] END AS options, c_custkey FROM customer"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields, written from customers: ten to a document, some of the same name."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("f"), (k % 4).cast("string"), F.when(k % 5 == 0, "x").otherwise(""))
    kind = F.element_at(F.array(*map(F.lit, ["text", "check", "radio", "choice", "button", "signature"])), (k % 6 + 1).cast("int"))
    options = F.when(k % 6 == 3, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(F.floor(k / 10).alias("doc"), name.alias("name"), kind.alias("kind"), (k % 7 == 0).alias("read_only"), F.col("c_mktsegment").alias("value"), F.when(k % 3 != 0, "none").alias("default"), options.alias("options"), "c_custkey")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, written from conversations: a turn answers the turn half as far, the first is a root."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent"), F.col("role").alias("author"), F.col("text").alias("contents"))


COMMENTS_SQL = "SELECT conv_id AS doc, turn AS idx, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, role AS author, text AS contents FROM conversations"
PIXELS_SQL = "SELECT l_suppkey AS image, l_orderkey % 64 AS x, l_partkey % 48 AS y, max(l_quantity::INT * 5) AS r, max((l_discount * 1000)::INT) AS g, max((l_tax * 1000)::INT) AS b FROM lineitem GROUP BY 1, 2, 3"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") % 64).alias("x"), (F.col("l_partkey") % 48).alias("y")).agg(
        F.max(F.col("l_quantity").cast("int") * 5).alias("r"), F.max(F.round(F.col("l_discount") * 1000).cast("int")).alias("g"), F.max(F.round(F.col("l_tax") * 1000).cast("int")).alias("b")
    )


def register(r: Registry) -> None:
    # trees
    @r.add("k1_tags", TAGS_SQL)
    def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
        return trees.tags(table(spark, sf_dir, "pages")).withColumn("ord", F.col("ord").cast("long"))

    @r.add("k1_depths", f"SELECT page_id, tag, max(depth) AS deepest, count(*) AS n FROM (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY ord) AS depth FROM ({TAGS_SQL})) WHERE NOT closing GROUP BY page_id, tag")
    def k1d(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How deep each kind of element stands, by a running sum of openings and closings."""
        w = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        rows = trees.tags(table(spark, sf_dir, "pages")).withColumn("depth", F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(w))
        return rows.where("NOT closing").groupBy("page_id", "tag").agg(F.max("depth").alias("deepest"), F.count(F.lit(1)).alias("n"))

    @r.add("k2_headings", "SELECT page_id, i - 1 AS k, regexp_extract(h, '^<h([1-6])', 1)::INT AS level, regexp_replace(h, '<[^>]*>', '', 'g') AS title FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6]>.*?</h[1-6]>') AS l FROM pages))")
    def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<h[1-6]>.*?</h[1-6]>"), F.lit(0))).alias("k", "h"))
        return rows.select("page_id", F.col("k").cast("long").alias("k"), F.regexp_extract("h", "^<h([1-6])", 1).cast("int").alias("level"), F.regexp_replace("h", "<[^>]*>", "").alias("title"))

    level_sql = f"SELECT doc_id AS doc, line_no AS ord, (length(line) % 4 + 1)::INT AS level FROM ({LINES_SQL})"

    @r.add("k3_nest_headings", f"WITH m AS ({level_sql}) SELECT a.doc, a.ord, a.level, max(b.ord) AS parent FROM m a LEFT JOIN m b ON b.doc = a.doc AND b.ord < a.ord AND b.level < a.level GROUP BY ALL")
    def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lines as headings (level by length) under the nearest earlier one of a lower level."""
        rows = lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("line_no").alias("ord"), (F.length("line") % 4 + 1).alias("level"))
        return trees.nested(rows, ["doc"])

    def listed(ws):  # words of a list, as SQL
        return "(" + ", ".join(f"'{w}'" for w in ws) + ")"

    @r.add(
        "k9_language_votes",
        f"""
        WITH c AS (SELECT doc_id, lang, len(list_filter(w, lambda x: x IN {listed(FRENCH)})) AS fr, len(list_filter(w, lambda x: x IN {listed(ENGLISH)})) AS en FROM (SELECT doc_id, lang, {WORDS_SQL.format('text')} AS w FROM documents))
        SELECT lang, CASE WHEN fr >= 3 AND fr >= 1.5 * en THEN 'fr' WHEN en >= 3 AND en >= 1.5 * fr THEN 'en' END AS voted, count(*) AS n FROM c GROUP BY ALL
        """,
    )
    def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Languages by function words, against those given."""
        w = words(F.col("text"))
        hits = lambda known: F.size(F.filter(w, lambda x: x.isin(known)))
        c = table(spark, sf_dir, "documents").select("lang", hits(FRENCH).alias("fr"), hits(ENGLISH).alias("en"))
        voted = F.when((F.col("fr") >= 3) & (F.col("fr") >= 1.5 * F.col("en")), "fr").when((F.col("en") >= 3) & (F.col("en") >= 1.5 * F.col("fr")), "en")
        return c.groupBy("lang", voted.alias("voted")).agg(F.count(F.lit(1)).alias("n"))

    # forms
    @r.add("r1_a3_field_inventory", f"SELECT doc, name, kind, value FROM ({FIELDS_SQL}) WHERE NOT read_only AND kind NOT IN ('button', 'signature') AND value IS NOT NULL")
    def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Exportable fields and their values."""
        return fields(spark, sf_dir).where("NOT read_only AND kind NOT IN ('button', 'signature') AND value IS NOT NULL").select("doc", "name", "kind", "value")

    @r.add("r2_fill", f"SELECT c_custkey, CASE WHEN ok THEN 'BUILDING' ELSE value END AS value, ok AS changed FROM (SELECT *, NOT read_only AND kind IN ('text', 'check', 'radio', 'choice') AND value <> 'BUILDING' AND doc % 2 = 0 AND name = 'f1' AND (len(options) = 0 OR list_contains(options, 'BUILDING')) AS ok FROM ({FIELDS_SQL}))")
    def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = fields(spark, sf_dir)
        values = f.where("doc % 2 = 0 AND name = 'f1'").select("doc", "name").distinct().withColumn("new_value", F.lit("BUILDING"))
        return forms.fill(f, values).select("c_custkey", "value", "changed")

    @r.add("r3_reset", f"""SELECT c_custkey, CASE WHEN ok THEN coalesce("default", '') ELSE value END AS value, ok AS changed FROM (SELECT *, NOT read_only AND kind IN ('text', 'check', 'radio', 'choice') AND value IS DISTINCT FROM coalesce("default", '') AS ok FROM ({FIELDS_SQL}))""")
    def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
        return forms.reset(fields(spark, sf_dir)).select("c_custkey", "value", "changed")

    @r.add("r4_tab_order", f"SELECT c_custkey, row_number() OVER (PARTITION BY doc ORDER BY name, kind, c_custkey) AS stop FROM ({FIELDS_SQL}) WHERE kind <> 'signature'")
    def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = Window.partitionBy("doc").orderBy("name", "kind", "c_custkey")
        return fields(spark, sf_dir).where("kind <> 'signature'").select("c_custkey", F.row_number().over(w).cast("long").alias("stop"))

    @r.add("r5_merge_names", f"SELECT doc, name, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS new_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc) AS k FROM (SELECT DISTINCT doc, name FROM ({FIELDS_SQL})))")
    def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
        return forms.merged_names(fields(spark, sf_dir).select("doc", "name").distinct())

    # comments
    @r.add("m1_annotation_inventory", f"SELECT doc, idx, parent, author, length(contents) AS n_chars, parent IS NOT NULL AS is_reply FROM ({COMMENTS_SQL})")
    def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comments(spark, sf_dir).select("doc", "idx", "parent", "author", F.length("contents").cast("long").alias("n_chars"), F.col("parent").isNotNull().alias("is_reply"))

    @r.add(
        "m2_threads",
        f"""
        WITH RECURSIVE c AS ({COMMENTS_SQL}), t AS (SELECT doc, idx, idx AS root, 0 AS depth, lpad(idx::VARCHAR, 9, '0') AS path FROM c WHERE parent IS NULL
            UNION ALL SELECT c.doc, c.idx, t.root, t.depth + 1, t.path || '/' || lpad(c.idx::VARCHAR, 9, '0') FROM t JOIN c ON c.doc = t.doc AND c.parent = t.idx)
        SELECT * FROM t
        """,
    )
    def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoints(spark)
        return trees.threads(comments(spark, sf_dir).select("doc", "idx", "parent"))

    states_sql = "SELECT user_id AS doc, event_id % 5 AS target, CASE WHEN event_id % 2 = 0 THEN 'review' ELSE 'checked' END AS model, event_type AS state, event_id % 3 AS author, strftime(ts, '%Y%m%d%H') AS modified, event_id AS idx FROM events"

    @r.add("m3_latest_state", f"SELECT doc, target, model, state, author FROM (SELECT *, row_number() OVER (PARTITION BY doc, target, model ORDER BY modified DESC, idx DESC) AS k FROM ({states_sql})) WHERE k = 1")
    def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = F.col("event_id")
        states = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), (e % 5).alias("target"), F.when(e % 2 == 0, "review").otherwise("checked").alias("model"), F.col("event_type").alias("state"), (e % 3).alias("author"), F.date_format("ts", "yyyyMMddHH").alias("modified"), e.alias("idx"))
        return forms.latest_state(states)

    @r.add("m6_remove_thread", f"WITH RECURSIVE c AS ({COMMENTS_SQL}), g AS (SELECT doc, idx FROM c WHERE idx = 1 UNION ALL SELECT c.doc, c.idx FROM g JOIN c ON c.doc = g.doc AND c.parent = g.idx) SELECT doc, idx FROM c WHERE (doc, idx) NOT IN (SELECT (doc, idx) FROM g)")
    def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Comments without those of turn 1 and everything under it."""
        ensure_checkpoints(spark)
        c = comments(spark, sf_dir).select("doc", "idx", "parent")
        under = trees.threads(c).where(F.col("path").rlike("(^|/)000000001(/|$)")).select("doc", "idx")
        return c.join(under, ["doc", "idx"], "left_anti").select("doc", "idx")

    # metadata
    @r.add(
        "i1_i2_metadata",
        """SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, a.v IS NOT NULL AND b.v IS NOT NULL AND a.v <> b.v AS differs FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) a
        FULL JOIN (SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY o_custkey) b ON a.k = b.k""",
    )
    def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Values of two sources: the first wins, and where both differ."""
        a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("va"))
        b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("vb"))
        return a.join(b, "k", "full").select("k", F.coalesce("va", "vb").alias("v"), F.coalesce(F.col("va") != F.col("vb"), F.lit(False)).alias("differs"))

    @r.add("i5_first_seen", "SELECT p_brand AS font, p_type AS kind, min(l_orderkey) AS first_page, count(*) AS n, bool_or(l_returnflag = 'R') AS embedded FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
    def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        return li.groupBy(F.col("p_brand").alias("font"), F.col("p_type").alias("kind")).agg(F.min("l_orderkey").alias("first_page"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("embedded"))

    @r.add("i6_unmapped_ratio", "SELECT source, sum(length(text))::BIGINT AS total, sum(length(regexp_replace(text, '[\\x20-\\x7E\\n]', '', 'g')))::BIGINT AS unmapped FROM documents GROUP BY source")
    def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Characters beyond plain ASCII, by source."""
        return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("total"), F.sum(F.length(F.regexp_replace("text", r"[\x20-\x7E\n]", ""))).alias("unmapped"))

    @r.add("i7_t4_totals", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, grouping(source, lang) AS level FROM documents GROUP BY ROLLUP (source, lang)")
    def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"), F.grouping_id().alias("level"))

    @r.add("i8_checksum", "SELECT doc_id, md5(text) AS checksum, strlen(text) AS n_bytes, length(text) = n_chars AS as_declared FROM documents")
    def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("checksum"), F.octet_length("text").cast("long").alias("n_bytes"), (F.length("text") == F.col("n_chars")).alias("as_declared"))

    @r.add("i10_changed_since", "WITH v AS (SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_id < (SELECT max(event_id) // 2 FROM events)) AS before, arg_max(event_type, event_id) AS after FROM events GROUP BY user_id) SELECT user_id, before, after FROM v WHERE before IS DISTINCT FROM after")
    def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Objects whose newest revision is not that of the middle of the log."""
        e = table(spark, sf_dir, "events")
        cut = lambda df, name: df.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias(name))
        half = e.agg(F.floor(F.max("event_id") / 2).alias("half"))
        both = cut(e, "after").join(cut(e.join(F.broadcast(half)).where("event_id < half"), "before"), "user_id", "left")  # one row
        return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("user_id", "before", "after")

    # rules
    page_sql = "SELECT page_id AS doc, html FROM pages"
    ISSUES_SQL = f"""
        SELECT doc, 2 AS severity, 'lang' AS rule, NULL::BIGINT AS page, 'no language' AS message FROM ({page_sql}) WHERE NOT regexp_matches(html, '<html lang="[a-z]+"')
        UNION ALL SELECT doc, 2, 'title', NULL, 'no title' FROM ({page_sql}) WHERE trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) = ''
        UNION ALL SELECT page_id, 1, 'structure-types', NULL, tag FROM (SELECT DISTINCT page_id, tag FROM ({TAGS_SQL})) WHERE tag NOT IN ('html', 'head', 'title', 'body', 'p', 'h1', 'ul', 'li', 'a', 'article', 'nav', 'script', 'style')
        UNION ALL SELECT page_id, 1, 'link-alt', ord, 'short link text' FROM (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS ord FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS l FROM pages)) WHERE length(t) < 3
        UNION ALL SELECT page_id, 2, 'list-structure', NULL, 'list without items' FROM (SELECT page_id, count(*) FILTER (WHERE tag = 'ul' AND NOT closing) AS u, count(*) FILTER (WHERE tag = 'li' AND NOT closing) AS i FROM ({TAGS_SQL}) GROUP BY page_id) WHERE u > i"""

    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc")
        t = trees.tags(table(spark, sf_dir, "pages")).withColumnRenamed("page_id", "doc")
        known = ["html", "head", "title", "body", "p", "h1", "ul", "li", "a", "article", "nav", "script", "style"]
        links = p.select("doc", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("k", "t"))
        lists = t.where("NOT closing").groupBy("doc").agg(F.count_if(F.col("tag") == "ul").alias("u"), F.count_if(F.col("tag") == "li").alias("i"))
        parts = [
            rules.issues(p, ~F.col("html").rlike('<html lang="[a-z]+"'), 2, "lang", "no language"),
            rules.issues(p, F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)) == "", 2, "title", "no title"),
            rules.issues(t.select("doc", "tag").distinct(), ~F.col("tag").isin(known), 1, "structure-types", F.col("tag")),
            rules.issues(links, F.length("t") < 3, 1, "link-alt", "short link text", page=F.col("k") + 1),
            rules.issues(lists, F.col("u") > F.col("i"), 2, "list-structure", "list without items"),
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    @r.add("u1_u8_rules", ISSUES_SQL)
    def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Presence, type, link and list rules over web pages."""
        return found(spark, sf_dir)

    @r.add(
        "u16_report",
        f"""
        WITH i AS ({ISSUES_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY doc, rule ORDER BY page NULLS FIRST, message) AS k FROM i)
        SELECT doc, severity, rule, page, message FROM k WHERE k <= 2 UNION ALL SELECT doc, 0, rule, NULL, count(*) || ' more' FROM k WHERE k > 2 GROUP BY doc, rule
        """,
    )
    def u16(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.report(found(spark, sf_dir), 2)

    @r.add("u16_summary", f"SELECT severity, rule, count(*) AS n, count(DISTINCT doc) AS n_docs FROM ({ISSUES_SQL}) GROUP BY ROLLUP (severity, rule)")
    def u16s(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.summary(found(spark, sf_dir))

    @r.add("a6_report_json", f"SELECT doc, count(*) FILTER (WHERE severity = 2) AS errors, count(*) FILTER (WHERE severity = 1) AS warnings, count(*) FILTER (WHERE severity = 2) = 0 AS conforming FROM ({ISSUES_SQL}) GROUP BY doc")
    def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Issues of a document as one JSON report, and its counts read back from it."""
        whole = found(spark, sf_dir).groupBy("doc").agg(F.to_json(F.struct(F.collect_list(F.struct("severity", "rule", "page", "message")).alias("issues"))).alias("report"))
        back = whole.select("doc", F.from_json("report", "issues array<struct<severity:int,rule:string,page:bigint,message:string>>").alias("r"))
        n = lambda s: F.size(F.filter("r.issues", lambda i: i["severity"] == s)).cast("long")
        return back.select("doc", n(2).alias("errors"), n(1).alias("warnings"), (n(2) == 0).alias("conforming"))

    # pixels
    @r.add("x1_pixel_diff", f"WITH p AS ({PIXELS_SQL}) SELECT coalesce(a.image, b.image - 1) AS image, count(*) AS n, count(*) FILTER (WHERE a.x IS NULL OR b.x IS NULL OR greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b)) > 16) AS changed FROM (SELECT * FROM p WHERE image % 2 = 0) a FULL JOIN (SELECT * FROM p WHERE image % 2 = 1) b ON b.image = a.image + 1 AND a.x = b.x AND a.y = b.y GROUP BY 1")
    def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Pixels of neighbouring images that differ by more than 16 in a component, or stand on one side only."""
        p = pixels(spark, sf_dir)
        a = p.where("image % 2 = 0")
        b = p.where("image % 2 = 1").select((F.col("image") - 1).alias("image"), "x", "y", F.col("r").alias("r2"), F.col("g").alias("g2"), F.col("b").alias("b2"))
        far = F.greatest(F.abs(F.col("r") - F.col("r2")), F.abs(F.col("g") - F.col("g2")), F.abs(F.col("b") - F.col("b2"))) > 16
        return a.join(b, ["image", "x", "y"], "full").groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(far, F.lit(True))).alias("changed"))

    @r.add("x3_x4_ink", f"SELECT image, round(avg(255 - greatest(r, g, b)) / 2.55, 4) AS black, round(max((255 - r) + (255 - g) + (255 - b)) / 2.55, 4) AS most_ink FROM ({PIXELS_SQL}) GROUP BY image")
    def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
        ink = (255 - F.col("r")) + (255 - F.col("g")) + (255 - F.col("b"))
        return pixels(spark, sf_dir).groupBy("image").agg(F.round(F.avg(255 - F.greatest("r", "g", "b")) / 2.55, 4).alias("black"), F.round(F.max(ink) / 2.55, 4).alias("most_ink"))

    # graphs and revisions
    @r.add("o1_reachable", "SELECT 'c' || o_custkey AS id, 1 AS hops FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 UNION ALL SELECT 'o' || o_orderkey, 0 FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT DISTINCT 'n' || c_nationkey, 2 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT DISTINCT 'r' || n_regionkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'")
    def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Objects that some orders reach: customers, nations, regions."""
        ensure_checkpoints(spark)
        name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
        edges = (
            table(spark, sf_dir, "orders").select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst"))
            .unionByName(table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")))
            .unionByName(table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))
        )
        return trees.reachable(edges, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(name("o", "o_orderkey").alias("id")))

    @r.add("o2_unreferenced", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
    def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Customers that no urgent order refers to."""
        urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
        return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")

    @r.add("o3_footprint", "SELECT c_nationkey, count(DISTINCT c_custkey) AS n_customers, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS weight FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey")
    def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
        joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
        return joined.groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("n_customers"), F.count("o_orderkey").alias("n_orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("weight"))

    newest_sql = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'"

    @r.add("o4_latest_version", newest_sql)
    def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
        return trees.latest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error").select("user_id", "event_id", "event_type", "value")

    @r.add("o5_remap", "SELECT o_orderkey, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY o_custkey) + 1000 AS new_ref FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0 WHERE c_custkey IS NOT NULL UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_custkey % 4 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
    def o5(spark: SparkSession, sf_dir: str) -> DataFrame:
        """New ids of referred objects within a document (nation); references to those left behind are null."""
        used = table(spark, sf_dir, "orders").select("o_custkey").distinct()
        kept = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").join(used, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
        placed = ranges.row_numbers(kept.select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], "c_custkey", "k", ranges.range_bounds(table(spark, sf_dir, "customer"), "c_custkey"))
        ids = placed.select("c_custkey", (F.col("k") + 1000).alias("new_ref"))
        return table(spark, sf_dir, "orders").join(ids, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "new_ref")

    # orders
    @r.add("t3_largest", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
    def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The three largest documents of each source (a top-k report)."""
        w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
        return table(spark, sf_dir, "documents").withColumn("k", F.row_number().over(w)).where("k <= 3").select("source", "doc_id", "n_chars")

    @r.add("t4_cube", "SELECT quality, toxic, count(*) AS n, grouping(quality, toxic) AS level FROM labels GROUP BY CUBE (quality, toxic)")
    def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "labels").cube("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))

    @r.add("t5_first_wins", "SELECT text_md5, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, md5(text) AS text_md5 FROM documents) GROUP BY text_md5")
    def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Of equal texts the first document; minima are combined in the tasks, so copies don't pile up."""
        return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
