"""Queries of search, personal data, redaction and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import search
from folioframe.plans import Registry
from folioframe.plans.scalars import LINES_SQL, lines
from folioframe.sources.tables import dealt, table

KEYS = ["doc_id", "line_no"]
#: Lines made from customers that one task searches.
LINES_SEARCHED = 10_000


def _hits_sql(pattern: str) -> str:
    """Matches of a pattern by line, with their starts, found by splitting off each match in turn."""
    return f"""
    WITH RECURSIVE m(doc_id, line_no, rest, pos, hit, start) AS (
        SELECT doc_id, line_no, line, 0, NULL::VARCHAR, 0 FROM ({LINES_SQL}) WHERE regexp_matches(line, '{pattern}')
        UNION ALL
        SELECT doc_id, line_no, substr(rest, p + length(h)), pos + p - 1 + length(h), h, pos + p
        FROM (SELECT *, regexp_extract(rest, '{pattern}') AS h, instr(rest, regexp_extract(rest, '{pattern}')) AS p FROM m WHERE regexp_matches(rest, '{pattern}'))
    ) SELECT doc_id, line_no, start::INT AS start, (start + length(hit))::INT AS "end", hit FROM m WHERE hit IS NOT NULL"""


#: One line of text about each customer, with numbers written from its key, some of them wrong.
TELLING = """concat('Client ', k, ', tel. ', CASE k % 4 WHEN 0 THEN concat('0', 1 + k % 9, ' ', lpad(CAST(k * 7919 % 100000000 AS STRING), 8, '0')) WHEN 1 THEN concat('+33 6', lpad(CAST(k * 7919 % 100000000 AS STRING), 8, '0'))
    WHEN 2 THEN concat('0033-7', lpad(CAST(k * 7919 % 100000000 AS STRING), 8, '0'), '1') ELSE concat('12 0', 1 + k % 9, lpad(CAST(k * 7919 % 100000000 AS STRING), 8, '0')) END,
    ', IBAN FR', lpad(CAST(CASE WHEN k % 2 = 0 THEN 98 - (k * 7919 * 1000000 + 152700) % 97 ELSE k % 97 END AS STRING), 2, '0'), ' ', lpad(CAST(k * 7919 AS STRING), 20, '0'), ' ok, no ',
    1000000000000 + k * 104729, ' ', lpad(CAST(CASE WHEN k % 3 = 0 THEN 97 - (1000000000000 + k * 104729) % 97 ELSE k % 97 END AS STRING), 2, '0'), ', le ', 1 + k % 33, CASE k % 3 WHEN 0 THEN concat('/', 1 + k % 13, '/20', 10 + k % 80) WHEN 1 THEN concat(' mars ', 900 + k % 2200) ELSE concat('.', 1 + k % 13, '.', 10 + k % 80) END, '.')"""
TELLING_SQL = f"(SELECT k AS doc_id, 1 AS line_no, {TELLING} AS line FROM (SELECT c_custkey AS k FROM customer))"


def _national_sql(source: str) -> str:
    """Every place of the lines that no letter or digit precedes is tried, with the check of the kind."""
    compact = "upper(regexp_replace(hit, '[ \\x{A0}]', '', 'g'))"
    fold = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c[5:n] || c[1:4], ''), lambda ch: CASE WHEN ch BETWEEN '0' AND '9' THEN (ascii(ch) - 48)::BIGINT ELSE (ascii(ch) - 55)::BIGINT END)), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END)"
    parts = []
    for kind, pattern in search.NATIONAL.items():
        after = search.NOT_AFTER[kind]
        hits = f"""SELECT doc_id, line_no, i AS start, regexp_extract(line[i:], '^(?:{pattern})') AS hit, line FROM (SELECT doc_id, line_no, line, unnest(list_filter(range(1, length(line) + 1), lambda i: (i = 1 OR NOT regexp_matches(line[i - 1:i - 1], '[\\p{{L}}\\p{{N}}]')) AND regexp_matches(line[i:], '^(?:{pattern})'))) AS i FROM ({source}) WHERE regexp_matches(line, '{pattern}'))"""
        if after:
            hits = f"SELECT * FROM ({hits}) WHERE NOT regexp_matches(line[start + length(hit):], '^(?:{after})')"
        if kind == "iban":
            hits = f"""SELECT doc_id, line_no, start, regexp_extract(hit, '^(?:[ \\x{{A0}}]?[A-Za-z0-9]){{' || n || '}}') AS hit FROM (SELECT doc_id, line_no, start, any_value(hit) AS hit, max(n) AS n FROM (SELECT *, {compact} AS c FROM ({hits})), (SELECT unnest(range(15, 35)) AS n) WHERE n <= length(c) AND {fold} = 1 GROUP BY ALL)"""
        if kind == "nir":
            hits = f"SELECT * FROM ({hits}) WHERE 97 - replace(replace({compact}[1:13], '2A', '19'), '2B', '18')::BIGINT % 97 = {compact}[14:15]::INT"
        if kind == "date_fr":
            hits = f"SELECT * FROM ({hits}) WHERE regexp_extract(hit, '^([0-9]+)', 1)::INT BETWEEN 1 AND 31 AND coalesce(TRY_CAST(regexp_extract(hit, '^[0-9]+[/.-]([0-9]+)', 1) AS INT), 1) BETWEEN 1 AND 12 AND (length(regexp_extract(hit, '([0-9]+)$', 1)) = 2 OR regexp_extract(hit, '([0-9]+)$', 1)::INT BETWEEN 1000 AND 3000)"
        parts.append(f"SELECT doc_id, line_no, '{kind}' AS kind, start::INT AS start, (start + length(hit))::INT AS \"end\", hit FROM ({hits})")
    return " UNION ALL ".join(parts)


def register(r: Registry) -> None:
    @r.add("p2_p6_national", _national_sql(TELLING_SQL))
    def p2n(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Phone, account and social-security numbers and dates of French form, in lines about customers."""
        keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
        # a small file of many rows is read by few tasks, and a line takes far longer to search than to write
        told = dealt(keys, ["k"], keys.count(), LINES_SEARCHED).select(F.col("k").alias("doc_id"), F.lit(1).alias("line_no"), F.expr(TELLING).alias("line"))
        return search.national(told, KEYS)

    needle = "the"

    @r.add("e1_find", _hits_sql("(?i)" + needle))
    def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All non-overlapping occurrences of a needle, whatever its case."""
        return search.find(lines(spark, sf_dir), "(?i)" + needle, KEYS)

    phrase = "of the"
    matches_sql = f"""SELECT doc_id, k AS match, (1 + list_sum(list_transform(gaps[1:k], lambda g: length(g))) + (k - 1) * {len(phrase)})::BIGINT AS start, (1 + list_sum(list_transform(gaps[1:k], lambda g: length(g))) + k * {len(phrase)})::BIGINT AS "end"
        FROM (SELECT doc_id, gaps, unnest(range(1, len(gaps))) AS k FROM (SELECT doc_id, string_split(lower(translate(text, chr(10) || chr(9), '  ')), '{phrase}') AS gaps FROM documents))"""

    @r.add("e1_find_across_lines", matches_sql)
    def e1_across(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All non-overlapping occurrences of a phrase in whole texts, on over the ends of lines."""
        return search.find_across_lines(table(spark, sf_dir, "documents"), phrase, "doc_id")

    @r.add(
        "e2_match_pieces",
        f"""WITH s AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS a, length(line) AS n FROM ({LINES_SQL}))
        SELECT m.doc_id, match, line_no, (greatest(start, a) - a + 1)::BIGINT AS start, (least("end", a + n) - a + 1)::BIGINT AS "end" FROM ({matches_sql}) m JOIN s ON m.doc_id = s.doc_id AND start < a + n AND "end" > a""",
    )
    def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The part of each match that stands on each line."""
        found = search.find_across_lines(table(spark, sf_dir, "documents"), phrase, "doc_id")
        return search.pieces(found, lines(spark, sf_dir), "doc_id")

    @r.add("c4_whole_word", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents) WHERE w = '{needle}' GROUP BY doc_id")
    def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Matches that no letter or digit adjoins."""
        pattern = rf"(?<![\p{{L}}\p{{N}}]){needle}(?![\p{{L}}\p{{N}}])"
        n = F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n")).where("n > 0")

    @r.add(
        "e3_count_and_context",
        f"""
        SELECT doc_id, line_no, (length(line) - length(replace(line, ' of ', ''))) // 4 AS n, substr(line, greatest(1, instr(line, ' of ') - 20), 44) AS context FROM ({LINES_SQL}) WHERE contains(line, ' of ')
        """,
    )
    def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
        line = F.col("line")
        n = F.floor((F.length(line) - F.length(F.replace(line, F.lit(" of "), F.lit("")))) / 4)
        at = F.greatest(F.lit(1), F.instr(line, " of ") - 20)
        return lines(spark, sf_dir).where(F.contains(line, F.lit(" of "))).select("doc_id", "line_no", n.alias("n"), F.substring(line, at, F.lit(44)).alias("context"))

    @r.add("e5_bulk_edit", "SELECT doc_id, md5(replace(text, ' of ', ' from ')) AS edited_md5, (length(text) - length(replace(text, ' of ', ''))) // 4 AS n_edits FROM documents")
    def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.floor((F.length("text") - F.length(F.replace("text", F.lit(" of "), F.lit("")))) / 4)
        return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.replace("text", F.lit(" of "), F.lit(" from ")).cast("binary")).alias("edited_md5"), n.alias("n_edits"))

    @r.add("p1_email", _hits_sql(search.PATTERNS["email"]))
    def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.find(lines(spark, sf_dir), search.PATTERNS["email"], KEYS)

    @r.add("p2_phone", _hits_sql(search.PATTERNS["phone"]))
    def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.find(lines(spark, sf_dir), search.PATTERNS["phone"], KEYS)

    _luhn = """list_sum(list_transform(range(length(s)), lambda i: CASE WHEN i % 2 = 0 THEN substr(s, length(s) - i, 1)::INT ELSE (2 * substr(s, length(s) - i, 1)::INT) // 10 + (2 * substr(s, length(s) - i, 1)::INT) % 10 END)) % 10 = 0"""
    card_sql = f"SELECT doc_id, line_no, start, \"end\", hit FROM (SELECT *, translate(hit, ' -', '') AS s FROM ({_hits_sql(search.PATTERNS['digits'])})) WHERE {_luhn}"
    ip_sql = f"""SELECT doc_id, line_no, start, (start + length(quad))::INT AS "end", quad AS hit FROM (SELECT *, regexp_replace(hit, '\\.$', '') AS quad FROM ({_hits_sql(search.PATTERNS['ipv4'])}))
        WHERE CASE WHEN regexp_full_match(quad, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') THEN len(list_filter(string_split(quad, '.'), lambda p: p::INT > 255)) = 0 ELSE false END"""

    @r.add("p4_payment_card", card_sql)
    def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.candidates(lines(spark, sf_dir), KEYS).where("kind = 'digits'").drop("kind")

    @r.add("p7_ipv4", ip_sql)
    def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.candidates(lines(spark, sf_dir), KEYS).where("kind = 'ipv4'").drop("kind")

    all_sql = " UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS kind, start, \"end\", hit FROM ({q})" for k, q in (("email", _hits_sql(search.PATTERNS["email"])), ("phone", _hits_sql(search.PATTERNS["phone"])), ("ipv4", ip_sql), ("digits", card_sql))) + " UNION ALL " + _national_sql(LINES_SQL)

    @r.add("p9_candidates", all_sql)
    def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.candidates(lines(spark, sf_dir), KEYS)

    @r.add(
        "p10_redact",
        f"""
        WITH z AS ({all_sql}), o AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY doc_id, line_no ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM z),
        g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, line_no ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM o),
        m AS (SELECT doc_id, line_no, min(start) AS a, max("end") AS b FROM g GROUP BY doc_id, line_no, run),
        q AS (SELECT m.*, coalesce(lag(b) OVER (PARTITION BY doc_id, line_no ORDER BY a), 1) AS prev, line FROM m JOIN ({LINES_SQL}) l USING (doc_id, line_no))
        SELECT doc_id, line_no, count(*)::INT AS n_zones, sum(b - a)::INT AS n_removed, md5(string_agg(substr(line, prev, a - prev) || '[x]', '' ORDER BY a) || substr(any_value(line), max(b))) AS redacted_md5 FROM q GROUP BY doc_id, line_no
        """,
    )
    def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Covered characters replaced, overlapping marks as one."""
        rows = lines(spark, sf_dir)
        done = search.redact(rows, search.candidates(rows, KEYS), KEYS).where("n_zones > 0")
        return done.select(*KEYS, "n_zones", "n_removed", F.md5(F.col("redacted").cast("binary")).alias("redacted_md5"))

    href_sql = """SELECT page_id, idx, target, CASE WHEN regexp_matches(target, '^https?://') THEN 'uri' WHEN target LIKE 'mailto:%' THEN 'mail' WHEN target LIKE '/%' THEN 'goto' WHEN target LIKE '#%' THEN 'named' ELSE 'unsupported' END AS kind
        FROM (SELECT page_id, unnest(l) AS target, (generate_subscripts(l, 1) - 1)::INT AS idx FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))"""

    @r.add("l4_link_inventory", href_sql)
    def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.hrefs(table(spark, sf_dir, "pages"))

    @r.add(
        "l1_uri_parts",
        """SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages WHERE regexp_matches(url, '^https?://[^/ ]+')""",
    )
    def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = lambda p: F.regexp_extract("url", p, 1)
        return table(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://[^/ ]+")).select("page_id", part("^(https?)://").alias("scheme"), part("^https?://([^/]+)").alias("host"), part("^https?://[^/]+(/[^?#]*)").alias("path"))

    @r.add(
        "l6_link_graph",
        f"""
        WITH h AS ({href_sql}), t AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS name FROM pages)
        SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages, bool_and(name IS NULL) AS broken FROM h LEFT JOIN t ON substr(target, 2) = name GROUP BY target
        """,
    )
    def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Links by target, and targets that no page's first path part answers."""
        pages = table(spark, sf_dir, "pages")
        names = pages.select(F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1).alias("name")).distinct()
        links = search.hrefs(pages).withColumn("name", F.substr("target", F.lit(2))).join(names.withColumn("known", F.lit(True)), "name", "left")
        return links.groupBy("target").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("page_id").alias("n_pages"), F.bool_and(F.col("known").isNull()).alias("broken"))
