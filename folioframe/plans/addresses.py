"""Queries of addresses in running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import search, uris
from folioframe.plans import Registry
from folioframe.sources.tables import table

#: Lines that tell of a page's own address, in all the forms that detection must tell apart.
TELLING = ["'See ' || url || '.'", "'(see ' || url || ')'", "'wiki ' || url || '/Test_(page), nowww.' || host || ' WWW.' || host || '!'", "'mailto:info@' || host || '; mailto:none www.fr https://' || host || '/'", "CASE WHEN page_id % 2 = 0 THEN 'part-2/index.html follows' ELSE 'Introduction' END"]
TEXT_SQL = f"(SELECT page_id, unnest([{', '.join(TELLING)}]) AS line, unnest([1, 2, 3, 4, 5]) AS line_no FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages))"


def telling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line_no, line): five lines of text about each page of the web."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return pages.select("page_id", F.posexplode(F.array(*map(F.expr, TELLING))).alias("k", "line")).select("page_id", (F.col("k") + 1).alias("line_no"), "line")


def _q(text: str) -> str:
    return text.replace("'", "''")


_count = "(length(run[1:e]) - length(replace(run[1:e], '{}', '')))"
TRIM_SQL = f"""run[1:coalesce(list_max(list_filter(range(1, length(run) + 1), lambda e: CASE run[e:e] WHEN ')' THEN {_count.format('(')} >= {_count.format(')')} WHEN ']' THEN {_count.format('[')} >= {_count.format(']')} ELSE instr('{_q(uris.CLOSING)}', run[e:e]) = 0 END)), 0)]"""
FOUND_SQL = f"""SELECT page_id, line_no, k, shown, CASE WHEN regexp_matches(shown, '(?i)^www\\.') THEN 'https://' || shown ELSE shown END AS uri, line FROM (
    SELECT page_id, line_no, line, k, {TRIM_SQL} AS shown FROM (SELECT page_id, line_no, line, unnest(l) AS run, generate_subscripts(l, 1) AS k FROM (SELECT *, regexp_extract_all(line, '{_q(uris.FORM)}', 1) AS l FROM {TEXT_SQL})))
    WHERE regexp_matches(shown, '{_q(uris.VALID)}')"""
JOINED_SQL = f"""SELECT page_id, line_no, k, CASE WHEN over THEN uri || regexp_extract(nxt, '^\\S+') ELSE uri END AS uri, over FROM (
    SELECT f.*, coalesce(uri LIKE '%/' AND suffix(f.line, shown) AND regexp_matches(n.line, '{_q(uris.PATH)}'), false) AS over, n.line AS nxt FROM ({FOUND_SQL}) f LEFT JOIN {TEXT_SQL} n ON n.page_id = f.page_id AND n.line_no = f.line_no + 1)"""


def register(r: Registry) -> None:
    @r.add("l1_find_uris", f"SELECT page_id, line_no, k, shown, uri FROM ({FOUND_SQL})")
    def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Addresses in lines of text, with their trailing marks off and their hosts checked."""
        return uris.find_uris(telling(spark, sf_dir), ["page_id", "line_no"])

    @r.add("l2_over_two_lines", JOINED_SQL)
    def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Addresses that go on in the next line."""
        return uris.joined(telling(spark, sf_dir), ["page_id"], "line_no")

    @r.add(
        "l3_autolink_text",
        f"""
        WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS uri FROM pages UNION SELECT page_id, url FROM pages WHERE page_id % 3 = 0)
        SELECT page_id, count(*) AS n_found, count(*) FILTER (WHERE h.uri IS NULL) AS n_added, count(h.uri) AS n_already FROM ({JOINED_SQL}) f LEFT JOIN (SELECT DISTINCT * FROM h) h USING (page_id, uri) GROUP BY page_id
        """,
    )
    def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Addresses of a page's text that its links lack; a third of the pages link to themselves already."""
        pages = table(spark, sf_dir, "pages")
        links = search.hrefs(pages).select("page_id", F.col("target").alias("uri")).unionByName(pages.where("page_id % 3 = 0").select("page_id", F.col("url").alias("uri")))
        return uris.autolink(uris.joined(telling(spark, sf_dir), ["page_id"], "line_no"), links, ["page_id"])
