"""Queries of the scalar functions, over columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers as N
from folioframe.functions import text as T
from folioframe.plans import Registry
from folioframe.sources.tables import table

LINES_SQL = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line), lines counted from 1."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


_fold = f"translate({{}}, '{T.FOLD_FROM.replace(chr(9), '')}' || chr(9), '{T.FOLD_TO.replace(chr(39), chr(39) * 2)}')"
_liga = "{}"
for _a, _b in T.LIGATURES.items():
    _liga = f"replace({_liga}, '{_a}', '{_b}')"
NORMALIZE_SQL = f"trim({_fold.format(_liga)})"


def register(r: Registry) -> None:
    docs = lambda s, d: table(s, d, "documents")

    @r.add("b1_normalize_text", f"SELECT doc_id, md5(lower({NORMALIZE_SQL.format('text')})) AS key_md5, length({NORMALIZE_SQL.format('text')}) AS n FROM documents")
    def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = T.normalize_text(F.col("text"))
        return docs(spark, sf_dir).select("doc_id", F.md5(F.lower(key).cast("binary")).alias("key_md5"), F.length(key).cast("long").alias("n"))

    @r.add("b2_search_fold", f"SELECT doc_id, md5(lower(translate({_fold.format('text')}, chr(10) || chr(13), '  '))) AS folded_md5 FROM documents")
    def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", F.md5(T.search_fold(F.col("text")).cast("binary")).alias("folded_md5"))

    @r.add(
        "b3_header_key",
        f"SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '#', 'g'), '[ \\t]+', ' ', 'g')) AS line_key FROM ({LINES_SQL})",
    )
    def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines(spark, sf_dir).select("doc_id", "line_no", T.header_key(F.col("line")).alias("line_key"))

    @r.add(
        "b4_b6_line_shapes",
        f"""
        SELECT doc_id, line_no,
            len(tk) BETWEEN 1 AND 4 AND len(list_filter(tk, lambda t: NOT (regexp_full_match(t, '[0-9]{{1,4}}') OR t IN ('page', 'p', 'pg', 'of', 'sur', 'de', 'seite')))) = 0
                AND len(list_filter(tk, lambda t: regexp_full_match(t, '[0-9]{{1,4}}'))) > 0 AS page_number,
            regexp_full_match(string_split(ltrim(line), ' ')[1], '([•◦▪*–-]|\\(?[0-9]{{1,4}}[.)]|\\(?[a-zA-Z][.)]|\\(?[ivxIVX]{{1,4}}[.)])') AS marker,
            regexp_matches(line, '[.!?:;»”")]$') AS sentence_end
        FROM (SELECT *, list_filter(list_transform(string_split(lower(trim(line)), ' '), lambda t: regexp_replace(t, '^[-–—.,/|]+|[-–—.,/|]+$', '', 'g')), lambda t: t <> '') AS tk FROM ({LINES_SQL}))
        """,
    )
    def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
        line = F.col("line")
        return lines(spark, sf_dir).select("doc_id", "line_no", T.looks_like_page_number(line).alias("page_number"), T.list_marker(line).alias("marker"), T.ends_sentence(line).alias("sentence_end"))

    @r.add(
        "b8_parse_date",
        """
        SELECT o_orderkey, make_timestamp(y, m, least(d, day(last_day(make_date(y, m, 1)))), h, 0, 0.0) AS stamp,
            CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 12)::INT * 60 + 30 WHEN o_orderkey % 3 = 1 THEN -((o_orderkey % 12)::INT * 60) END AS offset_min
        FROM (SELECT o_orderkey, year(o_orderdate)::INT AS y, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE month(o_orderdate)::INT END AS m,
            CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE least(31, (day(o_orderdate) + 3)::INT) END AS d, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey % 24)::INT END AS h FROM orders)
        """,
    )
    def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Document dates written from the order dates, some short, some with days past the month's end."""
        key, date = F.col("o_orderkey"), F.col("o_orderdate")
        pad = lambda c: F.lpad(c.cast("string"), 2, "0")
        tail = F.when(key % 5 == 0, "").otherwise(F.concat(pad(F.month(date)), pad(F.least(F.lit(31), F.dayofmonth(date) + 3)), pad(key % 24), F.lit("0000")))
        zone = F.when(key % 3 == 0, F.concat(F.lit("+"), pad(key % 12), F.lit("'30'"))).when(key % 3 == 1, F.concat(F.lit("-"), pad(key % 12), F.lit("'00'"))).otherwise("")
        raw = F.concat(F.lit("D:"), F.year(date).cast("string"), tail, zone)
        stamp, offset = N.parse_document_date(raw)
        return table(spark, sf_dir, "orders").select("o_orderkey", stamp.alias("stamp"), offset.cast("int").alias("offset_min"))

    @r.add(
        "b9_display_date",
        """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'order ' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown FROM orders""",
    )
    def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A readable date where the text is one, else the text itself."""
        raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss")))
        stamp, _ = N.parse_document_date(F.col("raw"))
        return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", F.coalesce(F.date_format(stamp, "yyyy-MM-dd"), "raw").alias("shown"))

    _roman = " || ".join(f"repeat('{s}', (({'n' if k == 0 else f'n % {N.ROMAN[k - 1][0]}'}{''.join(f' % {v}' for v, _ in N.ROMAN[:0])}) // {v})::INT)" if k == 0 else f"repeat('{s}', (r{k} // {v})::INT)" for k, (v, s) in enumerate(N.ROMAN))
    _rest = ", ".join(f"({'n' if k == 1 else f'r{k - 1}'} % {N.ROMAN[k - 1][0]}) AS r{k}" for k in range(1, len(N.ROMAN)))

    @r.add(
        "b10_b14_number_formats",
        f"""
        SELECT p_partkey, {_roman} AS roman, repeat(chr((97 + (n - 1) % 26)::INT), least((n - 1) // 26 + 1, 64)::INT) AS letters,
            CASE WHEN n <= 26 THEN chr((65 + (n - 1) % 26)::INT) WHEN n <= 702 THEN chr((65 + ((n - 27) // 26) % 26)::INT) || chr((65 + (n - 27) % 26)::INT)
                ELSE chr((65 + ((n - 703) // 676) % 26)::INT) || chr((65 + ((n - 703) // 26) % 26)::INT) || chr((65 + (n - 703) % 26)::INT) END AS alpha,
            'DOC-' || CASE WHEN length(n::VARCHAR) >= 3 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END || '/A' AS bates
        FROM (SELECT *, {_rest} FROM (SELECT p_partkey, p_partkey % 4200 + 1 AS n FROM part))
        """,
    )
    def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.col("n")
        rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4200 + 1).alias("n"))
        return rows.select("p_partkey", N.roman(n).alias("roman"), N.letters(n).alias("letters"), N.alpha(n).alias("alpha"), N.bates_label(n, 3, "DOC-", "/A").alias("bates"))

    @r.add(
        "b13_template",
        """SELECT doc_id, 'Page ' || doc_id || ' of ' || n_chars || ' {x} {unknown} ' || source AS header, ['unknown'] AS unknown FROM documents""",
    )
    def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
        pattern = "Page {page} of {pages} {{x}} {unknown} {filename}"
        made = T.template(pattern, page=F.col("doc_id"), pages=F.col("n_chars"), filename=F.col("source"))
        known = F.array(*map(F.lit, ["page", "pages", "filename"]))
        unknown = F.array_except(F.regexp_extract_all(F.lit(pattern.replace("{{x}}", "")), F.lit(r"\{([a-z]+)\}"), F.lit(1)), known)
        return docs(spark, sf_dir).select("doc_id", made.alias("header"), unknown.alias("unknown"))

    @r.add(
        "b15_page_spec",
        """
        WITH s AS (SELECT o_orderkey AS doc, (o_orderkey % 9 + 1)::INT AS a, (o_orderkey % 7 + 1)::INT AS b FROM orders), p AS (
            SELECT doc, 1 AS ord, unnest(CASE WHEN a <= b THEN range(a, b + 1) ELSE list_reverse(range(b, a + 1)) END) AS page, generate_subscripts(CASE WHEN a <= b THEN range(a, b + 1) ELSE range(b, a + 1) END, 1) AS k FROM s
            UNION ALL SELECT doc, 2, unnest(range(8, 11)), generate_subscripts(range(8, 11), 1) FROM s)
        SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord, k) AS place, page::INT AS page FROM p
        """,
    )
    def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Page selections like 5-3,8- written from order keys, over documents of ten pages."""
        spec = F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("-"), (F.col("o_orderkey") % 7 + 1).cast("string"), F.lit(",8-"))
        part = F.posexplode(F.split(spec, ",")).alias("ord", "part")
        rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), part)
        first = F.regexp_extract("part", "^([0-9]+)", 1).cast("int")
        last = F.when(F.col("part").rlike("-$"), 10).when(F.col("part").rlike("-"), F.regexp_extract("part", "-([0-9]+)$", 1).cast("int")).otherwise(first)
        pages = rows.where(first.between(1, 10) & last.between(1, 10)).select("doc", "ord", F.posexplode(F.sequence(first, last)).alias("k", "page"))
        place = F.row_number().over(Window.partitionBy("doc").orderBy("ord", "k")).cast("long")
        return pages.select("doc", place.alias("place"), "page")

    @r.add(
        "b16_parse_size",
        """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT * 1024 WHEN 1 THEN round((p_size + 0.5) * 1048576) WHEN 2 THEN p_size::BIGINT * 1073741824 ELSE p_size END::BIGINT AS bytes FROM part""",
    )
    def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
        size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
        text = F.when(kind == 0, F.concat(size, F.lit(" KB"))).when(kind == 1, F.concat(size, F.lit(",5 Mo"))).when(kind == 2, F.concat(size, F.lit("G"))).otherwise(size)
        return table(spark, sf_dir, "part").select("p_partkey", N.parse_size(text).alias("bytes"))

    _lin = lambda c: f"(CASE WHEN {c} <= 0.03928 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"
    RGB_SQL = "SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, l_orderkey * 13 % 256 AS b FROM lineitem"

    @r.add(
        "b17_b19_colours",
        f"""
        SELECT l_orderkey, l_linenumber, r, g, b, round(1.05 / (lum + 0.05), 6) AS on_white, 1.05 / (lum + 0.05) >= 4.5 AS readable,
            '#' || lpad(upper(to_hex(r)), 2, '0') || lpad(upper(to_hex(g)), 2, '0') || lpad(upper(to_hex(b)), 2, '0') AS hex,
            CASE WHEN k = 255 THEN 0 ELSE round((255 - r - k) * 255 / (255 - k))::INT END AS c, CASE WHEN k = 255 THEN 0 ELSE round((255 - g - k) * 255 / (255 - k))::INT END AS m,
            CASE WHEN k = 255 THEN 0 ELSE round((255 - b - k) * 255 / (255 - k))::INT END AS y, k::INT AS k
        FROM (SELECT *, {_lin('(r / 255.0::DOUBLE)')} * 0.2126 + {_lin('(g / 255.0::DOUBLE)')} * 0.7152 + {_lin('(b / 255.0::DOUBLE)')} * 0.0722 AS lum, 255 - greatest(r, g, b) AS k FROM ({RGB_SQL}))
        """,
    )
    def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
        r_, g_, b_ = F.col("r"), F.col("g"), F.col("b")
        rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") * 7 % 256).alias("g"), (F.col("l_orderkey") * 13 % 256).alias("b"))
        ratio = N.contrast_ratio(F.lit(1.0), N.luminance(r_ / 255, g_ / 255, b_ / 255))
        c, m, y, k = N.rgb_to_cmyk(r_, g_, b_)
        return rows.select("l_orderkey", "l_linenumber", "r", "g", "b", F.round(ratio, 6).alias("on_white"), (ratio >= 4.5).alias("readable"), N.color_hex(r_, g_, b_).alias("hex"), c.cast("int").alias("c"), m.cast("int").alias("m"), y.cast("int").alias("y"), k.cast("int").alias("k"))

    @r.add("b20_permission_bits", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"(l_partkey >> {b}) & 1 = 1 AS {n}" for n, b in N.RIGHTS.items()) + ", (l_partkey >> 4) & 1 = 1 AS extraction FROM lineitem")
    def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
        bits = N.flags(F.col("l_partkey"), N.RIGHTS)
        return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *bits, N.flags(F.col("l_partkey"), {"extraction": 4})[0])

    @r.add("b21_field_flags", "SELECT e, " + ", ".join(f"(raw >> {b}) & 1 = 1 AS {n}" for n, b in N.FIELD_FLAGS.items()) + " FROM (SELECT event_id AS e, event_id * 7919 % 67108864 AS raw FROM events)")
    def b21(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "events").select(F.col("event_id").alias("e"), *N.flags(F.col("event_id") * 7919 % 67108864, N.FIELD_FLAGS))

    @r.add(
        "b24_clean_title",
        """
        SELECT doc_id, CASE WHEN length(flat) <= 120 THEN flat ELSE rtrim(CASE WHEN contains(head, ' ') AND cut > 60 THEN substr(head, 1, cut - 1) ELSE head END) || '…' END AS title
        FROM (SELECT doc_id, flat, substr(flat, 1, 120) AS head, length(substr(flat, 1, 120)) - instr(reverse(substr(flat, 1, 120)), ' ') + 1 AS cut
            FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS flat FROM documents))
        """,
    )
    def b24(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", T.clean_title(F.col("text")).alias("title"))

    @r.add(
        "b25_mime",
        "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' ELSE 'application/octet-stream' END AS mime FROM pages",
    )
    def b25(spark: SparkSession, sf_dir: str) -> DataFrame:
        ext = F.element_at(F.array(*map(F.lit, [".HTML", ".pdf", ".png", "/"])), (F.col("page_id") % 4 + 1).cast("int"))
        return table(spark, sf_dir, "pages").select("page_id", N.mime_of(F.concat("url", ext)).alias("mime"))

    @r.add(
        "b26_check_digits",
        """
        WITH d AS (SELECT o_orderkey, (o_orderkey * 7919 + 1234567890123)::VARCHAR AS s FROM orders)
        SELECT o_orderkey, list_sum(list_transform(range(length(s)), lambda i: CASE WHEN i % 2 = 0 THEN substr(s, length(s) - i, 1)::INT
            ELSE (2 * substr(s, length(s) - i, 1)::INT) // 10 + (2 * substr(s, length(s) - i, 1)::INT) % 10 END)) % 10 = 0 AS luhn, s::BIGINT % 97 AS mod97 FROM d
        """,
    )
    def b26(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = (F.col("o_orderkey") * 7919 + 1234567890123).cast("string")
        return table(spark, sf_dir, "orders").select("o_orderkey", N.luhn_ok(s).alias("luhn"), N.mod97(s).cast("long").alias("mod97"))

    @r.add(
        "b27_review_state",
        "SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'completed' ELSE 'none' END AS state FROM conversations",
    )
    def b27(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = F.element_at(F.array(*map(F.lit, ["Accepted", "REJECTED", "Cancelled", "completed", "Other", ""])), (F.col("turn") % 6 + 1).cast("int"))
        low = F.lower(raw)
        return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(low.isin("accepted", "rejected", "cancelled", "completed"), low).otherwise("none").alias("state"))

    @r.add(
        "b28_font_style",
        "SELECT p_partkey, split_part(p_name, ' ', 2) AS family, p_partkey % 2 = 0 AS bold, p_partkey % 3 = 0 AS italic FROM part",
    )
    def b28(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Font names written from part names, with a subset prefix and a style; family and style read back."""
        key = F.col("p_partkey")
        style = F.concat(F.when(key % 2 == 0, "Bold").otherwise(""), F.when(key % 3 == 0, "Italic").otherwise(""))
        name = F.concat(F.lit("ABCDEF+"), F.element_at(F.split("p_name", " "), 2), F.lit("-"), style)
        plain = F.regexp_replace(F.col("font"), r"^[A-Z]{6}\+", "")
        return table(spark, sf_dir, "part").select("p_partkey", name.alias("font")).select("p_partkey", F.element_at(F.split(plain, "-"), 1).alias("family"), F.col("font").rlike("(?i)bold").alias("bold"), F.col("font").rlike("(?i)italic|oblique").alias("italic"))
