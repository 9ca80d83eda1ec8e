"""Queries of columns, bands and ruled tables.

The given tables hold no drawn pages. Documents wrapped to rows are set in one, two or three columns or under a band, so
that what is cut grows with them; an order stands for a page whose line items are the rows of a table drawn on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions.text import list_marker
from folioframe.operators import geometry
from folioframe.plans import Registry
from folioframe.plans.audits import DRAWN_SQL, drawn
from folioframe.plans.scalars import LINES_SQL, lines
from folioframe.plans.structure import ROWS_SQL, n_chars, wrapped
from folioframe.sources import sinks
from folioframe.sources.scratch import written
from folioframe.sources.tables import dealt

KEYS = ["doc", "page"]
#: Rows of a page's text that a task sorts in several orders.
ROWS = 150_000
#: Rows of a page of 50 by how its document is set: one column, two, two under a band of two rows, three. The last element of a row is its column.
SET = """CASE doc % 4 WHEN 0 THEN {one} WHEN 1 THEN {two} WHEN 2 THEN CASE WHEN line <= 2 THEN {band} ELSE {under} END ELSE {three} END"""
X0 = SET.format(one="50.0", two="50.0 + 250 * {half}", band="50.0", under="50.0 + 250 * {half}", three="50.0 + 170 * {third}").format(half="(CASE WHEN line > 25 THEN 1 ELSE 0 END)", third="(CASE WHEN line > 34 THEN 2 WHEN line > 17 THEN 1 ELSE 0 END)")
WIDE = SET.format(one="5.0", two="2.75", band="5.0", under="2.75", three="1.75")
Y0 = SET.format(one="700.0 - 12 * line", two="700.0 - 12 * (line - {half})", band="700.0 - 12 * line", under="650.0 - 12 * (line - {half})", three="700.0 - 12 * (line - {third})").format(half="(CASE WHEN line > 25 THEN 25 ELSE 0 END)", third="(CASE WHEN line > 34 THEN 34 WHEN line > 17 THEN 17 ELSE 0 END)")
ITEMS_SQL = f"SELECT *, x0 + wide * length(row_text) AS x1, y0 + 10 AS y1 FROM (SELECT doc, page, line AS item, row_text, {X0} AS x0, {Y0} AS y0, {WIDE} AS wide FROM ({ROWS_SQL}) WHERE trim(row_text) <> '')"

CUT_SQL = f"""
WITH RECURSIVE s AS (
    SELECT doc, page, item, row_text, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, 10.0::DOUBLE AS size, '' AS path, false AS done FROM ({ITEMS_SQL})
    UNION ALL
    SELECT doc, page, item, row_text, x0, y0, x1, y1, size, path || side, side = '' FROM (
        SELECT *, CASE WHEN n = 1 THEN '' WHEN gx IS NOT NULL THEN CASE WHEN x1 > -gx.at + 0.000001 THEN '1' ELSE '0' END WHEN gy IS NOT NULL THEN CASE WHEN y0 < gy.at THEN '1' ELSE '0' END ELSE '' END AS side FROM (
            SELECT *, max(CASE WHEN x0 - l >= 8 AND hi - lo > 1 AND rhi - rlo > 1 THEN {{'gap': x0 - l, 'at': -l}} END) OVER r AS gx, max(CASE WHEN b - y1 >= 7 THEN {{'gap': b - y1, 'at': (b + y1) / 2}} END) OVER r AS gy FROM (
                SELECT *, count(*) OVER r AS n, max(x1) OVER px AS l, max(y0) OVER px AS hi, min(y0) OVER px AS lo, max(y0) OVER sx AS rhi, min(y0) OVER sx AS rlo, min(y0) OVER py AS b FROM s WHERE NOT done
                WINDOW r AS (PARTITION BY doc, page, path), px AS (PARTITION BY doc, page, path ORDER BY x0, x1, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), sx AS (PARTITION BY doc, page, path ORDER BY x0, x1, item ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                    py AS (PARTITION BY doc, page, path ORDER BY y1 DESC, y0 DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            ) WINDOW r AS (PARTITION BY doc, page, path)
        )
    )
), leaves AS (SELECT *, dense_rank() OVER (PARTITION BY doc, page ORDER BY path) AS leaf FROM s WHERE done)
"""

#: Rules in pieces, uprights on every other document only, and words of the three columns of each row.
PIECES = """array(struct(50.0D AS x0, 150.0D AS x1), struct(151.0D AS x0, 250.0D AS x1), struct(250.5D AS x0, CASE WHEN s % 7 = 0 THEN 300.0D ELSE 350.0D END AS x1))"""
_level = "SELECT doc, page, {k} AS at, y + 0.25 * (p % 3) AS y0, y + 0.25 * (p % 3) + 0.5 AS y1, p, s FROM (SELECT *, 700.0::DOUBLE - 20 * {k} AS y FROM {drawn}{only})"
RULES_SQL = f"""
    SELECT doc, page, x.x0 AS x0, y0, x.x1 AS x1, y1 FROM (SELECT *, unnest([{{'x0': 50.0::DOUBLE, 'x1': 150.0::DOUBLE}}, {{'x0': 151.0::DOUBLE, 'x1': 250.0::DOUBLE}}, {{'x0': 250.5::DOUBLE, 'x1': CASE WHEN s % 7 = 0 THEN 300.0 ELSE 350.0 END::DOUBLE}}]) AS x
        FROM ({_level.format(k='ord', drawn=DRAWN_SQL, only='')} UNION ALL {_level.format(k='(ord - 1)', drawn=DRAWN_SQL, only=' WHERE ord = 1')}))
    UNION ALL SELECT doc, page, x::DOUBLE AS x0, 700.0 - 20 * ord AS y0, x + 0.5 AS x1, 720.0 - 20 * ord AS y1 FROM (SELECT *, unnest([50, 150, 250, 350]) AS x FROM {DRAWN_SQL} WHERE doc % 2 = 0)"""
CELL_WORDS_SQL = f"SELECT doc, page, ord * 3 + c AS ord, 55.0 + 100 * c + p % 10 AS x0, 705.0 - 20 * ord AS y0, 75.0 + 100 * c + p % 10 + q AS x1, 715.0 - 20 * ord AS y1, concat('w', c, '-', p) AS text FROM (SELECT *, unnest([0, 1, 2]) AS c FROM {DRAWN_SQL}) WHERE (p + c) % 5 <> 0"



def _collinear_sql(source: str, a: str, b: str) -> str:
    """Pieces along ``a``, lines across ``b``."""
    return f"""SELECT doc, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (
        SELECT *, sum((reach IS NULL OR {a}0 > reach + 2)::INT) OVER (PARTITION BY doc, page, line ORDER BY {a}0, {a}1 ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, max({a}1) OVER (PARTITION BY doc, page, line ORDER BY {a}0, {a}1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
                SELECT *, sum(coalesce(m - b4 > 1, true)::INT) OVER (PARTITION BY doc, page ORDER BY k ROWS UNBOUNDED PRECEDING) AS line FROM (
                    SELECT *, lag(m) OVER (PARTITION BY doc, page ORDER BY k) AS b4 FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY m, {a}0) AS k FROM (SELECT *, ({b}0 + {b}1) / 2 AS m FROM ({source})))))))
        GROUP BY doc, page, line, run"""


def _means_sql(source: str, keys: str, v: str, name: str) -> str:
    return f"""SELECT {keys}, list(m ORDER BY m) AS {name} FROM (SELECT {keys}, avg({v}) AS m FROM (
        SELECT *, sum(coalesce({v} - b4 > 1.5, true)::INT) OVER (PARTITION BY {keys} ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, lag({v}) OVER (PARTITION BY {keys} ORDER BY k) AS b4 FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {v}) AS k FROM ({source})))) GROUP BY {keys}, c) GROUP BY {keys}"""


GRIDS_SQL = f"""
WITH rules AS MATERIALIZED ({RULES_SQL}), words AS MATERIALIZED ({CELL_WORDS_SQL}),
lv AS ({_collinear_sql('SELECT * FROM rules WHERE x1 - x0 >= y1 - y0', 'x', 'y')}), up AS ({_collinear_sql('SELECT * FROM rules WHERE x1 - x0 < y1 - y0', 'y', 'x')}),
g AS MATERIALIZED (SELECT *, (y0 + y1) / 2 AS y, sum(coalesce(x0 - px0 > greatest(3, 0.03 * (x1 - x0)) OR abs(x1 - px1) > greatest(3, 0.03 * (x1 - x0)), true)::INT) OVER (PARTITION BY doc, page ORDER BY x0, x1, y0 ROWS UNBOUNDED PRECEDING) AS grid
    FROM (SELECT *, lag(x0) OVER (PARTITION BY doc, page ORDER BY x0, x1, y0) AS px0, lag(x1) OVER (PARTITION BY doc, page ORDER BY x0, x1, y0) AS px1 FROM lv)),
bands AS MATERIALIZED (SELECT doc, page, grid, x0, ups[1] AS y0, x1, ups[len(ups)] AS y1, list_reverse(ups) AS ys FROM (SELECT doc, page, grid, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY doc, page, grid) JOIN ({_means_sql('g', 'doc, page, grid', 'y', 'ups')}) USING (doc, page, grid) WHERE len(ups) >= 2),
drawn AS (SELECT b.doc, b.page, b.grid, (u.x0 + u.x1) / 2 AS x FROM bands b JOIN up u ON b.doc = u.doc AND b.page = u.page AND (u.x0 + u.x1) / 2 BETWEEN b.x0 - 2 AND b.x1 + 2 AND least(u.y1, b.y1) - greatest(u.y0, b.y0) >= 0.5 * (b.y1 - b.y0)),
ruled AS (SELECT * FROM ({_means_sql('drawn', 'doc, page, grid', 'x', 'xs')}) WHERE len(xs) >= 2),
placed AS MATERIALIZED (SELECT b.doc, b.page, b.grid, w.ord, w.x0, w.x1, w.text, len(list_filter(b.ys, lambda v: v >= (w.y0 + w.y1) / 2)) AS row
    FROM bands b JOIN words w ON b.doc = w.doc AND b.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN b.x0 AND b.x1 AND (w.y0 + w.y1) / 2 <= b.y1 AND (w.y0 + w.y1) / 2 > b.y0),
spans AS MATERIALIZED (SELECT doc, page, grid, row, min(x0) AS x0, max(x1) AS x1 FROM (
    SELECT *, sum((reach IS NULL OR x0 > reach + 10)::INT) OVER (PARTITION BY doc, page, grid, row ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, max(x1) OVER (PARTITION BY doc, page, grid, row ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM placed ANTI JOIN ruled USING (doc, page, grid))) GROUP BY doc, page, grid, row, run),
two AS (SELECT doc, page, grid FROM spans GROUP BY doc, page, grid HAVING count(DISTINCT row) >= 2),
mids AS (SELECT doc, page, grid, list((x0 + reach) / 2 ORDER BY x0) AS ms FROM (SELECT *, max(x1) OVER (PARTITION BY doc, page, grid ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans SEMI JOIN two USING (doc, page, grid)) WHERE x0 - reach >= 10 GROUP BY doc, page, grid),
xs AS (SELECT * FROM ruled UNION ALL SELECT doc, page, grid, list_concat([x0], coalesce(ms, []), [x1]) FROM bands JOIN two USING (doc, page, grid) LEFT JOIN mids USING (doc, page, grid)),
grids AS MATERIALIZED (SELECT * FROM bands JOIN xs USING (doc, page, grid))
"""


def drawn_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rules, words) of the tables that orders stand for."""
    d = drawn(spark, sf_dir)
    jitter, box = 0.25 * (F.col("p") % 3), [F.col(c).cast("double").alias(c) for c in geometry.BOX]
    rect = lambda x0, y0, x1, y1: F.struct(*(v.cast("double").alias(c) for v, c in zip((x0, y0, x1, y1), geometry.BOX, strict=True)))
    none = F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")

    def level(k: Column) -> Column:
        y = 700 - 20 * k + jitter
        return F.transform(F.expr(PIECES), lambda x: rect(x["x0"], y, x["x1"], y + 0.5))

    upright = F.array(*(rect(F.lit(v), 700 - 20 * F.col("ord"), F.lit(v + 0.5), 720 - 20 * F.col("ord")) for v in (50, 150, 250, 350)))
    pieces = F.concat(level(F.col("ord")), F.when(F.col("ord") == 1, level(F.lit(0))).otherwise(none), F.when(F.col("doc") % 2 == 0, upright).otherwise(none))
    rules = d.select(*KEYS, F.explode(pieces).alias("r")).select(*KEYS, "r.*")
    c = F.col("c")
    left = 55 + 100 * c + F.col("p") % 10
    words = d.withColumn("c", F.explode(F.array(*map(F.lit, (0, 1, 2))))).where("(p + c) % 5 <> 0")
    words = words.select("doc", "page", (F.col("ord") * 3 + c).alias("ord"), left.alias("x0"), (705 - 20 * F.col("ord")).alias("y0"), (left + 20 + F.col("q")).alias("x1"), (715 - 20 * F.col("ord")).alias("y1"), F.concat(F.lit("w"), c.cast("string"), F.lit("-"), F.col("p").cast("string")).alias("text"))
    return rules.select(*KEYS, *box), words.select(*KEYS, "ord", *box, "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of wrapped documents as text items with boxes, by how their document is set."""
    rows = wrapped(spark, sf_dir).where(F.trim("row_text") != "")
    placed = rows.select("doc", "page", F.col("line").alias("item"), "row_text", F.expr(X0).cast("double").alias("x0"), F.expr(Y0).cast("double").alias("y0"), F.expr(WIDE).cast("double").alias("wide"))
    return placed.select("doc", "page", "item", "row_text", "x0", "y0", (F.col("x0") + F.col("wide") * F.length("row_text")).alias("x1"), (F.col("y0") + 10).alias("y1"), F.col("y0").alias("base"), F.lit(10.0).alias("size"), F.lit(False).alias("is_table"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items with the number of their region."""
    n_rows = n_chars(spark, sf_dir) // 40
    return geometry.columns(items(spark, sf_dir), KEYS, written, lambda rows, keys: dealt(rows, keys, n_rows, ROWS))


def register(r: Registry) -> None:
    @r.add("w8_xy_cut", f"{CUT_SQL} SELECT doc, page, item, leaf FROM leaves")
    def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The region of each row, by cuts into columns and bands until none can be cut."""
        return leaves(spark, sf_dir).select("doc", "page", "item", F.col("leaf").cast("long").alias("leaf"))

    @r.add(
        "w10_continued_columns",
        f"""{CUT_SQL}, b AS (SELECT doc, page, leaf AS block, min(x0) AS x0, max(x1) AS x1, arg_max(row_text, item) AS tail, arg_min(row_text, item) AS head, arg_min(x0, item) - min(x0) AS indent FROM leaves GROUP BY doc, page, leaf)
        SELECT doc, page, block FROM (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(tail) OVER w AS ptail FROM b WINDOW w AS (PARTITION BY doc, page ORDER BY block))
        WHERE (x0 >= px1 - 5 OR px0 >= x1 - 5) AND NOT regexp_matches(trim(ptail), '([.!?:;»”")]|^)$') AND regexp_matches(head, '^\\p{{Ll}}') AND indent <= 5""",
    )
    def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Regions beside the one before whose first paragraph goes on with its last."""
        no = F.lit(False)
        blocks = leaves(spark, sf_dir).groupBy("doc", "page", F.col("leaf").cast("long").alias("block")).agg(
            F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max_by("row_text", "item").alias("tail"), F.min_by("row_text", "item").alias("head"), (F.min_by("x0", "item") - F.min("x0")).alias("indent"), F.max("size").alias("head_size")
        )
        return geometry.continued(blocks.withColumns({"tail_size": F.col("head_size"), "tail_marked": no, "head_marked": no}), KEYS)

    @r.add("w14_drawn_tables", f"{GRIDS_SQL} SELECT doc, page, grid, x0, y0, x1, y1, len(xs) - 1 AS n_columns, len(ys) - 1 AS n_rows, array_to_string(list_transform(xs, lambda v: round(v * 100)::BIGINT), ' ') AS xs FROM grids")
    def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Tables drawn piece by piece, their columns by rules or by what is empty in all rows."""
        found = geometry.grids(*drawn_table(spark, sf_dir), KEYS, written)
        shown = F.array_join(F.transform("xs", lambda v: F.round(v * 100).cast("bigint")), " ")
        return found.select(*KEYS, F.col("grid").cast("long").alias("grid"), *geometry.BOX, (F.size("xs") - 1).cast("long").alias("n_columns"), (F.size("ys") - 1).cast("long").alias("n_rows"), shown.alias("xs"))

    @r.add(
        "w17_table_cells",
        f"""{GRIDS_SQL}, c AS (SELECT p.doc, p.page, p.grid, p.row, greatest(1, least(len(list_filter(xs, lambda v: v <= (p.x0 + p.x1) / 2)), len(xs) - 1)) AS col, ord, text FROM placed p JOIN grids gr ON p.doc = gr.doc AND p.page = gr.page AND p.grid = gr.grid AND len(xs) >= 3 AND len(ys) >= 3)
        SELECT * FROM (SELECT doc, page, grid, row::BIGINT AS row, col::BIGINT AS "column", string_agg(text, ' ' ORDER BY ord) AS text FROM c GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY doc, page, grid) >= 2""",
    )
    def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The words of each cell of those tables."""
        rules, words = drawn_table(spark, sf_dir)
        out = geometry.cells(words, geometry.grids(rules, words, KEYS, written), KEYS)
        return out.select(*KEYS, *(F.col(c).cast("long").alias(c) for c in ("grid", "row", "column")), "text")

    _cell = "CASE WHEN p % 3 = 0 THEN concat('a, \"', p, '\"') WHEN p % 3 = 1 THEN concat('b', p) END"

    @r.add(
        "a5_table_cells",
        f"""
        WITH c AS (SELECT doc AS "table", page + 1 AS row, ord AS col, {_cell.replace(chr(92), '')} AS text FROM {DRAWN_SQL}), w AS (SELECT "table", max(col) AS n FROM c GROUP BY 1),
        g AS (SELECT "table", row, col FROM (SELECT DISTINCT "table", row FROM c) JOIN (SELECT "table", unnest(range(1, n + 1)) AS col FROM w) USING ("table"))
        SELECT "table", row, string_agg(coalesce(CASE WHEN contains(text, ',') OR contains(text, '"') THEN '"' || replace(text, '"', '""') || '"' ELSE text END, ''), ',' ORDER BY col) AS line FROM g LEFT JOIN c USING ("table", row, col) GROUP BY "table", row
        UNION ALL SELECT "table", 0, string_agg('c' || k, ',' ORDER BY k) FROM (SELECT "table", unnest(range(1, n + 1)) AS k FROM w) GROUP BY "table"
        """,
    )
    def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Line items as cells of tables, as lines of CSV; the rows are the pages of a document, 1 to 8."""
        cells = drawn(spark, sf_dir).select(F.col("doc").alias("table"), (F.col("page") + 1).alias("row"), F.col("ord").cast("int").alias("col"), F.expr(_cell).alias("text"))
        return sinks.csv_lines(cells)

    size_sql, number_sql = "10.0 + (doc_id * 7 + line_no * 3) % 9", "list_filter(list_transform(string_split(lower(trim(text)), ' '), lambda t: regexp_replace(t, '^[-–—.,/|]+|[-–—.,/|]+$', '', 'g')), lambda t: t <> '')"
    marker = "'^([•◦▪*–-]|\\(?[0-9]{1,4}[.)]|\\(?[a-zA-Z][.)]|\\(?[ivxIVX]{1,4}[.)])$'"

    @r.add(
        "w11_heading_rules",
        f"""
        WITH p AS (SELECT doc_id, line_no, line, {size_sql} AS size FROM ({LINES_SQL}) WHERE trim(line) <> ''), m AS (SELECT doc_id, (list_sort(list(size)))[count(*) // 2 + 1] AS med FROM p GROUP BY doc_id)
        SELECT doc_id, line_no, CASE WHEN length(line) > 160 OR len(list_filter(string_split(line, ' '), lambda w: w <> '')) > 20 OR regexp_matches(split_part(ltrim(line), ' ', 1), {marker}) THEN 0 WHEN size / med >= 1.6 THEN 1 WHEN size / med >= 1.3 THEN 2 WHEN size / med >= 1.15 THEN 3 ELSE 0 END AS level
        FROM p JOIN m USING (doc_id)
        """,
    )
    def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Levels of lines as paragraphs of 80 characters a row, in sizes from 10 to 18."""
        p = lines(spark, sf_dir).where(F.trim("line") != "").withColumn("size", F.expr(size_sql).cast("double"))
        w = Window.partitionBy("doc_id")
        ranked = p.withColumn("_k", F.row_number().over(w.orderBy("size", "line_no"))).withColumn("_n", F.count(F.lit(1)).over(w))
        median = F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("size"))).over(w)
        words = F.size(F.filter(F.split("line", " "), lambda x: x != ""))
        level = geometry.heading_level(F.ceil(F.length("line") / 80), words, list_marker(F.col("line")), F.col("size"), F.col("median"))
        return ranked.withColumn("median", median).select("doc_id", "line_no", level.alias("level"))

    @r.add(
        "w12_isolated_edges",
        f"""{CUT_SQL}, b AS (SELECT doc, page, leaf AS block, min(y0) AS y0, max(y1) AS y1, count(DISTINCT y0) AS n_lines, string_agg(row_text, ' ' ORDER BY item) AS text FROM leaves GROUP BY doc, page, leaf),
        n AS (SELECT *, {number_sql} AS toks FROM b),
        f AS (SELECT *, n_lines <= 2 AS plain, len(toks) BETWEEN 1 AND 4 AND len(list_filter(toks, lambda t: NOT (regexp_matches(t, '^[0-9]{{1,4}}$') OR t IN ('page', 'p', 'pg', 'of', 'sur', 'de', 'seite')))) = 0 AND len(list_filter(toks, lambda t: regexp_matches(t, '^[0-9]{{1,4}}$'))) > 0 AS num,
            lead(y1) OVER w AS below, lag(y0) OVER w AS above, count(*) OVER (PARTITION BY doc, page) AS k FROM n WINDOW w AS (PARTITION BY doc, page ORDER BY block)),
        h AS (SELECT *, k > 1 AND bool_and(plain AND y1 >= 658 AND (coalesce(y0 - below >= 18, true) OR num)) OVER (PARTITION BY doc, page ORDER BY block ROWS UNBOUNDED PRECEDING) AS head FROM f),
        e AS (SELECT *, k > 1 AND bool_and(NOT head AND plain AND y0 <= 162 AND (coalesce(above - y1 >= 18, true) OR num)) OVER (PARTITION BY doc, page ORDER BY block DESC ROWS UNBOUNDED PRECEDING) AS foot FROM h)
        SELECT doc, page, block, CASE WHEN head THEN 'header' WHEN foot THEN 'footer' END AS edge FROM e""",
    )
    def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Headers and footers of pages by their own look: regions at the edge that stand apart or read like page numbers."""
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "row_text"))), lambda x: x["row_text"]), " ")
        blocks = leaves(spark, sf_dir).groupBy("doc", "page", F.col("leaf").cast("long").alias("block")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.countDistinct("y0").alias("n_lines"), F.max("size").alias("size"), text.alias("text"))
        fixed = {"page_y0": F.lit(100.0), "page_y1": F.lit(720.0), "median": F.lit(10.0), "pitch": F.lit(12.0)}
        return geometry.page_edges(blocks.withColumns(fixed), KEYS).select("doc", "page", "block", "edge")
