"""Queries of structure trees: edits, text in structure order, order of structure against layout.

A document set in pages is a tree of the document, its pages, blocks of five rows and rows; rows refer to the marked
content of their page. In every third document the blocks of a page stand in reverse order in the tree. The first row of
a page is a running head, an artifact to which no node refers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import intervals
from folioframe.plans import Registry
from folioframe.plans.structure import ROWS_SQL, wrapped
from folioframe.sources.scratch import written

KEYS = ["doc"]
#: Node ids: 0 the document, page * 1000 + block * 60 + row; order of the blocks of a page.
BLOCK = "((line - 1) // 5 + 1)"
_turned = "CASE WHEN doc % 3 = 0 THEN -{b} ELSE {b} END"


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, content)."""
    rows = wrapped(spark, sf_dir).withColumn("line", F.col("line").cast("bigint")).withColumn("b", F.floor((F.col("line") - 1) / 5) + 1)
    rows = written(rows.select("doc", F.col("page").cast("bigint").alias("page"), "line", "b", "row_text"), "rows")
    none = F.array().cast("array<struct<page: bigint, mcid: bigint>>")
    node = lambda df, i, parent, ord, kind, marks=none: df.select("doc", i.cast("bigint").alias("node"), parent.cast("bigint").alias("parent"), ord.cast("bigint").alias("ord"), F.lit(kind).alias("kind"), marks.alias("marks"))  # noqa: E731, A002
    page, b, line = F.col("page") * 1000, F.col("b"), F.col("line")
    top = node(rows.select("doc").distinct(), F.lit(0), F.lit(None), F.lit(0), "Document")
    pages = node(rows.select("doc", "page").distinct(), page, F.lit(0), F.col("page"), "Sect")
    blocks = node(rows.select("doc", "page", "b").distinct(), page + b * 60, page, F.expr(_turned.format(b="b")), "P")
    leaves = node(rows.where("line > 1"), page + b * 60 + (line - 1) % 5 + 1, page + b * 60, line, "Span", F.array(F.struct("page", line.alias("mcid"))))
    content = rows.select("doc", "page", line.alias("mcid"), F.col("row_text").alias("text"))
    return top.unionByName(pages).unionByName(blocks).unionByName(leaves), content


_rows = f"(SELECT doc, page::BIGINT AS page, line::BIGINT AS line, {BLOCK} AS b, row_text FROM ({ROWS_SQL}))"
#: Nodes with the keys by which they sort in the walk around their tree.
TREE_SQL = f"""
t AS MATERIALIZED (
    SELECT doc, 0::BIGINT AS node, NULL::BIGINT AS parent, [0]::BIGINT[] AS path, 'Document' AS kind FROM {_rows} GROUP BY doc
    UNION ALL SELECT doc, page * 1000, 0, [0, page], 'Sect' FROM {_rows} GROUP BY doc, page
    UNION ALL SELECT doc, page * 1000 + b * 60, page * 1000, [0, page, {_turned.format(b='b')}], 'P' FROM {_rows} GROUP BY doc, page, b
    UNION ALL SELECT doc, page * 1000 + b * 60 + (line - 1) % 5 + 1, page * 1000 + b * 60, [0, page, {_turned.format(b='b')}, line], 'Span' FROM {_rows} WHERE line > 1)
"""


def register(r: Registry) -> None:
    @r.add(
        "k4_structure_edits",
        f"""
        WITH {TREE_SQL}, kept AS (SELECT * FROM t WHERE NOT (kind = 'P' AND node // 60 % 4 = 3)
            AND NOT EXISTS (SELECT 1 FROM t x WHERE x.doc = t.doc AND x.kind = 'P' AND x.node // 60 % 4 = 3 AND x.node = t.parent)),
        moved AS (SELECT doc, node, parent, CASE WHEN len(path) >= 2 AND path[2] = 2 THEN list_concat([0, -5], path[3:]) ELSE path END AS path, CASE WHEN kind = 'Sect' AND node = 1000 THEN 'Part' ELSE kind END AS kind FROM kept),
        added AS (SELECT * FROM moved UNION ALL SELECT doc, node + 999, node, list_append(path, 5000), 'Note' FROM moved WHERE kind IN ('Sect', 'Part')),
        walk AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS pre FROM added)
        SELECT a.doc, a.node, a.parent, a.kind, a.pre, len(a.path) - 1 AS depth, count(*) AS size FROM walk a JOIN walk b ON a.doc = b.doc AND b.path[1:len(a.path)] = a.path GROUP BY ALL
        """,
    )
    def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Trees after edits: blocks gone with their rows, second pages moved to the front, a note on each page, first pages renamed."""
        nodes, _ = tree(spark, sf_dir)
        labelled = written(intervals.label(nodes.drop("marks"), KEYS, written), "labelled")
        sections = labelled.where("kind = 'Sect'")
        after = intervals.edited(
            labelled, KEYS, removed=labelled.where("kind = 'P' AND floor(node / 60) % 4 = 3"), moved=sections.where("node = 2000").withColumn("ord", F.lit(-5).cast("bigint")),
            added=sections.select("doc", (F.col("node") + 999).alias("node"), F.col("node").alias("parent"), F.lit(5000).cast("bigint").alias("ord"), F.lit("Note").alias("kind")), renamed=sections.where("node = 1000").withColumn("kind", F.lit("Part")),
        )
        out = intervals.label(written(after, "edited"), KEYS, written)
        return out.select("doc", "node", "parent", "kind", intervals.preorder(F.col("first"), F.col("depth")).alias("pre"), "depth", intervals.size(F.col("first"), F.col("last")).alias("size"))

    @r.add(
        "k6_structure_text",
        f"""
        WITH {TREE_SQL}, m AS (SELECT t.doc, t.path, row_text FROM t JOIN {_rows} x ON x.doc = t.doc AND t.kind = 'Span' AND x.page = t.path[2] AND x.line = t.path[4] WHERE x.line > 1),
        p AS (SELECT doc, path[1:3] AS block, string_agg(row_text, ' ' ORDER BY path) AS body FROM m GROUP BY doc, path[1:3])
        SELECT doc, md5(regexp_replace(regexp_replace(trim(regexp_replace(string_agg(body, chr(10) ORDER BY block), '\\s*\\n\\s*', chr(10), 'g')), '^\\n', ''), '\\n$', '')) AS text_md5 FROM p GROUP BY doc
        """,
    )
    def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Text by the order of the tree, artifacts left out."""
        nodes, content = tree(spark, sf_dir)
        text = intervals.structure_text(intervals.label(nodes, KEYS, written), content, KEYS, ["P"])
        return text.where("text IS NOT NULL").join(nodes.where("kind = 'Span'").select("doc").distinct(), "doc", "left_semi").select("doc", F.md5(F.col("text").cast("binary")).alias("text_md5"))

    @r.add(
        "u9_order_inversions",
        f"""
        SELECT doc, page, count(*) AS n, CASE WHEN doc % 3 = 0 THEN max(k) ELSE count(*) END AS longest, CASE WHEN doc % 3 = 0 THEN count(*) - max(k) ELSE 0 END AS n_moved
        FROM (SELECT doc, page, b, count(*) OVER (PARTITION BY doc, page, b) AS k FROM {_rows} WHERE line > 1) GROUP BY doc, page
        """,
    )
    def u9(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How many rows of each page stand out of order in the tree."""
        nodes, _ = tree(spark, sf_dir)
        spans = intervals.label(nodes, KEYS, written).where("kind = 'Span'").select("doc", F.col("marks")[0].page.alias("page"), F.col("first").alias("structure"), F.col("marks")[0].mcid.alias("layout"))
        return intervals.inversions(spans, ["doc", "page"])
