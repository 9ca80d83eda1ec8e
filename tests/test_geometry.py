"""Overlap joins against all pairs, cuts of planted pages, ruled tables with and without uprights."""

import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from folioframe.operators import geometry as g

BOX = "doc int, page int, item int, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture
def written(spark):
    def write(df, what):
        path = f"{tempfile.mkdtemp(prefix='spark-geometry-')}/{what}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def boxes(rng, n, sizes):
    out = []
    for k in range(n):
        w, h = rng.choice(sizes), rng.choice(sizes)
        x, y = rng.uniform(-200, 900), rng.uniform(-200, 900)
        out.append((rng.randint(0, 1), rng.randint(0, 2), k, x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("touch", [0.0, 3.0])
def test_overlapping_is_all_pairs(spark, touch):
    rng = random.Random(4)
    a = boxes(rng, 150, [0, 1, 10, 64, 300, 3000]) + [(0, 0, 900, 64.0, 64.0, 128.0, 128.0), (0, 0, 901, 0.0, 0.0, 0.0, 0.0)]
    b = boxes(rng, 150, [0, 5, 100, 1024, 2500]) + [(0, 0, 900, 128.0, 128.0, 192.0, 192.0), (0, 0, 901, 0.0, 0.0, 0.0, 0.0)]
    got = g.overlapping(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ["doc", "page"], touch).select("item", "o_item").collect()
    want = [(p[2], q[2]) for p in a for q in b if p[:2] == q[:2] and p[3] <= q[5] + touch and q[3] - touch <= p[5] and p[4] <= q[6] + touch and q[4] - touch <= p[6]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_page_of_many_marks_and_one_large_fill(spark):
    marks = spark.range(100_000).selectExpr("0 AS doc", "0 AS page", "cast(id AS int) AS item", "id % 400 * 4.0D AS x0", "floor(id / 400) * 4.0D AS y0", "id % 400 * 4.0D + 3 AS x1", "floor(id / 400) * 4.0D + 3 AS y1")
    fills = spark.range(100_000).selectExpr("0 AS doc", "0 AS page", "cast(id AS int) AS item", "id % 400 * 4.0D + 1 AS x0", "floor(id / 400) * 4.0D + 1 AS y0", "CASE WHEN id = 0 THEN 1600D ELSE id % 400 * 4.0D + 2 END AS x1", "CASE WHEN id = 0 THEN 1000D ELSE floor(id / 400) * 4.0D + 2 END AS y1")
    began = time.time()
    assert g.overlapping(marks, fills, ["doc", "page"]).count() == 2 * 100_000 - 1
    assert time.time() - began < 60


def text(doc, page, rows):
    """Items from (x0, x1, baseline) of rows."""
    return [(doc, page, k, float(x0), float(y), float(x1), float(y + 10), float(y), 10.0, False) for k, (x0, x1, y) in enumerate(rows)]


ITEMS = f"{BOX}, base double, size double, is_table boolean"
COLUMN = lambda x0, x1, top, n: [(x0, x1, top - 12 * k) for k in range(n)]


def leaves(spark, written, items):
    got = g.columns(spark.createDataFrame(items, ITEMS), ["doc", "page"], written).select("page", "leaf", "item").collect()
    out = {}
    for r in got:
        out.setdefault(r.page, {}).setdefault(r.leaf, []).append(r.item)
    return {p: [sorted(v) for _, v in sorted(x.items())] for p, x in out.items()}


def test_planted_columns_and_bands(spark, written):
    two = text(0, 1, COLUMN(50, 250, 700, 5) + COLUMN(300, 500, 700, 4))
    band = text(0, 2, [(50, 500, 760)] + COLUMN(50, 250, 700, 5) + COLUMN(300, 500, 700, 5))
    three = text(0, 3, COLUMN(50, 180, 700, 3) + COLUMN(200, 340, 700, 3) + COLUMN(360, 500, 700, 3))
    single = text(0, 4, COLUMN(50, 500, 700, 5))
    lone = text(0, 5, COLUMN(50, 250, 700, 3) + [(300, 500, 700)])  # one baseline is no column
    nested = text(0, 6, COLUMN(50, 250, 700, 2) + COLUMN(50, 250, 600, 2) + COLUMN(300, 390, 700, 3) + COLUMN(410, 500, 700, 3))
    one = text(0, 7, [(50, 60, 700)])
    alone = text(0, 8, COLUMN(50, 250, 700, 2)) + [(0, 8, 9, 300.0, 650.0, 500.0, 720.0, 650.0, 10.0, True)]  # a table counts as two baselines
    got = leaves(spark, written, two + band + three + single + lone + nested + one + alone)
    assert got[1] == [[0, 1, 2, 3, 4], [5, 6, 7, 8]]
    assert got[2] == [[0], [1, 2, 3, 4, 5], [6, 7, 8, 9, 10]]
    assert got[3] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    assert got[4] == [[0, 1, 2, 3, 4]] and got[5] == [[0, 1, 2, 3]] and got[7] == [[0]]
    assert got[6] == [[0, 1], [2, 3], [4, 5, 6], [7, 8, 9]]
    assert got[8] == [[0, 1], [9]]
    assert leaves(spark, written, []) == {}


def test_paragraphs_go_on_only_beside(spark):
    schema = "doc int, block int, x0 double, x1 double, tail string, head string, tail_size double, head_size double, tail_marked boolean, head_marked boolean, indent double"
    base = [(0.0, 100.0, "it goes", "The", 10.0, 10.0, False, False, 0.0), (120.0, 220.0, "end", "on here", 10.0, 10.0, False, False, 0.0)]
    change = lambda first=None, second=None: [(first or {}).get(i, v) for i, v in enumerate(base[0])] + [(second or {}).get(i, v) for i, v in enumerate(base[1])]
    cases = [change(), change(second={0: 0.0, 1: 100.0}), change({2: "it ends."}), change(second={3: "On here"}), change(second={5: 13.0}), change({6: True}), change(second={7: True}), change(second={8: 6.0}), change({2: None}), change(second={3: "été"})]
    rows = [(k, 1, *c[:9]) for k, c in enumerate(cases)] + [(k, 2, *c[9:]) for k, c in enumerate(cases)]
    assert sorted(r.doc for r in g.continued(spark.createDataFrame(rows, schema), ["doc"]).collect()) == [0, 9]


def ruled(page, uprights):
    """Rules of a table of 3 rows and 3 columns, drawn cell by cell."""
    out = [(0, page, 0, x0, y, x1, y + 0.5) for y in (700.0, 680.3, 660.0, 640.0) for x0, x1 in ((50.0, 150.0), (151.5, 250.0), (250.0, 350.0))]
    return out + [(0, page, 0, x, y, x + 0.5, y + 20) for x in (50.0, 150.0, 250.0, 350.0) for y in (640.0, 660.0, 680.0) if uprights]


def test_tables_by_rules_and_by_gaps(spark, written):
    rules = ruled(1, True) + ruled(2, False) + [(0, 3, 0, 50.0, 700.0, 350.0, 700.5)] + [(0, 4, 0, 50.0, 700.0, 350.0, 700.5), (0, 4, 0, 50.0, 600.0, 200.0, 600.5)]
    words = [(0, p, 10 * r + 2 * c + k, 55.0 + 100 * c + 30 * k, 685.0 - 20 * r, 80.0 + 100 * c + 30 * k, 695.0 - 20 * r, f"{r}{c}{k}") for p in (1, 2) for r in range(3) for c in range(3) for k in range(2) if (r, c) != (1, 1)]
    df = spark.createDataFrame(words, "doc int, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    found = g.grids(spark.createDataFrame(rules, BOX).drop("item"), df, ["doc", "page"], written)
    by = {r.page: r for r in found.collect()}
    assert set(by) == {1, 2}
    assert by[1].xs == [50.25, 150.25, 250.25, 350.25] and len(by[1].ys) == 4
    assert by[2].xs == [50.0, 132.5, 232.5, 350.0]
    cells = {(r.page, r.row, r.column): r.text for r in g.cells(df, found, ["doc", "page"]).collect()}
    want = {(p, r + 1, c + 1): f"{r}{c}0 {r}{c}1" for p in (1, 2) for r in range(3) for c in range(3) if (r, c) != (1, 1)}
    assert cells == want


def test_heading_levels(spark):
    rows = [(1, 5, False, 16.0, 1), (1, 5, False, 13.0, 2), (2, 20, False, 11.5, 3), (1, 5, False, 11.4, 0), (3, 5, False, 16.0, 0), (1, 21, False, 16.0, 0), (1, 5, True, 16.0, 0)]
    df = spark.createDataFrame(rows, "n_lines int, n_words int, marked boolean, size double, want int").withColumn("median", F.lit(10.0))
    got = df.select(g.heading_level(F.col("n_lines"), F.col("n_words"), F.col("marked"), F.col("size"), F.col("median")).alias("level"), "want").collect()
    assert [r.level for r in got] == [r.want for r in got]
    assert df.limit(1).select(g.heading_level(F.col("n_lines"), F.col("n_words"), F.col("marked"), F.col("size"), F.lit(0.0)).alias("level")).head()[0] == 0


def test_headers_and_footers_of_one_page(spark):
    schema = "page int, block int, y0 double, y1 double, n_lines int, size double, text string"
    rows = [
        (1, 1, 770.0, 780.0, 1, 10.0, "Report"), (1, 2, 300.0, 700.0, 30, 10.0, "body"), (1, 3, 20.0, 30.0, 1, 10.0, "Page 3"),
        (2, 1, 770.0, 780.0, 1, 10.0, "Heading close to its text"), (2, 2, 300.0, 765.0, 30, 10.0, "body"),
        (3, 1, 770.0, 780.0, 1, 10.0, "7"), (3, 2, 755.0, 765.0, 1, 10.0, "Report"), (3, 3, 100.0, 700.0, 30, 10.0, "body"),
        (4, 1, 770.0, 780.0, 1, 14.0, "Large"), (4, 2, 100.0, 700.0, 30, 10.0, "body"), (4, 3, 60.0, 70.0, 1, 10.0, "note"), (4, 4, 20.0, 30.0, 1, 10.0, "4"),
        (5, 1, 770.0, 780.0, 1, 10.0, "alone"),
        (6, 1, 740.0, 790.0, 3, 10.0, "three lines"), (6, 2, 100.0, 700.0, 30, 10.0, "body"),
    ]
    fixed = {"page_y0": F.lit(0.0), "page_y1": F.lit(800.0), "median": F.lit(10.0), "pitch": F.lit(12.0)}
    got = {(r.page, r.block): r.edge for r in g.page_edges(spark.createDataFrame(rows, schema).withColumns(fixed), ["page"]).collect()}
    assert {k for k, v in got.items() if v == "header"} == {(1, 1), (3, 1), (3, 2)}
    assert {k for k, v in got.items() if v == "footer"} == {(1, 3), (4, 3), (4, 4)}
