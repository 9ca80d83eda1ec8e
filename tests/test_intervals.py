"""Interval labels of trees, edits by them, text in structure order."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import intervals as iv

NODES = "doc int, node long, parent long, ord long, kind string"


@pytest.fixture
def written(spark):
    def write(df, what):
        path = f"{tempfile.mkdtemp(prefix='spark-intervals-')}/{what}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def walk(rows):
    """{(doc, node): (first, last, depth)} by a plain walk; circles are never reached."""
    out = {}
    for doc in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == doc}
        kids = {}
        for _, node, parent, ord, _ in mine.values():
            kids.setdefault(parent if parent in mine else None, []).append((ord, node))
        at, stack = 0, [(n, False, 0) for _, n in sorted(kids.get(None, []), reverse=True)]
        while stack:
            n, out_of, depth = stack.pop()
            if out_of:
                out[doc, n] = (out[doc, n][0], at, depth)
            else:
                out[doc, n] = (at, None, depth)
                stack.append((n, True, depth))
                stack += [(k, False, depth + 1) for _, k in sorted(kids.get(n, []), reverse=True)]
            at += 1
    return out


def random_trees(rng, docs=6):
    out = []
    for d in range(docs):
        n = rng.randint(1, 40)
        for k in range(n):
            out.append((d, k, rng.choice([None, rng.randrange(k), rng.randrange(k)]) if k else None, rng.randint(0, 3), "P"))
    return out + [(90, 1, 2, 0, "P"), (90, 2, 1, 0, "P"), (90, 3, 2, 0, "P"), (90, 4, 77, 0, "P")]  # a circle, and an absent parent


def test_labels(spark, written):
    rows = random_trees(random.Random(1))
    got = {(r.doc, r.node): (r["first"], r["last"], r.depth) for r in iv.label(spark.createDataFrame(rows, NODES), ["doc"], written).collect()}
    assert got == walk(rows)
    assert iv.label(spark.createDataFrame([], NODES), ["doc"], written).count() == 0


def test_a_chain_of_100_000_nodes(spark, written):
    df = spark.range(100_000).selectExpr("1 AS doc", "id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent", "0L AS ord", "'P' AS kind")
    got = iv.label(df, ["doc"], written).agg(F.count("*"), F.max("depth"), F.max("last"), F.bool_and(F.col("first") == F.col("node")), F.bool_and(F.col("last") == 199_999 - F.col("node"))).head()
    assert tuple(got) == (100_000, 99_999, 199_999, True, True)


def test_edits(spark, written):
    rows = [(1, 1, None, 0, "Document"), (1, 2, 1, 1, "Sect"), (1, 3, 1, 2, "Sect"), (1, 4, 2, 1, "P"), (1, 5, 2, 2, "P"), (1, 6, 4, 1, "Span"), (1, 7, 3, 1, "P")]
    labelled = written(iv.label(spark.createDataFrame(rows, NODES), ["doc"], written), "labelled")
    at = lambda pairs, schema: spark.createDataFrame(pairs, schema)
    node = "doc int, node long"
    assert sorted(r.node for r in iv.under(labelled, at([(1, 2)], node), ["doc"]).collect()) == [2, 4, 5, 6]
    assert sorted(r.node for r in iv.under(labelled, at([(1, 4), (1, 2), (1, 7)], node), ["doc"]).collect()) == [2, 4, 5, 6, 7]
    place = "doc int, node long, parent long, ord long"
    got = iv.edited(
        labelled, ["doc"], removed=at([(1, 5)], node), moved=at([(1, 4, 3, 0), (1, 2, 6, 0), (1, 7, 5, 0), (1, 3, 99, 0)], place), added=at([(1, 8, 4, 9, "Note"), (1, 9, 8, 0, "Link"), (1, 10, 5, 0, "Lost")], f"{place}, kind string"), renamed=at([(1, 1, "Part")], f"{node}, kind string")
    ).collect()
    assert sorted((r.node, r.parent, r.ord, r.kind) for r in got) == [(1, None, 0, "Part"), (2, 1, 1, "Sect"), (3, 1, 2, "Sect"), (4, 3, 0, "P"), (6, 4, 1, "Span"), (7, 3, 1, "P"), (8, 4, 9, "Note"), (9, 8, 0, "Link")]
    again = {r.node: (r["first"], r["last"], r.depth) for r in iv.label(spark.createDataFrame([tuple(r) for r in got], NODES), ["doc"], written).collect()}
    assert again == {n: v for (_, n), v in walk([tuple(r) for r in got]).items()}


def test_text_follows_the_tree(spark, written):
    schema = f"{NODES}, marks array<struct<page: long, mcid: long>>"
    rows = [(1, 1, None, 0, "Document", []), (1, 2, 1, 2, "P", [(1, 0), (1, 3)]), (1, 3, 1, 1, "P", []), (1, 4, 3, 1, "Span", [(2, 0)]), (1, 5, 3, 2, "Span", [(1, 9)]), (2, 1, None, 0, "P", [(1, 0)])]
    content = spark.createDataFrame([(1, 1, 0, "second"), (1, 1, 3, "half"), (1, 2, 0, "first"), (1, 1, 1, "running head"), (2, 1, 0, "alone")], "doc int, page long, mcid long, text string")
    labelled = iv.label(spark.createDataFrame(rows, schema), ["doc"], written)
    assert {r.doc: r.text for r in iv.structure_text(labelled, content, ["doc"], ["P"]).collect()} == {1: "first\nsecond half", 2: "alone"}


def test_inversions(spark):
    orders = {1: [1, 2, 3], 2: [3, 2, 1], 3: [2, 1, 4, 3], 4: [5]}
    df = spark.createDataFrame([(d, k, v) for d, x in orders.items() for k, v in enumerate(x)], "doc int, structure long, layout long")
    assert sorted(tuple(r) for r in iv.inversions(df, ["doc"]).collect()) == [(1, 3, 3, 0), (2, 3, 1, 2), (3, 4, 2, 2), (4, 1, 1, 0)]
