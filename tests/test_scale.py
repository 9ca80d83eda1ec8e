"""What a query shuffles, writes and holds per row must not depend on how many rows there are."""

import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from folioframe.operators import compare, layout
from folioframe.operators import geometry as g
from folioframe.operators import intervals
from folioframe.sources.tables import dealt

BOX = "doc int, page int, item int, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture
def written(spark):
    def write(df, what):
        path = f"{tempfile.mkdtemp(prefix='spark-scale-')}/{what}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def test_beside_is_overlapping(spark):
    rng = random.Random(5)
    rects = lambda n, pages: [(0, rng.choice(pages), k, x := rng.uniform(0, 500), y := rng.uniform(0, 500), x + rng.choice([0, 5, 300]), y + rng.choice([0, 5, 300])) for k in range(n)]
    a = spark.createDataFrame(rects(200, [1, 2, 3]), BOX)
    b = spark.createDataFrame(rects(60, [1]) + rects(5, [2]), BOX)  # one page beyond the bound, one below it, one without
    for few in (16, 100):
        got = g.beside(a, b, ["doc", "page"], 2.0, few=few)
        want = g.overlapping(a, b, ["doc", "page"], 2.0)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_words_of_few_tables_meet_them_by_page(spark):
    words = spark.createDataFrame([(0, 1, 1, 10.0, 10.0, 20.0, 20.0, "w")], BOX.replace("item", "ord") + ", text string")
    found = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 100.0, 100.0, [0.0, 50.0, 100.0], [100.0, 50.0, 0.0])], "doc int, page int, grid int, x0 double, y0 double, x1 double, y1 double, xs array<double>, ys array<double>")
    plan = g.cells(words, found, ["doc", "page"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_level" not in plan and plan.count("Join") == 1


def test_rows_are_dealt_to_more_tasks_as_they_grow(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    assert dealt(rows, ["k"], 1000).rdd.getNumPartitions() == 1
    assert dealt(rows, ["k"], 1000, 10).rdd.getNumPartitions() == 101


def test_candidates_are_near_pairs_and_few_others(spark):
    """Documents that share one rare word in twenty are no candidates."""
    rng = random.Random(6)
    docs = [(d, f"w{rng.randrange(4000)}") for d in range(60) for _ in range(60)] + [(d, f"r{d // 2}") for d in range(60)]
    docs += [(100 + d, w) for d in range(10) for i, w in enumerate(w for k, w in docs if k == d) if i % 12]  # near copies
    bags = spark.createDataFrame(docs, "doc int, word string").groupBy("doc", "word").agg(F.count("*").alias("n"))
    found = {(r.a, r.b) for r in compare.near_candidates(bags, 0.8).collect()}
    assert {(d, 100 + d) for d in range(10)} <= found and len(found) <= 15
    by = {}
    for r in bags.collect():
        by.setdefault(r.doc, {})[r.word] = r.n
    size = {d: sum(b.values()) for d, b in by.items()}
    for t in (0.05, 0.4, 0.8):
        want = {(a, b) for a in by for b in by if a < b and 2 * sum(min(n, by[b].get(w, 0)) for w, n in by[a].items()) >= t * (size[a] + size[b])}
        assert {(r.a, r.b) for r in compare.near_pairs(bags, t).collect()} == want


def test_bags_of_dealt_documents_and_their_dice_shuffle_the_text_once(spark):
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.split(F.lit("a b c a"), " ").alias("words")).repartition("doc_id")
    assert compare.word_bags(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_dice_of_documents_is_that_of_bags(spark):
    texts = ["a b c a", "a c d", None, "", "x x", "x x", "q", "..", "a", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    words = lambda t: F.filter(F.split(t, " "), lambda w: w.rlike("[a-z]"))
    pairs = spark.range(5).select((F.col("id") * 2).cast("int").alias("a"), (F.col("id") * 2 + 1).cast("int").alias("b"))
    found = compare.dice_of_documents(pairs, docs, words)
    want = compare.dice_of_pairs(pairs, compare.word_bags(docs.select("doc", words(F.col("text")).alias("words")), doc="doc"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_lines_by_baselines_alone(spark):
    rows = spark.createDataFrame([(1, 1, n, "abc " * n) for n in (1, 2, 5)] + [(1, 2, 1, "x")], "doc int, page int, line int, row_text string")
    glyphs = layout.glyphs(rows.repartition(3, "doc", "page"))
    n = lambda df: sorted(map(tuple, df.groupBy("doc", "page").agg(F.max("line_no")).collect()))
    assert layout.baselines(glyphs).count() == 4 and n(layout.lines_of(layout.baselines(glyphs))) == n(layout.lines_of(glyphs))
    dealt_once = layout.words_of(layout.glyphs(rows.repartition(3, "doc", "page", "line")))
    assert dealt_once._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_cuts_in_as_many_tasks_as_asked_for(spark, written):
    items = spark.createDataFrame([(0, 1, k, float(x), 700.0 - 12 * k, x + 200.0, 710.0 - 12 * k, 700.0 - 12 * k, 10.0, False) for x in (50, 300) for k in range(x, x + 4)], BOX + ", base double, size double, is_table boolean")
    asked = []
    deal = lambda rows, keys: asked.append(keys) or rows.repartition(7, *keys)
    got = g.columns(items, ["doc", "page"], written, deal)
    assert sorted(map(tuple, got.select("item", "leaf").collect())) == sorted(map(tuple, g.columns(items, ["doc", "page"], written).select("item", "leaf").collect()))
    assert got.rdd.getNumPartitions() == 7 and ["doc", "page"] in asked


def test_rounds_of_labels_follow_the_depth(spark, written):
    """A flat tree of 5000 nodes is labelled in a few rounds, and only nodes with children take part in them."""
    nodes = spark.range(5000).select(F.lit(1).alias("doc"), "id", F.when(F.col("id") > 0, 0).cast("bigint").alias("parent"), F.col("id").alias("ord")).withColumnRenamed("id", "node")
    kept = []
    got = intervals.label(nodes, ["doc"], lambda rows, what: kept.append(what) or written(rows, f"{what}-{len(kept)}"))
    assert len(kept) <= 8
    assert {(r.node, r.first, r.last, r.depth) for r in got.collect()} == {(0, 0, 9999, 0)} | {(n, 2 * n - 1, 2 * n, 1) for n in range(1, 5000)}


def test_account_keys_in_one_pass(spark):
    """The longest head with a right key, like trying all heads; lines of customers go to more tasks as they grow."""
    from folioframe.functions import numbers as N
    from folioframe.operators import search

    rng = random.Random(4)
    texts = ["FR7630006000011234567890189", "FR", "", "GB82WEST12345698765432"] + ["".join([*rng.choices("ABXYZ", k=2), *rng.choices("0123456789", k=2), *rng.choices("0123456789AZ", k=rng.randint(11, 30))]) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.get(F.filter(F.sequence(F.greatest(F.length("t"), F.lit(15)), F.lit(15), F.lit(-1)), lambda n: (n <= F.length("t")) & (N.mod97(F.concat(F.substring("t", F.lit(5), n - 4), F.substring("t", 1, 4))) == 1)), 0)
    rows = df.select("t", search.iban_size(F.col("t")).alias("got"), every.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and rows[0].got == 27 and sum(r.got is not None for r in rows) > 10


def test_lines_of_customers_go_to_more_tasks(spark, monkeypatch):
    from folioframe.plans import finding
    from folioframe.plans.catalog import REGISTRY

    monkeypatch.setattr(finding, "LINES_SEARCHED", 10)
    assert REGISTRY.queries["p2_p6_national"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 15  # 150 customers


def test_diff_of_documents_is_that_of_their_words(spark):
    rng = random.Random(8)
    texts = [(p, side, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for p, letters in ((p, "abcdefghijklmnopqrstuvwxyz"[: rng.choice([3, 9, 26])]) for p in range(40)) for side in ("old", "new")]
    texts += [(100, "old", "a b"), (101, "new", "a b"), (102, "old", None), (102, "new", "x"), (103, "old", " "), (103, "new", None), (104, "old", "same"), (104, "new", "same"), (None, "new", "n")]
    texts += [(105, "old", "b c x"), (105, "old", "b b"), (105, "old", None), (105, "new", "b x c")]  # two texts of a side are read in turn
    docs = spark.createDataFrame(texts, "pair long, side string, text string")
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    tokens = docs.select("pair", "side", F.posexplode(words(F.col("text"))).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))
    found, want = compare.diff_of_documents(docs, words, 3), compare.word_diff(tokens, compare.anchor_chain(compare.anchors(tokens)))
    key = lambda r: (r[0] is None, r)
    assert found.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_word_diff_shuffles_texts_once_and_goes_to_more_tasks(spark, monkeypatch):
    from folioframe.plans import assembly
    from folioframe.plans.catalog import REGISTRY

    monkeypatch.setattr(assembly, "DOCS_DEALT", 50, raising=False)
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    found = REGISTRY.queries["d7_d8_word_diff"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == n // 50 + 1
    monkeypatch.undo()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found.collect()
        final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" not in final and final.count("- ReusedExchange") == 1 and final.count("- Exchange") == 1


def test_table_of_a_gap_grows_by_its_words_not_its_cells():
    rng = random.Random(9)
    old, new = ([f"w{rng.randrange(60)}" for _ in range(n)] for n in (2000, 2000))
    took = []
    for _ in range(5):
        began = time.process_time()
        found = compare._by_table(old, new)
        took.append(time.process_time() - began)
    assert min(took) < 0.03 and [old[i] for i, _ in found] == [new[j] for _, j in found]


def test_words_of_rows_are_those_of_glyphs(spark):
    """The same lines and words as from rows of glyphs, without a row or a shuffle for them."""
    texts = ["", " ", "a", " a  bc ", "   ", "é 😀x ﬁ", "tab\there", "no break   z", "x" * 80, "end "]
    rows = spark.createDataFrame([(d, p, n, t) for d in (1, 2) for p in (1, 2) for n, t in enumerate(texts[d - 1 :], 1)] + [(3, 1, 1, " ")], "doc long, page long, line long, row_text string")
    for size in (10.0, 7.0):
        words = layout.words_of(layout.glyphs(rows, size))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ")
        want = words.groupBy("doc", "page", "line").agg(F.count("*").alias("n_words"), text.alias("text"))
        found = layout.lines_and_words(rows, size)
        assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert layout.lines_and_words(rows.limit(0)).count() == 0
    from folioframe.plans.catalog import REGISTRY

    plan = REGISTRY.queries["w2_w4_lines_and_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("Generate") == 1


def test_a_long_line_is_wrapped_in_time_of_its_length(spark):
    """Rows are cut in turn, not each counted from the line's start."""
    wrap = lambda n: layout.paginate(spark.range(1).select("id", F.repeat(F.lit("é😀 \r"), n).alias("text")), doc="id")
    rows = wrap(43).collect()
    assert "".join(r.row_text for r in rows) == "é😀 \r" * 43 and [len(r.row_text) for r in rows] == [80, 80, 12]
    began = time.time()
    assert wrap(500_000).agg(F.sum(F.length("row_text"))).head()[0] == 2_000_000
    assert time.time() - began < 8


def test_clusters_of_missing_and_equal_prices_are_those_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from folioframe.plans.catalog import REGISTRY

    prices = [(1, p) for p in (None, 10.0, 30.0, 100.0, None, float("nan"))] + [(2, None), (3, 5.0), (3, 5.0), (3, 31.0), (None, 1.0)]
    spark.createDataFrame(prices, "l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = REGISTRY.queries["w16_clusters"](spark, str(tmp_path)).select("l_suppkey", "cluster", "n", "mean").collect()
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"select l_suppkey, cluster, n, mean from ({REGISTRY.sql['w16_clusters']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and "(1, 4, 1, None)" in map(str, want)
