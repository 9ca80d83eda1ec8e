"""Edge values of the functions and operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioframe.functions import numbers as N
from folioframe.functions import text as T
from folioframe.operators import compare, forms, layout, pages, ranges, rules, search, trees, uris
from folioframe.plans.records import nearest
from folioframe.sources.scratch import ensure_checkpoints


def one(spark, column, **values):
    """The value of a column built from literals."""
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "want"), [(4, "IV"), (9, "IX"), (14, "XIV"), (40, "XL"), (1987, "MCMLXXXVII"), (4000, "MMMM"), (0, "")])
def test_roman(spark, n, want):
    assert one(spark, N.roman(F.lit(n))) == want


@pytest.mark.parametrize(("n", "want"), [(1, "a"), (26, "z"), (27, "aa"), (28, "bb"), (52, "zz"), (53, "aaa")])
def test_letters(spark, n, want):
    assert one(spark, N.letters(F.lit(n))) == want


@pytest.mark.parametrize(("n", "want"), [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (18279, "AAAA")])
def test_alpha(spark, n, want):
    assert one(spark, N.alpha(F.lit(n))) == want


@pytest.mark.parametrize(
    ("raw", "want", "offset"),
    [("D:20240115103045+02'00'", "2024-01-15T10:30:45", 120), ("D:2024", "2024-01-01T00:00:00", None), ("20231231235959-0530", "2023-12-31T23:59:59", -330), ("chatter", None, None), ("D:20240231", "2024-02-29T00:00:00", None)],
)
def test_dates(spark, raw, want, offset):
    stamp, minutes = N.parse_document_date(F.lit(raw))
    assert one(spark, stamp) == (datetime.datetime.fromisoformat(want) if want else None)
    assert one(spark, minutes) == offset


@pytest.mark.parametrize(("text", "want"), [("800 KB", 819200), ("1,5 Mo", 1572864), ("2G", 2**31), ("7", 7), ("x", None)])
def test_sizes(spark, text, want):
    assert one(spark, N.parse_size(F.lit(text))) == want


def test_text_functions(spark):
    assert one(spark, T.normalize_text(F.lit("l’été ﬁn – x "), True)) == "l'été fin - x"
    assert one(spark, T.header_key(F.lit("  Page  12 of 90 "))) == "page ## of ##"
    assert [one(spark, T.looks_like_page_number(F.lit(x))) for x in ("- 12 -", "Page 3 of 9", "12345", "hello 1", "page")] == [True, True, False, False, False]
    assert [one(spark, T.list_marker(F.lit(x))) for x in ("• a", "1. a", "(2) a", "iv. a", "word a")] == [True, True, True, True, False]
    assert one(spark, T.clean_title(F.lit("word " * 50))) == ("word " * 23 + "word…")
    assert one(spark, T.template("{a}-{{b}}-{c}", a=F.lit(1))) == "1-{b}-{c}"
    assert one(spark, N.mod97(F.lit("3214282912345698765432161182"))) == 1
    assert one(spark, N.color_hex(F.lit(1), F.lit(171), F.lit(255))) == "#01ABFF"


def test_search_and_redaction(spark):
    lines = spark.createDataFrame([(1, 1, "mail a@b.cc, a@b.cc or 10.0.0.1"), (1, 2, "none"), (2, 1, "")], "doc int, line_no int, line string")
    hits = search.candidates(lines, ["doc", "line_no"])
    assert sorted((h.kind, h.start, h.end) for h in hits.collect()) == [("email", 6, 12), ("email", 14, 20), ("ipv4", 24, 32)]
    out = {(r.doc, r.line_no): r for r in search.redact(lines, hits, ["doc", "line_no"]).collect()}
    assert out[1, 1].redacted == "mail [x], [x] or [x]" and out[1, 1].n_removed == 20 and out[1, 2].redacted == "none"


def test_layout(spark):
    docs = spark.createDataFrame([(1, "ab cd\n\n" + "x" * 200), (2, None)], "doc_id int, text string")
    rows = layout.paginate(docs)
    assert [len(r.row_text) for r in rows.orderBy("line").collect()] == [5, 0, 80, 80, 40]
    found = layout.words_of(layout.glyphs(rows)).where("line = 1").orderBy("word").collect()
    assert [r.text for r in found] == ["ab", "cd"]


def test_word_diff(spark):
    def diff(old, new):
        rows = [(1, side, k, w) for side, t in (("old", old), ("new", new)) for k, w in enumerate(t.split(), 1)]
        t = spark.createDataFrame(rows, "pair long, side string, pos long, word string")
        return [(r.kind, r.old_text, r.new_text) for r in compare.word_diff(t, compare.anchor_chain(compare.anchors(t))).orderBy("at").collect()]

    assert diff("a b c d", "a x d") == [("replaced", "b c", "x")]
    assert diff("le chat dort sur tapis rouge du salon principal", "le chat dort sur grand tapis rouge du salon") == [("added", "", "grand"), ("removed", "principal", "")]
    assert diff("a b", "a b") == []


def test_near_pairs_like_all_pairs(spark):
    import random

    r = random.Random(1)
    docs = [(k, [r.choice("abcdefghijkl") for _ in range(r.randint(3, 12))]) for k in range(40)]
    bags = compare.word_bags(spark.createDataFrame(docs, "doc_id long, words array<string>"))
    got = {(x.a, x.b): round(x.dice, 9) for x in compare.near_pairs(bags, 0.6).collect()}
    want = {}
    for i, a in docs:
        for j, b in docs:
            if i < j:
                d = 2 * sum(min(a.count(w), b.count(w)) for w in set(a)) / (len(a) + len(b))
                if d >= 0.6:
                    want[i, j] = round(d, 9)
    assert got == want


def test_pages(spark):
    p = spark.createDataFrame([(1, k, f"b{k}", 10 * k) for k in range(1, 6)] + [(2, 1, "z", 5)], "doc long, page long, body string, weight long")
    gone = spark.createDataFrame([(1, 2), (2, 1)], "doc long, page long")
    assert [(r.doc, r.page, r.body) for r in pages.delete(p, gone).orderBy("doc", "page").collect()] == [(1, 1, "b1"), (1, 2, "b3"), (1, 3, "b4"), (1, 4, "b5"), (2, 1, "z")]
    assert [r.part for r in pages.parts_by_size(p, 60).where("doc = 1").orderBy("page").collect()] == [1, 1, 1, 2, 3]
    n = spark.createDataFrame([(k, k % 3) for k in range(50)], "doc long, n_pages long")
    got = {r.doc: (r.first, r.last) for r in pages.number_across(n, F.col("doc"), part_rows=7).collect()}
    at = 1
    for k in range(50):
        assert got[k] == (at, at + k % 3 - 1)
        at += k % 3


def test_alignment_and_rounds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    sim = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 3, 3, 0.6)], "pair long, old_page long, new_page long, sim double")
    assert [(r.old_page, r.new_page) for r in compare.align_pages(sim, 0.5).orderBy("old_page").collect()] == [(1, 1), (3, 3)]
    assert sorted((r.old_page, r.new_page) for r in compare.mutual_best(sim).collect()) == [(1, 1), (3, 3)]


def test_trees(spark):
    marks = spark.createDataFrame([(1, k, level) for k, level in enumerate([1, 2, 3, 2, 1, 3])], "doc long, ord long, level int")
    assert [r.parent for r in trees.nested(marks, ["doc"]).orderBy("ord").collect()] == [None, 0, 1, 0, None, 4]
    replies = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, 99)], "doc long, idx long, parent long")
    assert [(r.idx, r.root, r.depth) for r in trees.threads(replies).orderBy("idx").collect()] == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 3, 0)]


def test_forms_and_rules(spark):
    f = spark.createDataFrame([(1, "a", "text", False, "x", None, []), (1, "b", "choice", False, "x", "y", ["y", "z"]), (1, "c", "text", True, "x", None, [])], 'doc long, name string, kind string, read_only boolean, value string, "default" string, options array<string>'.replace('"', "`"))
    v = spark.createDataFrame([(1, "a", "new"), (1, "b", "no such"), (1, "c", "new"), (1, "zz", "new")], "doc long, name string, new_value string")
    assert {r.name: r.value for r in forms.fill(f, v).collect()} == {"a": "new", "b": "x", "c": "x"}
    assert {r.name: r.value for r in forms.reset(f).collect()} == {"a": "", "b": "y", "c": "x"}
    i = rules.issues(spark.range(12).withColumn("doc", F.lit(1)), F.lit(True), 2, "r", "m", page=F.col("id"))
    out = rules.report(i).collect()
    assert len(out) == 9 and [r.message for r in out if r.severity == 0] == ["4 more"]


def test_threads_of_any_depth(spark):
    """A chain of 90 comments, one of which a third of the others answer, and a circle with a comment under it."""
    rows = [("a", k, k - 1 if k else None) for k in range(90)] + [("a", 100 + k, 50) for k in range(40)] + [("b", 1, 2), ("b", 2, 1), ("b", 3, 2), ("b", 4, 99)]
    replies = spark.createDataFrame(rows, "doc string, idx long, parent long")
    ensure_checkpoints(spark)
    got = {(r.doc, r.idx): (r.root, r.depth, r.path) for r in trees.threads(replies).collect()}
    assert len(got) == 131 and got["b", 4] == (4, 0, "000000004")
    assert all(got["a", k] == (0, k, "/".join(f"{i:09}" for i in range(k + 1))) for k in range(90))
    assert got["a", 139] == (0, 51, got["a", 50][2] + "/000000139")


def test_addresses_stand_alone(spark):
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(["v1.2.3.4567", "1.2.3.4.5", "at 10.0.0.1.", "x10.0.0.1", "(192.168.0.255)", "1.2.3.256", "é1.2.3.4", "1.2.3.4,5.6.7.8"])], "k long, line string")
    got = sorted((r.k, r.start, r.end, r.hit) for r in search.candidates(lines, ["k"]).where("kind = 'ipv4'").collect())
    assert got == [(2, 4, 12, "10.0.0.1"), (4, 2, 15, "192.168.0.255"), (7, 1, 8, "1.2.3.4"), (7, 9, 16, "5.6.7.8")]


def test_matches_over_line_ends(spark):
    docs = spark.createDataFrame([(1, "on the\nroad The  road, the\n\nroad the road"), (2, ""), (3, None)], "k long, text string")
    found = search.find_across_lines(docs, "the road", "k")
    assert [tuple(r) for r in found.orderBy("match").collect()] == [(1, 1, 4, 12), (1, 2, 34, 42)]
    lines = docs.select("k", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    assert [tuple(r) for r in search.pieces(found, lines, "k").orderBy("match", "line_no").collect()] == [(1, 1, 0, 4, 7), (1, 1, 1, 1, 5), (1, 2, 3, 6, 14)]


def test_addresses(spark):
    def found(*texts):
        rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "page long, line_no long, line string")
        return [r.uri for r in uris.joined(rows, ["page"], "line_no").orderBy("line_no", "k").collect()]

    assert found("Voir https://exemple.test/page.") == ["https://exemple.test/page"]
    assert found("https://exemple.test/wiki/Test_(page)", "(voir https://exemple.test/a)") == ["https://exemple.test/wiki/Test_(page)", "https://exemple.test/a"]
    assert found("WWW.Exemple.Test", "www.fr", "nowww.exemple.test", None, "", "http://.", "mailto:x") == ["https://WWW.Exemple.Test"]
    assert found("https://exemple.test/", "partie-2/index.html suite") == ["https://exemple.test/partie-2/index.html"]
    assert found("https://exemple.test/", "Introduction") == ["https://exemple.test/"]
    assert found("https://a.test/x mailto:me@b.test, http://localhost:80/y?") == ["https://a.test/x", "mailto:me@b.test", "http://localhost:80/y"]


def test_row_numbers_of_sparse_orders(spark):
    rows = [(None if k % 3 == 0 else k % 2, 7 ** (k % 17) * 1000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "key long, ord long")
    bounds = ranges.range_bounds(df, "ord", 20)
    assert len(bounds) > 5
    got = {(r.key, r.ord): r.n for r in ranges.row_numbers(df, ["key"], ["ord"], "ord", "n", bounds).collect()}
    for key in (None, 0, 1):
        for n, o in enumerate(sorted(o for k, o in rows if k == key), 1):
            assert got[key, o] == n


def test_nearest_in_blocks(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)], "vec_id long, embedding array<float>")
    marks = spark.createDataFrame([(k, [k * 1.1, 1.0]) for k in range(7)], "label int, m array<double>")
    whole, blocks = ([tuple(r) for r in nearest(rows, marks, block=b).orderBy("vec_id", "k").collect()] for b in (100, 2))
    assert whole == blocks and [r[1] for r in whole if r[2] == 1] == [0, 1, 2, 3, 4, 5]
    assert nearest(rows, marks.limit(0)).count() == 0


def test_near_links_keep_classes(spark):
    docs = [(1, "a b c d".split()), (2, "d c b a".split()), (3, "a b c d e".split()), (4, []), (5, []), (6, "a b c d".split()), (7, ["z"])]
    df = spark.createDataFrame(docs, "doc_id long, words array<string>")
    got = sorted((r.a, r.b, round(r.dice, 3)) for r in compare.near_links(df.select(F.col("doc_id").alias("doc")), compare.word_bags(df), 0.8).collect())
    assert got == [(1, 2, 1.0), (1, 3, 0.889), (1, 6, 1.0), (4, 5, 1.0)]


def test_word_diff_rebuilds_the_new_text(spark):
    import random

    r = random.Random(3)
    texts = [([r.choice("abcdef") for _ in range(r.randint(0, 14))], [r.choice("abcdef") for _ in range(r.randint(0, 14))]) for _ in range(25)]
    rows = [(p, side, k, w) for p, both in enumerate(texts) for side, t in zip(("old", "new"), both) for k, w in enumerate(t, 1)]
    t = spark.createDataFrame(rows, "pair long, side string, pos long, word string")
    changed = {}
    for x in compare.word_diff(t, compare.anchor_chain(compare.anchors(t))).collect():
        changed.setdefault(x.pair, [0, 0])
        changed[x.pair][0] += len(x.old_text.split())
        changed[x.pair][1] += len(x.new_text.split())
        assert {"added": (x.old_text == "") and x.new_text != "", "removed": (x.new_text == "") and x.old_text != "", "replaced": x.old_text != "" and x.new_text != ""}[x.kind]
    for p, (old, new) in enumerate(texts):
        gone, come = changed.get(p, (0, 0))
        # what stays is a common subsequence: as many words on either side
        assert len(old) - gone == len(new) - come >= 0

    for old, new in texts:
        pairs = compare.common_subsequence(old, new)
        assert all(old[i] == new[j] for i, j in pairs) and pairs == sorted(pairs)
        best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i in range(len(old)):
            for j in range(len(new)):
                best[i + 1][j + 1] = best[i][j] + 1 if old[i] == new[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_long_gaps_are_cut_exactly_and_in_little_memory():
    import random
    import time
    import tracemalloc

    r = random.Random(5)
    for _ in range(60):
        old, new = ([r.choice("abcdefgh") for _ in range(r.randint(0, 40))] for _ in range(2))
        whole, halved = compare.common_subsequence(old, new), compare.common_subsequence(old, new, cells=6)
        assert len(halved) == len(whole) == len(compare._by_table(old, new))
        assert halved == sorted(halved) and len({i for i, _ in halved}) == len({j for _, j in halved}) == len(halved)
        assert all(old[i] == new[j] for i, j in halved) and [j for _, j in halved] == sorted(j for _, j in halved)
    words = [f"w{int(r.paretovariate(0.7)) % 5000}" for _ in range(20_000)]
    new = [w if r.random() < 0.9 else f"w{r.randrange(5000)}" for w in words]
    r.shuffle(new[5000:6000])
    tracemalloc.start()
    began = time.time()
    kept = compare.common_subsequence(words, new)
    assert tracemalloc.get_traced_memory()[1] < 200e6 and time.time() - began < 120
    tracemalloc.stop()
    assert all(words[i] == new[j] for i, j in kept) and len(kept) >= sum(a == b for a, b in zip(words, new))


def test_page_alignment_and_moves_against_all_choices(spark):
    import itertools
    import random

    r = random.Random(2)
    sims = {p: {(a, b): r.choice([0.6, 0.7, 0.9, 1.0]) for a in range(6) for b in range(6) if r.random() < 0.3} for p in range(12)}
    rows = [(p, a, b, s) for p, x in sims.items() for (a, b), s in x.items()]
    df = spark.createDataFrame(rows, "pair long, old_page long, new_page long, sim double")
    got = {}
    for x in compare.align_pages(df, 0.5).collect():
        got.setdefault(x.pair, []).append((x.old_page, x.new_page))
    for p, x in sims.items():
        best = 0.0
        for n in range(1, 7):
            for olds in itertools.combinations(range(6), n):
                for news in itertools.combinations(range(6), n):
                    pairs = list(zip(olds, news))
                    if all(q in x for q in pairs):
                        best = max(best, sum(x[q] - 0.5 for q in pairs))
        mine = sorted(got.get(p, []))
        assert all(b[0] > a[0] and b[1] > a[1] for a, b in zip(mine, mine[1:]))
        assert abs(sum(x[q] - 0.5 for q in mine) - best) < 1e-9
    spark.sparkContext.setCheckpointDir("/tmp/spark-folioframe-tests")
    greedy = {}
    for p, x in sims.items():
        left = dict(x)
        while left:
            q = min(left, key=lambda q: (-left[q], q))
            greedy.setdefault(p, set()).add(q)
            left = {k: v for k, v in left.items() if k[0] != q[0] and k[1] != q[1]}
    found = {}
    for x in compare.mutual_best(df).collect():
        found.setdefault(x.pair, set()).add((x.old_page, x.new_page))
    assert found == greedy


def test_contents_pages_until_their_length_holds(spark):
    import math
    import random

    from folioframe.operators import pages
    from folioframe.sources.scratch import written

    r = random.Random(4)
    rows = [(f"c{c}", k, k, "t" * r.randint(1, 30), r.randint(1, 40)) for c in range(6) for k in range(r.randint(1, 60))] + [("long", k, k, "t" * 7, 1) for k in range(200)]
    got = {}
    for x in pages.combined(spark.createDataFrame(rows, "source string, ord long, file long, title string, n_pages long"), ["source"], written, 5, 10).collect():
        got[x.source, x.file] = (x.contents, x.entry_page, x.start)
    for source in {x[0] for x in rows}:
        mine = sorted(x for x in rows if x[0] == source)
        before = [sum(x[4] for x in mine[:k]) for k in range(len(mine))]
        size = 1
        for _ in range(9):
            n = [math.ceil(len(f"{x[3]} {b + size + 1}") / 10) for x, b in zip(mine, before)]
            size = math.ceil(sum(n) / 5)
        n = [math.ceil(len(f"{x[3]} {b + size + 1}") / 10) for x, b in zip(mine, before)]
        for k, x in enumerate(mine):
            assert got[source, x[2]] == (size, sum(n[:k]) // 5 + 1, before[k] + size + 1)


@pytest.mark.parametrize("n", [1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 12356630, 12356631, 2**53 + 1, 2**63 - 1, 0])
def test_alpha_of_any_length(spark, n):
    want, k = "", n
    while k > 0:
        k, r = divmod(k - 1, 26)
        want = chr(65 + r) + want
    assert one(spark, N.alpha(F.lit(n).cast("bigint"))) == want
