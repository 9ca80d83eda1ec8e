"""Wu-Manber search against a plain search of every window."""

import hashlib
import random
import re

import numpy as np

from folioframe.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text, items):
    w, hit, got = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        m = min(10, len(iw))
        windows = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)} if m else set()
        for k in range(len(w) - m + 1 if m else 0):
            if tuple(w[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                got.add(str(i))
    return len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items, **how):
    left = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, spans string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in d.summary(d.hits(left, right, **how)).collect()}
    assert got == {i: plain(t, items) for i, t in enumerate(docs)}


def test_against_plain(spark):
    r = random.Random(3)
    vocab = ["a", "the", "Über", "x1", "of", "Zoë", "ab", "THE", "né"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 9, 10, 11, 30])))) for k in range(30)] + [(50, None), (51, "...")]
    docs = [None, "", "!!", "the"]
    for _ in range(60):
        t = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            x = words(r.choice(items)[1])
            at = r.randint(0, len(t))
            t[at:at] = x[r.randint(0, 3) :]
        docs.append(r.choice([" ", "-", "\n "]).join(t))
    docs += [docs[-1], " ".join(["filler"] * 5000 + words(items[7][1]) + ["z"] * 3000)]
    check(spark, docs, [x for x in items if len(words(x[1])) >= 10] or items)
    check(spark, docs, items)
    check(spark, docs, items, shard_words=60)


def test_empty(spark):
    check(spark, ["a b", None], [(1, None)])
    assert d.hits(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_rows_beyond_one_shard(spark):
    """Repeated rows, ids of several texts and null ids come out as they went in, in one pass and in many."""
    items = [(k, " ".join(f"i{k}w{n}" for n in range(12))) for k in range(3)]
    texts = ["a b " + items[0][1], items[1][1] + " c", "nothing here at all"]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[0]), (None, texts[1]), (None, texts[2]), (3, None), (3, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "r", "s") for i, t in rows], "doc_id long, text string, `row` string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *plain(t, items)) for i, t in rows), key=str)
    for words in (1, 10**6):
        assert sorted((tuple(x) for x in d.summary(d.hits(docs, bench, shard_words=words)).collect()), key=str) == want
        left = d.without(docs, bench, shard_words=words)
        assert left.columns == docs.columns
        assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == sorted(((i, t) for i, t in rows if not plain(t, items)[4]), key=str)


def test_buckets_are_compared():
    """Patterns that share their first and last words, and so their bucket, are told apart by their bytes."""
    items = [b"a b c d e f", b"a b x d e f", b"a b c d e f"]
    p = d.item_patterns(items, 6)[0]
    assert len(p.suffixes) == 1 and len(np.unique(p.pairs)) == 1
    assert p.equal(0, 3, items[0]) == [0, 2] and p.equal(0, 3, b"a b y d e f") == []
