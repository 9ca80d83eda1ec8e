"""Held-out accuracy, marginals against plain forward-backward, and edge cases."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from folioframe.llm import crf

WORDS = {"en": ["the", "house", "thing", "which", "other"], "fr": ["été", "maison", "queue", "leçon", "eaux"], "de": ["schön", "haus", "keit", "über", "nicht"]}


def texts(n, seed):
    r = np.random.default_rng(seed)
    return [(lang, " ".join(r.choice(w) + r.choice(["", "s", "e"]) for _ in range(r.integers(3, 60)))) for lang, w in WORDS.items() for _ in range(n)]


def test_marginals():
    m = crf.train([(t, y) for y, t in texts(20, 1)], rounds=10)
    k = len(m.labels)
    scores = np.random.default_rng(0).normal(size=(230, k)).astype(np.float32)
    first = np.array([0, 0, 3, 3, 100, 101, 230])
    got = m.marginals(scores, first)
    move, start = m.weights[3].astype(float), m.weights[4][0].astype(float)
    for a, b in zip(first, first[1:], strict=False):
        s = scores[a:b].astype(float)
        if not len(s):
            continue
        f, g = [start + s[0]], [np.zeros(k)]
        for t in range(1, len(s)):
            f.append(s[t] + np.logaddexp.reduce(f[-1][:, None] + move, axis=0))
            g.append(np.logaddexp.reduce(move + s[len(s) - t] + g[-1], axis=1))
        want = np.array(f) + np.array(g[::-1])
        want = np.exp(want - np.logaddexp.reduce(want, axis=1)[:, None])
        assert np.abs(got[a:b] - want).max() < 1e-4


def test_pairs_against_enumeration():
    """Joint marginals of neighbours, and the gradient of the log-likelihood in the transitions by differences."""
    r = np.random.default_rng(3)
    m = crf.Model(["a", "b", "c"], np.zeros(0, np.uint64))
    m.weights[3][:], m.weights[4][:] = r.normal(size=(3, 3)) * 2, r.normal(size=(1, 3))
    scores, first, n = r.normal(size=(7, 3)).astype(np.float32) * 2, np.array([0, 5, 7]), 7

    def value(ys, move):
        out = 0.0
        for a, b in zip(first, first[1:], strict=False):
            out += float(m.weights[4][0][ys[a]]) + sum(float(scores[t][ys[t]]) for t in range(a, b)) + sum(move[ys[t], ys[t + 1]] for t in range(a, b - 1))
        return out

    move = m.weights[3].astype(float)
    every = list(itertools.product(range(3), repeat=n))
    log_z = lambda w: np.logaddexp.reduce([value(ys, w) for ys in every])
    linked = np.array([True, True, True, True, False, True])
    want, total = np.zeros((5, 3, 3)), log_z(move)
    for ys in every:
        for k, t in enumerate(np.flatnonzero(linked)):
            want[k, ys[t], ys[t + 1]] += np.exp(value(ys, move) - total)
    got = m.pairs(*m.messages(scores, first), linked)
    assert np.abs(got - want).max() < 1e-4
    for a, b in ((0, 1), (2, 2)):
        step = np.zeros((3, 3))
        step[a, b] = 1e-4
        assert abs((log_z(move + step) - log_z(move - step)) / 2e-4 - got.sum(0)[a, b]) < 1e-3


def test_training_sample_is_bounded(spark):
    rows = [(k, "long " * 5000 + "x" * 1000, "en") for k in range(5)] + [(None, "same text", "fr")] * 40 + [(k, f"autre texte {k}", "fr") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = crf.sample(docs, "text", "lang", F.col("doc_id"), 10)
    assert got and all(len(p.split()) <= crf.PIECE and max(map(len, p.split() or [""])) <= crf.WORD_BYTES for p, _ in got)
    assert sum(y == "en" for _, y in got) == 5 * crf.PIECES and 5 <= sum(y == "fr" for _, y in got) <= 10
    assert sorted(got) == sorted(crf.sample(docs.repartition(3), "text", "lang", F.col("doc_id"), 10))


def test_ties(spark):
    model = crf.Model(["da", "no"], np.zeros(0, np.uint64))
    docs = spark.createDataFrame([(1, "hus"), (1, "hus")], "doc_id long, text string")
    assert [(x.lang_pred, x.score) for x in crf.label_words(docs, model).collect()] == [("da", 0.5)] * 2


def test_languages_and_switches(spark):
    train, test = texts(30, 2), texts(10, 3)
    mixed = " ".join(["the house which other thing"] * 5 + ["été maison leçon eaux queue"] * 5)
    rows = [(k, t, y, True) for k, (y, t) in enumerate(train)] + [(1000 + k, t, y, False) for k, (y, t) in enumerate(test)]
    rows += [(2000, None, "en", False), (2001, "", None, True), (2002, "12 — …!", "en", False), (2003, mixed, None, False), (2004, "house " * 50_000, None, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score boolean")
    got = {r.doc_id: r for r in crf.identify(docs, F.col("score")).collect()}
    assert len(got) == len(rows)
    right = sum(got[i].lang_pred == y for i, _, y, t in rows if 1000 <= i < 2000)
    assert right >= 0.95 * len(test)
    assert [(got[i].lang_pred, got[i].score) for i in (2000, 2001, 2002)] == [("und", 0.0)] * 3
    assert {x.lang for x in got[2003].runs} == {"en", "fr"} and got[2004].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in crf.identify(docs, F.lit(True)).collect()] == [("und", 0.0)]
    assert crf.identify(docs.limit(0), F.lit(True)).count() == 0
