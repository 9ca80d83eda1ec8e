"""Held-out accuracy of the positive-unlabelled model, and edge cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from folioframe.llm import quality


def rows(seed=1, n=400):
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(2, 9)))
    out = []
    for i in range(n):
        w = [word() for _ in range(r.integers(5, 80))]
        good = r.random() < 0.8
        out.append((i, " ".join(w).capitalize() + "." if good else r.choice(["### ", " | "]).join(x.upper() + "!!" for x in w), int(good)))
    return out


def test_held_out(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9000, None), (9001, ""), (9002, "x " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 2], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 3 != 1)
    assert 0.6 < model.prior < 0.95
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == len(data) + 3 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in data if i % 3 == 1]
    assert sum(held) >= 0.97 * len(held)
    kept = quality.keep(docs.withColumn("score", F.lit("x")), model)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5} and kept.columns == ["doc_id", "text", "score"]


def test_prior_of_a_mixture():
    """Estimated within 0.05 of the share that was mixed in, without a negative label."""
    r = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        n = int(1000 * share)
        shape = lambda k, m: r.normal(m, 1, (k, quality.N_FEATURES)).astype(np.float32)
        p, u = shape(800, 0.1), np.concatenate([shape(n, 0.1), shape(1000 - n, -0.1)])
        assert abs(quality.prior_of(p, r.permutation(u)) - share) < 0.05
    assert quality.prior_of(p[:0], u) == 0.5
    assert quality.fit(p[:0], u, 0.5).score(u[:3]).tolist() == [0.5] * 3


def test_risk_against_plain_sums():
    """Risk and gradient against sums row by row and differences, with the bracket above and below zero."""
    r = np.random.default_rng(1)
    loss = lambda z: math.log1p(math.exp(-z))

    def plain(w, p, u, prior):
        z = lambda x: sum(float(a) * float(b) for a, b in zip(x, w))
        mean = lambda some: sum(some) / len(some)
        return prior * mean([loss(z(x)) for x in p]), mean([loss(-z(x)) for x in u]) - prior * mean([loss(-z(x)) for x in p])

    seen = set()
    for shift in (0.0, 3.0):
        p, u, w = r.normal(size=(6, 4)) + shift, r.normal(size=(9, 4)), r.normal(size=4) + shift / 2
        got = quality.risk(w, p, u, 0.7)
        assert np.allclose(got[:2], plain(w, p, u, 0.7))
        seen.add(got[1] >= 0)
        for k in range(4):
            step = np.eye(4)[k] * 1e-5
            up, down = plain(w + step, p, u, 0.7), plain(w - step, p, u, 0.7)
            assert np.allclose([(up[0] - down[0]) / 2e-5, (up[1] - down[1]) / 2e-5], [got[2][k], got[3][k]], atol=1e-6)
    assert seen == {True, False}


def test_words_tell_texts_of_one_shape_apart():
    r = np.random.default_rng(2)
    good, bad = [f"g{chr(97 + k % 26)}o{chr(97 + k // 26)}" for k in range(60)], [f"b{chr(97 + k % 26)}o{chr(97 + k // 26)}" for k in range(60)]
    text = lambda words: " ".join(r.choice(words, 40)).encode()
    table = lambda some: quality.features(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]))
    p, u = table([text(good) for _ in range(200)]), table([text(good) for _ in range(200)] + [text(bad) for _ in range(200)])
    model = quality.fit(p, u, quality.prior_of(p, u))
    assert abs(model.prior - 0.5) < 0.1
    assert (model.score(table([text(good) for _ in range(50)])) >= 0.5).mean() > 0.95 and (model.score(table([text(bad) for _ in range(50)])) < 0.5).mean() > 0.95


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality.score(docs, model).count() == 0
