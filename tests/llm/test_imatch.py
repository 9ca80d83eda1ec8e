"""Fingerprints over edge cases, and the next document across ranges of ids."""

import hashlib
import random

from folioframe.llm import imatch


def test_edges(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choice(words) for _ in range(120))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, rows[3][1]), (53, rows[3][1]), (60, "!?"), (61, "Ünï " * 20000), (None, "none")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    got = {x.doc_id: x for x in imatch.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 4
        assert got[i].edited == t[: len(t) - k] + u[:k] and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[52].fingerprint == got[53].fingerprint == got[3].fingerprint and got[52].near_next == 1.0
    assert got[50].near_next == 1.0 and got[51].near_next == 0.0
    far = [got[k] for k in range(40)]
    assert sum(x.near_edited for x in far) / 40 > 0.4 > 0.2 > sum(x.near_next for x in far) / 40
    assert imatch.fingerprints(docs.limit(0)).count() == 0


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 3)
    monkeypatch.setattr(imatch, "STRIDE", 4)
    ids = random.Random(1).sample(range(-500, 10_000), 200)
    docs = spark.createDataFrame([(i, f"{i} " * 4) for i in ids], "doc_id long, text string")
    order = sorted(ids)
    for x in imatch.fingerprints(docs).collect():
        u = f"{order[(order.index(x.doc_id) + 1) % 200]} " * 4
        t = f"{x.doc_id} " * 4
        assert x.edited == t[: len(t) - len(t) // 4] + u[: len(t) // 4]
