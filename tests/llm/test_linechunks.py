"""Repeated passages, in any context, against a search of all pairs of places, over edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from folioframe.llm import linechunks as lc
from folioframe.llm import shared


def cut(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    ends = [i for i in range(len(lines)) if i == len(lines) - 1 or ((h[i] * 5 + (h[i - 1] * 3 if i else 0)) >> 6) % lc.ONE_IN == 0]
    out, a = [], 0
    for e in ends:
        out.append((a + 1, e + 1, "\n".join(lines[a : e + 1])))
        a = e + 1
    return out


def weight(lines):
    return sum(max(1, len(x.split())) for x in lines)


def plain(rows):
    """Lines of every run of LONG_LINE words, and of every chunk, that an earlier place has too."""
    docs = [(i, t.split("\n")) for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None})]
    first, gone = {}, {}
    for d, (_, lines) in enumerate(docs):
        runs = {(a - 1, b) for a, b, body in cut("\n".join(lines)) if b > a or body.count(" ") + 1 >= lc.LONG_LINE}
        runs |= {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if weight(lines[a:b]) >= lc.LONG_LINE}
        for a, b in sorted(runs):
            body = "\n".join(lines[a:b])
            if not body.strip(" \n\t"):
                continue
            at, upto = first.setdefault(body, (d, b))
            if at != d or a >= upto:
                gone.setdefault(d, set()).update(range(a, b))
    of = {(i, "\n".join(x)): "\n".join(y for k, y in enumerate(x) if k not in gone.get(d, ())) for d, (i, x) in enumerate(docs)}
    return sorted(((i, of.get((i, t), t)) for i, t in rows), key=str)


def made(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_planted(spark):
    r = random.Random(11)
    planted = ["\n".join(made(r, n) for n in sizes) for sizes in ([50], [80], [25, 25], [10, 30, 12], [9, 8, 7, 9, 8, 9], [60, 4, 3], [3, 4, 60], [1] * 50, [49, 1])]
    rows = [(k, "\n".join([made(r, r.randint(1, 12)) for _ in range(r.randint(1, 4))] + [planted[k % len(planted)]] + [made(r, r.randint(1, 12)) for _ in range(r.randint(1, 4))])) for k in range(5 * len(planted))]
    out = {x.doc_id: x for x in lc.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        p = planted[k % len(planted)]
        assert out[k].text == (t if k < len(planted) else t.replace(p + "\n", ""))
        assert out[k]._n_gone == (0 if k < len(planted) else p.count("\n") + 1)


def test_against_plain(spark):
    r = random.Random(6)
    pool = [made(r, r.choice([1, 5, 20, 30, 60])) for _ in range(10)] + ["", " "]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(1, 10)))) for k in range(50)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, rows[0][1]), (103, rows[0][1]), (103, rows[1][1]), (None, rows[0][1]), (104, "x\n" * 130), (105, "y " * 20000), (106, "\n" * 200)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, first int, digest string")
    out = lc.dedup(docs)
    assert out.columns == ["doc_id", "text", "first", "digest", "_n_lines", "_n_gone"]
    assert sorted([(x.doc_id, x.text) for x in out.collect()], key=str) == plain(rows)
    assert lc.dedup(docs.limit(0)).count() == 0


def test_ids_of_several_texts_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(shared, "LEAST_HOT", 3)
    monkeypatch.setattr(shared, "SENT", 0)
    r = random.Random(9)
    hot, other = made(r, 60), made(r, 55)
    rows = [(7, f"{hot}\na b\n{other}"), (7, "\n".join(f"only {k} here" for k in range(12)))] + [(k, f"x{k}\n{hot}\ny{k}") for k in range(20, 60)]
    names = ["_id", "_chunks", "_gone", "_text", "_runs", "_maybe", "key", "rest", "body", "hash", "k", "kept", "_n_gone"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = lc.dedup(docs)
    assert out.columns == ["doc_id", "text", *names[:-1], "_n_lines", "_n_gone"]
    got = out.collect()
    assert sorted([(x.doc_id, x.text) for x in got], key=str) == plain(rows) and all(x["_id"] == "_id" and x["key"] == "key" for x in got)
    assert sum(x._n_gone for x in got) == 40


def test_shift_resistant():
    lines = [f"line {k}" for k in range(200)]
    a, b = {x[2] for x in cut("\n".join(lines))}, {x[2] for x in cut("\n".join(["new", *lines[:100], "more", *lines[100:]]))}
    assert len(a & b) >= len(a) - 4


def test_lines_of_a_long_text_cost_the_same_each(spark):
    import time

    def took(n):
        df = spark.createDataFrame([("\n".join(f"w{i * 7919 % n}" for i in range(n)),)], "text string")
        began = time.time()
        assert df.select(F.size(lc._marks(F.col("text"), lc.ONE_IN, lc.LONG_LINE))).head()[0] > n // 2
        return time.time() - began

    took(100)
    half, whole = took(25_000), took(50_000)
    assert whole < 30 and whole < 4 * half + 1  # about 2 x; a quadratic way takes minutes


def test_blank_lines_are_told_once_for_each_line(spark):
    from pyspark.sql import functions as F

    from folioframe.llm import linechunks

    texts = [" \t\n\t\n \nwords here\n", "\n\n", "a\n \n \t", ""]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    marks = df.select("text", linechunks._marks(F.col("text"), 2, 2).alias("m"))
    assert "translate" not in marks._jdf.queryExecution().analyzed().toString()
    for r in marks.collect():
        lines = r.text.split("\n")
        assert all(any(x.strip(" \t") for x in lines[(m.run >> 32) - 1 : m.run & 0xFFFFFFFF]) for m in r.m)
