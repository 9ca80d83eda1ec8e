"""Proofs of a Merkle manifest against a plain walk over lists."""

import hashlib
import random
import zlib

import pytest

from folioframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, lo long, key string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """(root, siblings of each leaf by level as (left, right))."""
    at, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        ups, below = [], []
        for i in range(0, len(digests), 3):
            run = digests[i : i + 3]
            for k in range(len(run)):
                for j in groups[i + k]:
                    at[j].append(("".join(run[:k]), "".join(run[k + 1 :])))
            ups.append(h(*run))
            below.append([j for g in groups[i : i + 3] for j in g])
        digests, groups = ups, below
    return (digests[0] if digests else None), at


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    low = {s: climb([leaf(r) for r in by[s]]) for s in sources}
    root, upper = climb([low[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper, strict=True):
        for r, own in zip(by[s], low[s][1], strict=True):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                changed = (r[0], r[1].replace("\n", ""), *r[2:])
            got = leaf(changed)
            for a, b in own + above:
                got = h(a, got, b)
            out.append((r[0], leaf(r), low[s][0], root, h(*(a + b for a, b in own + above)), got, got == root))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7, None) for r in rows], SCHEMA)  # further columns have the operator's own names
    return sorted((tuple(r) for r in merkle.verify(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_nulls_ties_and_hot_sources(spark):
    rng = random.Random(5)
    rows = [(i, f"text {i}\nmore", "en", "hot", i) for i in range(40)]
    rows += [(rng.randrange(100), rng.choice([None, "", "a\nb", "\n", "é\n日本\n" * 3]), rng.choice([None, "fr"]), rng.choice([None, "", "a", "é", "Z", "b\n"]), rng.choice([None, 5])) for _ in range(60)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "same\n", "en", "a", 5)] * 4 + [(9, "alone\nhere", "en", "one", 1)] + [(2, "x" * 300_000 + "\ny", "en", "long", 2)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [1, 10])
def test_runs_of_every_shape(spark, n):
    rows = [(i, f"t{i}\n", "en", "s", i) for i in range(n)]
    assert got(spark, rows) == plain(rows)


def test_an_empty_table_has_no_proofs(spark):
    assert got(spark, []) == []


def test_paths_fold_to_the_root_and_show_changes(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 4}", i) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = merkle.proofs(df).collect()
    for r in rows:
        at = r.leaf
        for step in r.path:
            at = h(step.l, at, step.r)
        assert at == r.root
    assert len({r.root for r in rows}) == 1 and len({r.subroot for r in rows}) == 4
    other = merkle.proofs(df.replace({"t7": "t_"}, subset=["text"])).collect()
    assert other[0].root != rows[0].root
