"""Near pairs of documents: all of them, from groups and cells of any number, and a text once where its group is compared."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import compare, nearpairs


@pytest.fixture
def kept(spark):
    rows = {}

    def write(df, what):
        path = f"{tempfile.mkdtemp(prefix='spark-near-')}/{what}"
        df.write.parquet(path)
        rows[what] = spark.read.schema(df.schema).parquet(path)
        return rows[what]

    write.rows = rows
    return write


def split(t):
    return F.filter(F.split(t, r"\s"), lambda w: w != "")


def links(texts, threshold):
    bags = {}
    for d, t in texts:
        if d is not None:
            bags.setdefault(d, []).extend((t or "").split())
    first, out = {}, set()
    for d in sorted(bags):
        if (a := first.setdefault(tuple(sorted(bags[d])), d)) != d:
            out.add((a, d, 1.0))
    for a in (alone := sorted(first.values())):
        for b in alone:
            if a < b and bags[a] and bags[b]:
                x, y = ({w: bags[d].count(w) for w in bags[d]} for d in (a, b))
                dice = 2 * sum(min(n, y.get(w, 0)) for w, n in x.items()) / (len(bags[a]) + len(bags[b]))
                if dice >= threshold:
                    out.add((a, b, round(dice, 9)))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_links_of_documents_are_those_of_all_pairs(spark, monkeypatch, kept, threshold):
    rng = random.Random(7)
    some = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([1, 2, 3, 8, 20, 60]))) for _ in range(60)]
    some += [" ".join(w if rng.random() > 0.1 else "z" for w in t.split()) for t in some] + some[:10] + [None, "", " \n"]
    texts = [*enumerate(some), (5, "a second text of one id"), (6, None), (None, "a b"), (500, None), (500, "a b c")]
    docs = spark.createDataFrame(texts, "doc long, text string")
    for name, n in (("POSTINGS", 200), ("SHARDS", 2), ("BLOCK", 4), ("DOCS", 40)):
        monkeypatch.setattr(nearpairs, name, n)
    monkeypatch.setattr(nearpairs, "ROWS_SENT", 5 if threshold == 0.8 else 1_000_000)
    got = [(r.a, r.b, round(r.dice, 9)) for r in compare.near_links_of_documents(docs, split, threshold, kept).collect()]
    assert len(got) == len(set(got)) and set(got) == links(texts, threshold)


def test_a_text_is_compared_where_its_group_is(spark, kept):
    """A group of 40 documents has 780 pairs, and its texts are sent once; words that all documents share make no candidates."""
    rng = random.Random(8)
    group = [" ".join([*(f"w{k}" for k in range(100)), f"x{d}"]) for d in range(40)]
    others = [" ".join([*(f"c{rng.randrange(20)}" for _ in range(60)), *(f"y{d}-{k}" for k in range(40))]) for d in range(200)]
    docs = spark.createDataFrame(list(enumerate(group + others)), "doc int, text string")
    found = compare.near_links_of_documents(docs, split, 0.8, kept)
    assert found.count() == 780 and kept.rows["candidates"].count() == 780 and kept.rows["members"].count() == 40
