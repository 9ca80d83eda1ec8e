"""Components against all pairs by brute force, over copies, near copies, ties and edge cases."""

import random

import numpy as np

from folioframe.llm import shared, sigtree


def plain(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def rows():
    r = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocab) for _ in range(30)]
    out = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([4, 6, 20, 80, 200]))]
        if r.random() < 0.5:
            base[3:3] = passage
        for _ in range(r.randint(1, 8)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 30))):
                t[r.randrange(len(t))] = r.choice(vocab)
            out.append(" ".join(t))
    out += [out[0], out[0].upper(), None, "", " \n", "a b", "A  b", "a b c", "passage " * 3000]
    r.shuffle(out)
    return list(enumerate(out))


def test_against_all_pairs(spark, monkeypatch):
    data = rows()
    docs = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, key string")
    want = plain(data)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in sigtree.join(docs).collect()}
    assert got == want
    monkeypatch.setattr(sigtree, "TILE", 3)
    monkeypatch.setattr(sigtree, "SAMPLE_OFTEN", 10**9)
    monkeypatch.setattr(shared, "SENT", 0)
    monkeypatch.setattr(shared, "LEAST_HOT", 2)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in sigtree.join(docs).collect()}
    assert got == want


def test_empty_and_null_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")
    assert [tuple(x) for x in sigtree.join(docs).collect()] == [(None, 2, None)]
    assert sigtree.join(docs.limit(0)).count() == 0


def test_trees_lose_no_pair():
    r = np.random.default_rng(4)
    pool = r.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = []
    for _ in range(60):
        base = r.choice(pool, r.integers(5, 300), replace=False)
        sets += [np.unique(np.where(r.random(len(base)) < 0.05, r.choice(pool, len(base)), base)) for _ in range(4)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    bits, heap = zip(*(sigtree.signature(s) for s in sets))
    found = sigtree.near_leaves(np.zeros(len(n), int), n, list(bits), np.array(heap), 80)
    left = {(min(x, y), max(x, y)) for a, b in found for x, y in zip(a.tolist(), b.tolist())}
    all_pairs = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert all_pairs <= left and len(left) < 2 * len(all_pairs)


def test_ids_of_several_texts(spark):
    one, two = "a b c d e f g h", "z y x w v u t s"
    docs = spark.createDataFrame([(7, one), (7, two), (7, two), (3, two), (9, one), (5, None), (5, "q r s t u v")], "doc_id long, text string")
    got = sorted(tuple(x) for x in sigtree.join(docs).collect())
    assert got == [(3, 4, 3), (5, 0, 5), (5, 2, 5), (7, 4, 3), (7, 4, 3), (7, 4, 7), (9, 4, 7)]
    docs = spark.createDataFrame([(7, one), (7, two)], "doc_id long, text string")
    assert sorted(tuple(x) for x in sigtree.join(docs).collect()) == [(7, 4, 7)] * 2


def test_large_group_gives_few_rows(spark, monkeypatch):
    """Near copies of one text: clusters and links grow with the sets, not with their pairs, even without stars."""
    r = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(300):
        t = list(base)
        t[r.randrange(5)] = f"x{k}"
        t[59 - r.randrange(3)] = f"y{k}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain(list(enumerate(texts)))
    monkeypatch.setattr(sigtree, "plausible", lambda pairs, heads, percent: pairs.limit(0))
    made = {}

    def counted(name, was):
        def run(df, percent):
            out = was(df, percent)
            made[name] = out.count()
            return out

        return run

    for name in ("clusters", "spanning_links"):
        monkeypatch.setattr(sigtree, name, counted(name, getattr(sigtree, name)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in sigtree.join(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < 80
    prefix = 56 - 45 + 1
    assert made["clusters"] <= 300 * prefix and made["spanning_links"] <= 300 * prefix


def test_one_of_each_component_stays(spark):
    one, two, near = "a b c d e f g h i j k l m n o p", "z y x w v u t s", "A b c d e f g h i j k l m n o p q"
    rows = [(7, one), (7, two), (7, two), (3, two), (9, near), (None, one), (None, one), (5, one + " r"), (5, near), (1, None), (1, ""), (8, "p q"), (8, "q p")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, text_hash string, component_id string")
    left = sigtree.distinct(docs)
    assert left.columns == docs.columns
    got = sorted(((x.doc_id, x.text) for x in left.collect()), key=str)
    assert sum(x[0] == 5 for x in got) == 1
    assert [x for x in got if x[0] != 5] == sorted([(3, two), (None, one), (None, one), (1, None), (1, ""), (8, "p q"), (8, "q p")], key=str)
