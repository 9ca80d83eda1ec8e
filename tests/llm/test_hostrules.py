"""Counts, priors and verdicts of host rules against plain versions."""

import random
import re

import numpy as np
import pytest

from folioframe.llm import hostrules

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, key string, host string, rejected string"


def plain_counts(text):
    t = text or ""
    ws = re.findall("[^\x20\x09-\x0d]+", t)
    seen = {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return [len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines)]


def plain_rates(docs):
    """Rates by host and rule, from the textbook's moments, document by document."""
    by = {}
    for host, c in docs:
        n, chars, symbols, dup, rep, lines = c
        fails = [n < 50, 100 * rep > 50 * n, n > 0 and not 2 * n <= chars <= 12 * n, 10 * symbols > n, 10 * dup > 3 * lines]
        if host is not None:
            by.setdefault(host, []).append(fails)
    out = {h: [] for h in by}
    for k in range(5):
        xs, ns = np.array([sum(f[k] for f in by[h]) for h in by], float), np.array([len(by[h]) for h in by], float)
        p, rho = xs.sum() / ns.sum(), 0.01
        rest = ns.sum() - (ns**2).sum() / ns.sum() - (len(ns) - 1)
        if rest > 0 and 0 < p < 1:
            rho = (((ns * (xs / ns - p) ** 2).sum() / (p * (1 - p))) - (len(ns) - 1)) / rest
        rho = min(max(rho, 1e-4), 1 - 1e-4)
        weight = (1 - rho) / rho
        for h, x, n in zip(by, xs, ns, strict=True):
            out[h].append((x + p * weight) / (n + weight))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 8))) for _ in range(n))


def odd(rng):
    return rng.choice([None, "", " \t\n\r\n", "\n\n", "a", "a a a a", "日本 語\n日本 語\n\n日本 語", "x y\nx y\r\nx y\n", "# * $ %&|<> word", "one two three one two three", "    x", "z" * 3000, "w " * 4000])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, odd(rng), None, rng.choice(["a", "b", None, ""]), 1, "k", "h", "r") for i in range(120)]
    out += [(1000 + i, prose(rng, 80), None, "hot", 1, "k", "h", "r") for i in range(150)]
    out += [(2000 + i, "cat | dog | " * 30 + prose(rng, 200), None, "bad", 1, "k", "h", "r") for i in range(30)] + [(3000, prose(rng, 60), None, "bad", 1, "k", "h", "r")]
    out += [(4000 + i, "short", None, f"once{i}", 1, "k", "h", "r") for i in range(6)] + [(7, prose(rng, 70), None, "hot", 1, "k", "h", "r")] * 4 + [(None, prose(rng, 70), None, "hot", 1, "k", "h", "r")]
    return out


def test_counts_and_verdicts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in hostrules.judge(df).collect()), key=str)
    measured = [(r[0], r[3], plain_counts(r[1])) for r in rows]
    rates = plain_rates([(h, c) for _, h, c in measured])
    want = []
    for doc_id, h, c in measured:
        base = c[0] < 50 or 100 * c[4] > 50 * c[0]
        out = h is not None and max(rates[h]) > 0.5
        want.append((doc_id, h, *c, base, out, not base and not out))
    assert got == sorted(want, key=str)
    by = {r[0]: r for r in got}
    assert by[3000][-2] and not by[3000][-1]  # a clean document of a rejected host
    assert by[1000][-1] and not any(r[-2] for r in got if r[1] == "hot")


def test_rates_of_hosts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["host"]: r for r in hostrules.hosts(hostrules.measure(df)).collect()}
    want = plain_rates([(r[3], plain_counts(r[1])) for r in rows])
    assert set(got) == set(want)
    for h, rates in want.items():
        assert [got[h][f"rate_{k}"] for k in hostrules.rules()] == pytest.approx(rates)


def test_a_single_failure_proves_little_among_like_hosts():
    xs, ns = [5, 6, 4, 5, 1], [50, 50, 50, 50, 1]
    alpha, beta = hostrules.prior(5, sum(ns), sum(n * n for n in ns), sum(xs), sum(x * x / n for x, n in zip(xs, ns, strict=True)))
    assert (1 + alpha) / (1 + alpha + beta) < 0.5
    assert (45 + alpha) / (50 + alpha + beta) > (1 + alpha) / (1 + alpha + beta)
    assert hostrules.prior(0, 0, 0, 0, 0)[0] == 0


def test_blocks_of_many_texts_and_of_one():
    rng = random.Random(9)
    texts = [odd(rng) or "" for _ in range(60)] + ["x" * 100_000 + "\n" + "y z " * 30_000]
    whole = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, whole)])
    got = hostrules.counts(np.frombuffer(b"".join(whole), np.uint8), offsets)
    assert [[int(got[c][i]) for c in hostrules.COUNTS] for i in range(len(texts))] == [plain_counts(t) for t in texts]


def test_no_documents(spark):
    assert hostrules.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hosts_of_addresses(spark):
    df = spark.createDataFrame([("https://www.Example.org/a?b",), ("http://x.example.net:80/",), ("nothing",), (None,)], "url string")
    assert [r[0] for r in df.select(hostrules.host_of(df.url)).collect()] == ["example.org", "x.example.net", None, None]
