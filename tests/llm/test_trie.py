"""The prefix trie of conversations against a plain version, and its double arrays against dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from folioframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, d string, n long, base string"


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role, text), len(text or "")))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]  # the remainder has the sign of c, as in SQL
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(t[0] for t in turns[:d]), []).append(c)
    lens = {tuple(t[0] for t in turns[:d]): turns[d - 1][1] if d else 0 for turns in whole.values() for d in range(len(turns) + 1)}
    children = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(members) - 1) * lens[k]
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "d", 2, "b") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.nodes(df, **how).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for c in [*range(0, 40), *range(100, 130), 205, 207, 350, 10_000_000_000]:  # 200 and 300 are absent
        for t in range(rng.choice([1, 2, 3, 4, 7, 9])):
            out.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ééé"])))
    out += [(c, t, "user", f"same {t}") for c in range(400, 440) for t in range(8)]  # copies
    out += [(c, t, "user", f"same {t}" if t < 7 else f"own {c}") for c in range(500, 530) for t in range(8)]  # a hot beginning
    out += [(c, t, "user", "x" * (t % 5)) for c in (600, 601, 777) for t in range(60 + c % 3)]  # longer than many segments
    out += [(None, 1, "user", "nobody's"), (600, 5, "user", "again"), (600, 5, "user", "again"), (-5, 0, "user", "below"), (-105, 1, None, None)]
    return out


@pytest.mark.parametrize("how", [{}, {"segment": 3, "shard": 5}])
def test_nodes(spark, rows, how):
    assert got(spark, rows, **how) == plain(rows)


def test_an_empty_table_and_one_without_turns(spark):
    assert got(spark, []) == []
    few = [(107, 1, "user", "taken over by none")]
    assert got(spark, few) == plain(few)


def test_double_arrays_hold_what_was_packed():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 50 if k % 3 else 4, rng.integers(0, 9)).tolist() for k in range(3000)] + [[k] for k in range(50)]
    roots = rng.integers(0, 3, len(sequences))
    offsets = np.cumsum([0, *map(len, sequences)])
    out = trie.pack(roots, 3, offsets, np.concatenate([np.array(s, np.int64) for s in sequences]), 50)
    states = {}
    for r, s in zip(roots, sequences, strict=True):
        at = int(r)
        for d, code in enumerate(s):
            at = int(out.step(np.array([at]), np.array([code]))[0])
            assert at >= 3
            assert states.setdefault((int(r), *s[: d + 1]), at) == at
    assert len(set(states.values())) == len(states)  # no two nodes share a place
    assert out.taken.sum() == len(states) + 3
    missing = [(r, c) for r in range(3) for c in range(50) if (r, c) not in states]
    assert all(int(out.step(np.array([r]), np.array([c]))[0]) == -1 for r, c in missing)
    assert len(out.base) < 8 * (len(states) + 50)
