"""Base spans against the patterns themselves; disclosing terms against a count by hand."""

import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import pii
from folioframe.llm.shared import Tables

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    def luhn(d):
        odd = [int(x) for x in reversed(d)]
        return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(odd)) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text("ab.@-+é_%1 2\n", max_size=60) | st.text("0123456789.- +(", max_size=80) | st.text("@a.b-c", max_size=30))
def test_base_spans(t):
    assert pii.base_spans(t) == plain(t)


def test_known():
    t = "é x@y.co.uk, 4111 1111-1111 1111; 10.0.0.255 1.2.3.256 +49 (0)30 123456"
    assert [k for k, _, _ in pii.base_spans(t)] == ["email", "ip", "card", "phone"]
    assert pii.base_spans("9" * 50_000) == [] and pii.base_spans("a" * 50_000 + "@") == []


def counted(rows, context=64):
    """PMI by counts over all contexts: {(entity, term): (n_entity, n_both, n_term, share)} with support."""
    seen = []
    for t in rows:
        spans = plain(t or "")
        for m in re.finditer(r"(?m)^[^\n]*$", t or "") if t is not None else [re.match("", "")]:
            inside = [(a, b, f"{k}:{(t or '')[a:b].lower()}") for k, a, b in spans if m.start() <= a < max(m.end(), m.start() + 1)]
            words = [(x.start() + m.start(), x.group().lower()) for x in re.finditer(r"[^\W\d_]{2,}", m.group())]
            words = [(a, w) for a, w in words if not any(p < a + len(w) and a < q for p, q, _ in inside)]
            runs = max(1, -(-len(words) // context))
            parts = [(words[k * context : (k + 1) * context], set()) for k in range(runs)]
            for a, _, e in inside:
                parts[max(0, -(-sum(x < a for x, _ in words) // context) - 1)][1].add(e)
            seen += [({w for _, w in p}, e, " ".join(dict.fromkeys(w for _, w in p))) for p, e in parts]
    out, n = {}, len(seen)
    for e in {e for _, of, _ in seen for e in of}:
        has = [(w, said) for w, of, said in seen if e in of]
        for t in {t for w, _ in has for t in w}:
            both = [said for w, said in has if t in w]
            n_term = sum(t in w for w, _, _ in seen)
            if len(set(both)) >= 3 and n > len(has):
                out[e, t] = (len(has), len(both), n_term, math.log(len(both) * n / len(has) / n_term) / math.log(n / len(has)))
    return out


def world():
    common = [f"the of and line {k}\nthe second of {k}" for k in range(40)]
    names = ["amber", "basil", "cedar", "delta", "ember", "fable"]
    told = [f"the quillon {w} wrote to kim@corp.example of {w}s" for w in names]
    many = ["start\n" + "\n".join(f"zorbat {w} calls +49 30 1234567 about {w}" for w in names) + "\nend"]
    long = [" ".join(f"word{chr(97 + k % 26)}" for k in range(100)) + " 10.1.2.3 " + " ".join(f"tail{chr(97 + k % 26)}" for k in range(90))]
    return [*common, *told, None, "", told[0], "quillo n", "Only QUILLON here, and Zorbat.", *many, *long, *long]


def test_shares_against_counts(spark):
    rows = world()
    docs = spark.createDataFrame([(7, t) for t in rows], "doc_id long, text string")
    with Tables() as own:
        got = {(r.entity, r.term): (r.n_entity, r.n_both, r.n_term, r.share) for r in pii.disclosures(docs, own, generalise=-9.0).collect()}
    want = counted(rows)
    assert got.keys() == want.keys() and all(got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-9 for k in want)
    assert got["email:kim@corp.example", "quillon"][:3] == (7, 7, 8) and got["phone:+49 30 1234567", "zorbat"][:3] == (6, 6, 7)


def test_disclosure(spark, monkeypatch):
    common, rows = world()[:40], world()
    told = rows[40:46]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], "doc_id long, text string, base string, marks string")
    out = {r.doc_id: r for r in pii.digest(pii.spans(docs)).collect()}
    assert len(out) == len(rows)
    r = out[len(common)]
    a = told[0].index("kim@")
    assert r.n_email == 1 and r.base_sha256 == hashlib.sha256(f"email:{a}:{a + 16}".encode()).hexdigest()
    assert "term:4:11" in r.spans and "term:0:3" not in r.spans
    assert out[0].spans == "" and out[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    elsewhere = rows.index("Only QUILLON here, and Zorbat.")
    assert out[elsewhere].spans == "term:5:12,term:23:29"
    monkeypatch.setattr(pii, "SENT_TERMS", 1)
    assert {r.doc_id: r for r in pii.digest(pii.spans(docs)).collect()} == out
    monkeypatch.undo()
    twice = spark.createDataFrame([(1, told[0], "x"), (1, told[1], "y"), (None, told[0], "z"), (1, told[0], "x")] + [(k, t, "w") for k, t in enumerate(rows, 100)], "doc_id long, text string, marks string")
    got = pii.sanitise(twice)
    assert got.columns == twice.columns and got.count() == len(rows) + 4 and got.where("marks = 'z' AND text NOT LIKE '%quillon%' AND text LIKE '%[EMAIL]%'").count() == 1
    clean = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert "kim@" not in clean[len(common)] and "quillon" not in clean[len(common)] and "[EMAIL]" in clean[len(common)]
    assert clean[0] == common[0] and clean[len(common) + len(told)] is None
    assert pii.digest(pii.spans(docs.limit(0))).count() == 0
