"""Personal data by pattern, and terms that reveal it by corpus co-occurrence.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers. What they find are the
protected entities. Co-occurrence is counted over contexts: lines, of which those of more than ``CONTEXT`` terms are cut
into runs of so many. The information content of an entity e is IC(e) = -log p(e) over the contexts of the corpus; a
term t tells PMI(e; t) = log p(e, t) / (p(e) p(t)) of that. Where PMI(e; t) / IC(e) reaches a threshold, t discloses e:
from ``generalise`` on, t is replaced by a class mark, from ``remove`` on it goes, wherever it stands in any text. A
term must stand beside e in ``support`` contexts of different words, so that copies of one passage prove nothing.

Counts of terms, entities and pairs are all numbers of contexts over all documents, of terms cut in the same way;
each is combined in the tasks before the shuffle. Letters inside a base span belong to no term. Rows: null texts are
empty and have no spans; repeated rows and ids, empty tables and texts of any length are handled alike. Positions are
code points, ends exclusive. Only the id and text columns are read, so further columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import Tables, blocks, join_counted, sized, stash

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits, as it would have begun with the run; so the test before it changes nothing.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{2,}")
#: Terms of a context at most.
CONTEXT = 64
#: As many disclosing terms are sent to every task at most; beyond that they are joined by shuffle.
SENT_TERMS = 200_000


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: time in proportion to the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))] if "." in text else []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms outside all base spans, in order."""
    taken = sorted((a, b) for _, a, b in spans)
    k, reach = 0, 0
    for m in TERM.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= a:
            yield m.group().lower(), a, b


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[list[str], list[str]]]:
    """(terms, entities) of each context of a text, distinct and in order."""
    found = [(a, f"{kind}:{text[a:b].lower()}") for kind, a, b in spans]
    found = sorted(found + [(a, t) for t, a, _ in terms_of(text, spans)] if found else [(a, t) for t, a, _ in terms_of(text, spans)])
    out, i, begin = [], 0, 0
    while begin <= len(text):
        end = text.find("\n", begin)
        end = len(text) if end < 0 else end
        terms, entities, n = {}, {}, 0
        while i < len(found) and found[i][0] <= end:
            said = found[i][1]
            if ":" in said:
                entities[said] = None
            else:
                if n == CONTEXT:
                    out.append((list(terms), list(entities)))
                    terms, entities, n = {}, {}, 0
                terms[said], n = None, n + 1
            i += 1
        out.append((list(terms), list(entities)))
        begin = end + 1
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
TERM_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for i, j, _, _ in blocks(batch.column("text")):
            part = batch.slice(i, j - i)
            yield part, [x or "" for x in part.column("text").to_pylist()]


def beside(texts: DataFrame) -> DataFrame:
    """(entity, words, terms) for each context and entity of texts (text); words is a hash of the context's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _texts(batches):
            entities, words, terms = [], [], []
            for x in some:
                spans = base_spans(x)
                for t, of in contexts(x, spans) if spans else []:
                    if of:
                        h = int.from_bytes(blake2b(" ".join(t).encode(), digest_size=8).digest(), "little", signed=True)
                        entities += of
                        words += [h] * len(of)
                        terms += [t] * len(of)
            yield pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), pa.array(words, pa.int64()), pa.array(terms, pa.list_(pa.string()))], ["entity", "words", "terms"])

    return texts.mapInArrow(run, "entity string, words bigint, terms array<string>")


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n): contexts of each term, summed in the tasks; the null term counts all contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _texts(batches):
            n: Counter[str | None] = Counter()
            for x in some:
                for terms, _ in contexts(x, base_spans(x)):
                    n[None] += 1
                    n.update(terms)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    return texts.mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _listed(terms: DataFrame) -> list | None:
    """The rows of ``terms`` if they are few enough to be sent to every task."""
    got = terms.limit(SENT_TERMS + 1).collect()
    return got if len(got) <= SENT_TERMS else None


def disclosures(docs: DataFrame, own: Tables, text: str = "text", generalise: float = 0.8, remove: float = 0.95, support: int = 3) -> DataFrame:
    """(entity, term, n_entity, n_both, n_term, share, action): terms whose PMI reaches ``generalise`` of the entity's information."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    near = own.stash(beside(texts), "pii-contexts")
    entities = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.count_distinct("words").alias("n_words"))
    apart = near.join(sized(entities.where(F.col("n_words") >= support).select("entity")), "entity").select("entity", "words", F.explode("terms").alias("term"))
    same = apart.groupBy("entity", "term", "words").agg(F.count(F.lit(1)).alias("n"))
    pairs = own.stash(same.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_words")).where(F.col("n_words") >= support).drop("n_words"), "pii-pairs")
    counts = own.stash(term_counts(texts), "pii-counts")
    n = counts.where("term IS NULL").select(F.col("n").alias("n_contexts"))
    share = F.log(F.col("n_both") * F.col("n_contexts") / (F.col("n_entity") * F.col("n_term"))) / F.log(F.col("n_contexts") / F.col("n_entity"))
    return (
        pairs.join(entities.drop("n_words"), "entity")
        .join(counts.select("term", F.col("n").alias("n_term")), "term")
        .join(F.broadcast(n))  # one row
        .where(F.col("n_contexts") > F.col("n_entity"))
        .select("entity", "term", "n_entity", "n_both", "n_term", share.alias("share"))
        .where(F.col("share") >= generalise)
        .withColumn("action", F.when(F.col("share") >= remove, "remove").otherwise("generalise"))
    )


_FOUND = "base array<struct<kind:string,start:bigint,end:bigint>>, terms array<struct<kind:string,start:bigint,end:bigint,action:string>>"


def _marked(rows: DataFrame, actions: dict[str, str], schema: str) -> DataFrame:
    """The columns of ``rows`` but text, base spans, and the spans of the terms that ``actions`` lists."""
    sent = rows.sparkSession.sparkContext.broadcast(actions)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in _texts(batches):
            base, terms = [], []
            for x in some:
                spans = base_spans(x)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                terms.append([{"kind": "term", "start": a, "end": b, "action": sent.value[t]} for t, a, b in terms_of(x, spans) if t in sent.value] if sent.value else [])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(base, pa.list_(SPAN)), pa.array(terms, pa.list_(TERM_SPAN))], [*kept, "base", "terms"])

    return rows.mapInArrow(run, schema)


def occurrences(numbered: DataFrame) -> DataFrame:
    """(row, term, start, end) of all terms of texts (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in _texts(batches):
            for row, x in zip(part.column("row").to_pylist(), some, strict=True):
                found = list(terms_of(x, base_spans(x)))
                term, start, end = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(term, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["row", "term", "start", "end"])

    return numbered.mapInArrow(run, "row bigint, term string, start bigint, end bigint")


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **thresholds) -> DataFrame:
    """(doc_id, base, terms): base spans, and spans <kind, start, end, action> of the terms that disclose an entity.

    Every occurrence of such a term is marked, also in texts that don't name the entity.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Tables() as own:
        telling = disclosures(docs, own, text, **thresholds).groupBy("term").agg(F.max("action").alias("action"), F.max("n_term").alias("k"))  # remove > generalise
        telling = own.stash(telling, "pii-terms")
        listed = _listed(telling)
        if listed is not None:
            return _marked(rows, {r["term"]: r["action"] for r in listed}, f"doc_id {kind}, {_FOUND}")
        # too many to be sent: the terms of all texts meet them in a join, by the number of their row
        numbered = own.keep(rows.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
        hit = join_counted(occurrences(numbered.select("row", "text")), telling, ["term"], F.col("row"))
        marks = own.keep(hit.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", "action"))).alias("hits")), "pii-hits")
    base = _marked(numbered.select("doc_id", "row", "text"), {}, f"doc_id {kind}, row bigint, {_FOUND}")
    return base.join(marks, "row", "left").select("doc_id", "base", F.coalesce("hits", "terms").alias("terms"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what ``spans`` gives."""
    said = lambda column: F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = said(F.col("base"))
    terms = F.coalesce(F.array_distinct(said(F.col("terms"))), F.array().cast("array<string>"))
    of = lambda kind: lambda s: s["kind"] == kind
    counted = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counted, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """``docs`` with personal data replaced by its kind, disclosing terms generalised to [TERM] or removed.

    Each row is treated by its own text, whatever the ids; it is numbered and written once for that.
    """
    rows = stash(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("of"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "pii-docs")
    found = spans(rows, "text", "row", **thresholds).where("size(base) + size(terms) > 0")
    marks = found.select(
        F.col("doc_id").alias("row"),
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by"))),
            F.transform("terms", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("by"))),
        ).alias("marks"),
    )

    @F.pandas_udf("string")
    def apply(texts, marks):
        out = []
        for x, some in zip(texts, marks, strict=True):
            if x is None or some is None:
                out.append(x)
                continue
            at, parts = 0, []
            for a, b, by in sorted((m["a"], m["b"], m["by"]) for m in some):
                if a >= at:
                    parts += [x[at:a], by]
                    at = b
                elif b > at:  # overlapping spans: nothing of the second stays either
                    at = b
            out.append("".join([*parts, x[at:]]))
        return texts.__class__(out, dtype=object)

    out = rows.join(marks, "row", "left").withColumn("text", apply("text", "marks"))
    return out.select(*[F.col("text").alias(c) if c == text else F.col("of")[c].alias(c) for c in docs.columns])
