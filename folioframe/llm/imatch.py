"""I-Match fingerprints, in DataFrame functions only.

Terms are lower-case runs of letters and digits. The lexicon holds the terms whose document frequency lies in a band
(from ``LOW`` to ``HIGH`` thousandths of the documents, at least two documents): not so rare as to be noise, nor so
common as to tell nothing. Its size is bounded, whatever the corpus: the terms of at least LOW/1000 of the documents
are at most 1000/LOW times the distinct terms of an average document. A random hash of each term deals the lexicon
into eight subsets; each of them is halved five times by further bits of the hash, which makes 48 randomised subsets
in six levels, with an eighth to 1/256 of the lexicon. A document's fingerprint is, for each subset, a hash of its
distinct terms that the subset keeps, sorted; it is empty where there are none. A document without terms in the band
is hashed over all its terms.

The likeness of two fingerprints is the largest share, over the levels, of equal hashes among the subsets in which
either has terms, of levels with at least four such; else the share over all levels. Where neither has any term it
is 1 for equal texts and 0 else.

The next document is found with ranges of ids: each range also gets the first row of the following one, so that no
step orders all rows in one place.

Rows: null texts are empty. A null id counts as the smallest one. Rows that repeat an id come in order of their
text. A table of one row is its own next document. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The band of document frequencies, in thousandths of the documents.
LOW, HIGH = 1, 50
#: Levels of subsets, and subsets in each.
LEVELS, EACH = 6, 8
#: Lists of the lexicon, each looked up by a hash.
SLOTS = 1 << 14
NOT_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), NOT_TERM)), lambda t: t != "")


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) of the terms in the band."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(terms(F.col(text).cast("string"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).where((F.col("df") >= 2) & (F.col("df") * 1000 >= F.col("n") * LOW) & (F.col("df") * 1000 <= F.col("n") * HIGH)).select("term", "df")  # n: one row


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def slots(words: DataFrame) -> Column:
    """The lexicon as one constant, array<string> by slot, each the slot's terms between blanks.

    Its size is bounded as the module's text says; as a constant it needs no join, and so no shuffle of terms.
    """
    lists = [" "] * SLOTS
    for r in words.groupBy(_slot(F.col("term")).alias("slot")).agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("terms")).toLocalIterator():
        lists[r["slot"]] = f" {r['terms']} "
    return F.split(F.lit("\n".join(lists)), "\n")


def fingerprint(text: Column, lists: Column) -> Column:
    """array<string> of LEVELS * EACH: the fingerprint's parts."""
    some = F.filter(terms(text), lambda t: F.contains(F.element_at(lists, _slot(t) + 1), F.concat(F.lit(" "), t, F.lit(" "))))
    # what is used twice is bound once, as the argument of a lambda over a single element
    chosen = F.transform(F.array(some), lambda x: F.when(F.size(x) > 0, x).otherwise(terms(text)))
    hashed = F.transform(chosen, lambda ts: F.transform(F.array_sort(ts), lambda t: F.struct(t.alias("t"), F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint").alias("h"))))

    def halve(lists: Column, bit: Column) -> Column:
        return F.concat(lists, F.transform(F.slice(lists, -EACH, EACH), lambda s: F.filter(s, lambda x: x["h"].bitwiseAND(bit) == 0)))

    def parts(ts: Column) -> Column:
        dealt = F.transform(F.sequence(F.lit(0), F.lit(EACH - 1)), lambda j: F.filter(ts, lambda x: x["h"].bitwiseAND(F.lit(EACH - 1)) == j))
        every = F.aggregate(F.array(*[F.lit(EACH << k) for k in range(LEVELS - 1)]), dealt, halve)
        return F.transform(every, lambda s: F.when(F.size(s) == 0, "").otherwise(F.substring(F.md5(F.array_join(s["t"], " ").cast("binary")), 1, 8)))

    return F.element_at(F.transform(hashed, parts), 1)


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Likeness of two fingerprints (arrays); ``equal``: are the texts equal?"""
    state = F.zip_with(a, b, lambda x, y: F.when((x == "") & (y == ""), 0).when(x == y, 2).otherwise(1))

    def shares(z: Column) -> Column:
        def share(some: Column, least: int) -> Column:
            told, same = F.size(F.filter(some, lambda v: v > 0)), F.size(F.filter(some, lambda v: v == 2))
            return F.when(told >= least, same / told)

        levels = [share(F.slice(z, k * EACH + 1, EACH), 4) for k in range(LEVELS)]
        return F.coalesce(F.greatest(*levels), share(z, 1))

    return F.coalesce(F.element_at(F.transform(F.array(state), shares), 1), F.when(equal, 1.0).otherwise(0.0))


#: Ranges of ids: one for so many rows, and so many at most.
RANGE_ROWS, MOST_RANGES, STRIDE = 1000, 8192, 64


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Window]:
    """(id, text, guest, part) rows of ids in ranges, and the window that orders each range; guests come last."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("at", F.coalesce(F.col("id").cast("bigint"), F.lit(-(2**63))))
    ids = rows.select("at")
    n = ids.count()
    many = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = sorted(set(ids.agg(F.percentile_approx("at", [k / many for k in range(1, many)], 100_000)).first()[0] or [])) if many > 1 else []
    if bounds:  # a search in two steps: the stride, then the bound
        steps, fine = F.array(*map(F.lit, bounds[::STRIDE])), F.array(*map(F.lit, bounds))
        coarse = F.greatest(F.size(F.filter(steps, lambda b: b < F.col("at"))) - 1, F.lit(0))
        near = F.slice(fine, coarse * STRIDE + 1, F.lit(STRIDE))
        part = coarse * STRIDE + F.size(F.filter(near, lambda b: b < F.col("at")))
    else:
        part = F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.min("at").alias("first")).collect())  # a row for each range
    guests = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    guests = docs.sparkSession.createDataFrame(guests or [(0, 0)], "first bigint, guest_of int")
    both = (
        rows.join(F.broadcast(guests), rows["at"] == guests["first"], "left")  # a row for each range
        .select("id", "at", "text", F.explode(F.array(F.struct(F.col("part"), F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("part"), F.lit(True).alias("guest")))).alias("seat"))
        .select("id", "at", "text", "seat.part", "seat.guest")
        .where(F.col("part").isNotNull())
    )
    return both, Window.partitionBy("part").orderBy("guest", "at", "text")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), fingerprints as strings."""
    lists = slots(lexicon(docs, text))
    rows, order = with_next(docs, text, doc_id)
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    rows = rows.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next", F.lit(1), cut)))
    rows = rows.withColumn("same_next", F.col("text") == F.col("next")).withColumn("n_chars", size.cast("long")).drop("next")
    rows = rows.withColumn("own", fingerprint(F.col("text"), lists))
    rows = rows.withColumn("other", F.lead("own").over(order)).where(~F.col("guest"))
    rows = rows.withColumn("changed", fingerprint(F.col("edited"), lists))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited",
        F.array_join("own", ".").alias("fingerprint"),
        F.array_join("changed", ".").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("other"), F.col("same_next")).alias("near_next"),
    )


def _sql() -> str:
    split = lambda x: f"list_filter(list_distinct(regexp_split_to_array(lower({x}), '{NOT_TERM}')), lambda t: t <> '')"
    parts = lambda ts: f"""list_transform(list_transform(range({LEVELS * EACH}), lambda i: list_transform(list_filter({ts}, lambda x: x.h % {EACH} = i % {EACH} AND (x.h // {EACH}) % (1 << (i // {EACH})) = 0), lambda x: x.t)),
        lambda m: CASE WHEN len(m) = 0 THEN '' ELSE substr(md5(array_to_string(m, ' ')), 1, 8) END)"""  # noqa: E731
    share = lambda z, least: f"(CASE WHEN len(list_filter({z}, lambda v: v > 0)) >= {least} THEN len(list_filter({z}, lambda v: v = 2))::DOUBLE / len(list_filter({z}, lambda v: v > 0)) END)"
    near = lambda z, same: f"coalesce(greatest({', '.join(share(f'{z}[{k * EACH + 1}:{k * EACH + EACH}]', 4) for k in range(LEVELS))}), {share(z, 1)}, CASE WHEN {same} THEN 1.0 ELSE 0.0 END)"
    state = lambda a, b: f"list_transform(range(1, {LEVELS * EACH + 1}), lambda i: CASE WHEN {a}[i] = '' AND {b}[i] = '' THEN 0 WHEN {a}[i] = {b}[i] THEN 2 ELSE 1 END)"
    return f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), o AS (
    SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM d
), ed AS (
    SELECT doc_id, text, nxt, substr(text, 1, length(text) - length(text) // 4) || substr(nxt, 1, length(text) // 4) AS edited FROM o
), df AS (
    SELECT term, count(*) AS df FROM (SELECT unnest({split('text')}) AS term FROM d) GROUP BY term
), lex AS (
    SELECT term FROM df, (SELECT count(*) AS n FROM d) WHERE df >= 2 AND df * 1000 >= n * {LOW} AND df * 1000 <= n * {HIGH}
), duo AS (
    SELECT doc_id, false AS e, unnest({split('text')}) AS term FROM ed UNION ALL SELECT doc_id, true, unnest({split('edited')}) FROM ed
), ts AS (
    SELECT doc_id, e, list({{'t': term, 'h': ('0x' || substr(md5(term), 1, 8))::BIGINT}} ORDER BY term) FILTER (WHERE known) AS inb,
        list({{'t': term, 'h': ('0x' || substr(md5(term), 1, 8))::BIGINT}} ORDER BY term) AS allt
    FROM (SELECT doc_id, e, duo.term, lex.term IS NOT NULL AS known FROM duo LEFT JOIN lex USING (term)) GROUP BY doc_id, e
), fp AS (
    SELECT doc_id, e, {parts('coalesce(inb, allt)')} AS f FROM ts
), none AS (
    SELECT list_transform(range({LEVELS * EACH}), lambda i: '') AS f
), j AS (
    SELECT ed.doc_id, text, nxt, edited, coalesce(a.f, none.f) AS own, coalesce(b.f, none.f) AS chg
    FROM ed CROSS JOIN none LEFT JOIN fp a ON a.doc_id = ed.doc_id AND NOT a.e LEFT JOIN fp b ON b.doc_id = ed.doc_id AND b.e
), k AS (
    SELECT *, coalesce(lead(own) OVER (ORDER BY doc_id), first_value(own) OVER (ORDER BY doc_id)) AS oth FROM j
), z AS (
    SELECT *, {state('own', 'chg')} AS z1, {state('own', 'oth')} AS z2 FROM k
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '.') AS fingerprint,
    array_to_string(chg, '.') AS edited_fingerprint, {near('z1', 'text = edited')} AS near_edited, {near('z2', 'text = nxt')} AS near_next
FROM z
"""


SQL = _sql()
