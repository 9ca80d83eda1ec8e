"""Line dedup by content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of a line and the one before it ends a chunk where it falls on a chosen residue, so
that boundaries move with the text when lines are put in or taken out. A chunk of several lines, or of one line with
many words, is a passage. The edges of a passage fuse with the lines around it where no boundary falls on them; so
that it is found whole in any context, the least runs of lines with ``LONG_LINE`` words from each line, downward and
upward, are passages too: their boundaries depend on their own lines alone.

A passage whose hash occurs more than once in the corpus is a candidate, and the earliest one of a hash (smallest
doc_id, then place in the document) stays. The others are joined to spans of lines at one distance from the
same earlier text, and each span is compared byte by byte with what stands there; lines of equal spans go, and others (of passages whose
64-bit hashes collide) stay.

Hashes are counted in the tasks before they are shuffled; texts move by document, and the bytes of a span once
more. Hashes and spans of many rows are dealt out over tasks before they meet the one kept row.

Rows: null texts stay null and empty ones empty; a document all of whose lines are removed has the empty text.
Rows with a null id are kept as they are. Rows that repeat an id and text are one document and are treated alike; of
one id with several texts each text is a document. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.shared import Tables, join_counted

#: One line in so many ends a chunk, and so many words make a single line a passage.
ONE_IN, LONG_LINE = 2, 50


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def chunks(text: Column, one_in: int = ONE_IN) -> Column:
    """array<struct<first, last, body>> of a text: its chunks in order, lines counted from 1."""
    lines = F.split(text, "\n", -1)

    def cut(line_hashes: Column) -> Column:
        """Numbers of the lines that end a chunk."""

        def ends(i: Column) -> Column:
            before = F.when(i > 1, F.element_at(line_hashes, F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(0))
            return (i == F.size(line_hashes)) | (F.shiftright(F.element_at(line_hashes, i) * 5 + before * 3, 6) % one_in == 0)

        return F.filter(F.sequence(F.lit(1), F.size(line_hashes)), ends)

    # lines and their hashes are bound once, as arguments of a lambda over a single element
    def build(x: Column) -> Column:
        last = cut(x["hashes"])
        first = F.concat(F.array(F.lit(1)), F.transform(F.slice(last, 1, F.size(last) - 1), lambda e: e + 1))
        return F.zip_with(
            first,
            last,
            lambda a, b: F.struct(a.alias("first"), b.alias("last"), F.array_join(F.slice(x["lines"], a, b - a + 1), "\n").alias("body")),
        )

    both = F.array(F.struct(lines.alias("lines"), F.transform(lines, _line_hash).alias("hashes")))
    return F.element_at(F.transform(both, build), 1)


def _is_passage(chunk: Column) -> Column:
    words = F.length(chunk["body"]) - F.length(F.replace(chunk["body"], F.lit(" "), F.lit(""))) + 1
    return ((chunk["last"] > chunk["first"]) | (words >= LONG_LINE)) & chunk["body"].rlike("[^ \\n\\t]")


def _pair(first: Column, last: Column) -> Column:
    """Two line numbers in one number, which Spark's array functions hash; structs they compare all with all."""
    return F.shiftleft(first.cast("bigint"), 32) + last.cast("bigint")


def _first(pair: Column) -> Column:
    return F.shiftright(pair, 32).cast("int")


def _last(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def passages(text: Column, one_in: int = ONE_IN, words: int = LONG_LINE) -> Column:
    """array<bigint> of a text: its chunks that are passages, and its least runs of ``words`` words (see ``_pair``).

    From each line goes one run downward and one upward, which ends with the line that brings it to ``words`` words;
    a line counts as one word at least. Any passage of so many words is covered by the runs inside it, and whether a
    run is least is told by its own lines, so that every copy of the passage has the same runs.
    """
    sizes = F.transform(F.split(text, "\n", -1), lambda x: F.size(F.split(F.trim(x), r"\s+")))

    def reach(some: Column) -> Column:
        """So many of the first lines hold enough words; 0 where all of them don't."""
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
        add = lambda acc, w: F.when(acc["sum"] >= words, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + w).alias("sum")))
        return F.aggregate(some, zero, add, lambda acc: F.when(acc["sum"] >= words, acc["n"]).otherwise(0))

    def ends(of: Column) -> Column:
        """Lengths of the run from each line on; few lines are looked at first, as most runs are short.

        ``of`` must be bound already: what stands in the inner lambda is worked out anew for each line.
        """

        def at(i: Column) -> Column:
            near = F.array(reach(F.slice(of, i, min(8, words))))
            return F.element_at(F.transform(near, lambda n: F.when(n > 0, n).otherwise(reach(F.slice(of, i, words)))), 1)

        return F.transform(F.sequence(F.lit(1), F.size(of)), at)

    def build(x: Column) -> Column:
        n = F.size(x["down"])
        down = F.transform(ends(x["down"]), lambda k, i: F.when(k > 0, _pair(i + 1, i + k)))
        up = F.transform(ends(x["up"]), lambda k, i: F.when(k > 0, _pair(n - i - k + 1, n - i)))
        return F.filter(F.concat(down, up), lambda r: r.isNotNull())

    both = F.transform(F.array(sizes), lambda x: F.struct(x.alias("down"), F.reverse(x).alias("up")))
    runs = F.element_at(F.transform(both, build), 1)
    whole = F.transform(F.filter(chunks(text, one_in), _is_passage), lambda c: _pair(c["first"], c["last"]))
    return F.array_distinct(F.concat(whole, runs))


def _marks(text: Column, one_in: int, words: int) -> Column:
    """array<struct<run, hash>>: the passages that aren't blank, with a hash over the hashes of their lines."""
    lines = F.split(text, "\n", -1)
    # told once for each line, not once more for each run that holds it
    bound = F.struct(F.transform(lines, lambda x: x.rlike("[^ \\t]")).alias("said"), F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"), passages(text, one_in, words).alias("runs"))

    def build(x: Column) -> Column:
        of = lambda name, r: F.slice(x[name], _first(r), _last(r) - _first(r) + 1)
        said = lambda r: F.exists(of("said", r), lambda y: y)
        return F.transform(F.filter(x["runs"], said), lambda r: F.struct(r.alias("run"), F.xxhash64(of("hashes", r)).alias("hash")))

    return F.element_at(F.transform(F.array(bound), build), 1)


def _body(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", one_in: int = ONE_IN, words: int = LONG_LINE) -> DataFrame:
    """``docs`` with later copies of repeated passages taken out of ``text``, and the columns _n_lines, _n_gone.

    A line goes if it lies in a passage that stands byte for byte at an earlier place too. A copy that overlaps the
    earliest one stays, so that periodic texts keep that one. Columns of docs named _n_lines or _n_gone are replaced.
    """
    columns = [c for c in docs.columns if c not in ("_n_lines", "_n_gone")]
    apart = F.col(doc_id).isNotNull() & F.col(text).isNotNull()
    body = F.col(text).cast("string")
    n_lines = F.size(F.split("text", "\n", -1))
    bind = lambda runs, f: F.element_at(F.transform(F.array(F.struct(F.split("text", "\n", -1).alias("lines"), runs.alias("runs"))), f), 1)
    # a row's key tells texts of one id apart; the other columns travel in one struct, so that no name can clash
    rows = docs.where(apart).select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(body).alias("of")).alias("key"), body.alias("text"), F.struct(*[F.col(c) for c in columns if c != text] or [F.lit(0)]).alias("rest"))
    with Tables() as own:
        with Tables() as early:  # rows of four numbers, as there are some for each line
            marks = early.stash(rows.select("key.id", "key.of", F.explode(_marks(F.col("text"), one_in, words)).alias("r")).select("id", "of", "r.*"), "passages")
            often = early.stash(marks.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "repeated")
            found = own.stash(join_counted(marks, often, ["hash"], F.col("id"), hint="merge").drop("k"), "found")
        del marks, often
        kept = own.stash(found.groupBy("hash").agg(F.min(F.struct("id", "of", "run")).alias("kept"), F.count(F.lit(1)).alias("k")), "kept")
        overlaps = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("of") == F.col("kept.of")) & (_first(F.col("run")) <= _last(F.col("kept.run")))
        later = join_counted(found, kept, ["hash"], F.col("id"), hint="merge").where(~overlaps)
        named = [F.struct("id", "of").alias("key"), F.struct("kept.id", "kept.of").alias("of"), (_first(F.col("kept.run")) - _first(F.col("run"))).alias("away")]
        later = later.select(*named, _first(F.col("run")).alias("first"), _last(F.col("run")).alias("last"))
        # runs of one text that stand at one distance from the same earlier text are joined, so that each line's bytes move once
        order = Window.partitionBy("key", "of", "away").orderBy("first", "last")
        runs = later.withColumn("reach", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        runs = runs.withColumn("span", F.count(F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach") + 1), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        spans = own.stash(runs.groupBy("key", "of", "away", "span").agg(F.min("first").alias("first"), F.max("last").alias("last")), "spans")
        named = F.transform("runs", lambda r: F.struct(r["of"].alias("of"), (r["first"] + r["away"]).alias("at"), (r["last"] + r["away"]).alias("upto"), r["first"].alias("first"), r["last"].alias("last")))
        theirs = spans.groupBy("of", (F.col("first") + F.col("away")).alias("first"), (F.col("last") + F.col("away")).alias("last")).agg(F.count(F.lit(1)).alias("k"))
        # what to read of each text: its own spans, and (with the count k of those that ask) what others are compared with
        mine = spans.select("key", "of", "away", "first", "last", F.lit(None).cast("bigint").alias("k"))
        asked = theirs.select(F.col("of").alias("key"), "of", F.lit(0).alias("away"), "first", "last", "k")
        wanted = mine.unionByName(asked).groupBy("key").agg(F.collect_list(F.struct("of", "away", "first", "last", "k")).alias("runs"))
        read = lambda x: F.transform(x["runs"], lambda r: F.struct(r.alias("r"), _body(x["lines"], r["first"], r["last"]).alias("body")))
        pieces = rows.select("key", "text").join(wanted.hint("merge"), "key").select("key", F.explode(bind(F.col("runs"), read)).alias("r")).select("key", "r.r.*", "r.body")
        pieces = own.stash(pieces.withColumns({"at": F.col("first") + F.col("away"), "upto": F.col("last") + F.col("away")}), "pieces")
        originals = pieces.where("k IS NOT NULL").dropDuplicates(["of", "at", "upto"]).select("of", "at", "upto", "k", F.col("body").alias("kept"))
        copies = pieces.where("k IS NULL").drop("k")
        same_bytes = join_counted(copies, own.stash(originals, "originals"), ["of", "at", "upto"], F.col("key"), hint="merge").where(F.col("body") == F.col("kept"))
        gone = own.keep(same_bytes.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "gone")
    lost = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))
    left = bind(F.array_except(F.sequence(F.lit(1), n_lines), lost), lambda x: F.array_join(F.transform(x["runs"], lambda i: F.element_at(x["lines"], i)), "\n"))
    has = F.col("runs").isNotNull()
    of = lambda c: F.col("now").alias(c) if c == text else F.col("rest")[c].alias(c)
    out = rows.join(gone.hint("merge"), "key", "left").select("rest", F.when(has, left).otherwise(F.col("text")).alias("now"), n_lines.alias("_n_lines"), F.when(has, F.size(lost)).otherwise(0).alias("_n_gone"))
    out = out.select(*[of(c) for c in columns], "_n_lines", "_n_gone")
    same = docs.where(~apart).select(*[body.alias(c) if c == text else F.col(c) for c in columns], F.when(body.isNotNull(), F.size(F.split(body, "\n", -1))).otherwise(0).alias("_n_lines"), F.lit(0).alias("_n_gone"))
    return out.unionByName(same)


_WORDS = "len(regexp_split_to_array(trim(line, ' '), '[ \\t\\x0B\\f\\r]+'))"
SQL = f"""
WITH d AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), h AS (
    SELECT doc_id, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM d WHERE text IS NOT NULL
), e AS (
    SELECT doc_id, ls, list_filter(range(1, len(hs) + 1), lambda i: i = len(hs)
        OR ((hs[i] * 5 + (CASE WHEN i > 1 THEN hs[greatest(i - 1, 1)] ELSE 0 END) * 3) >> 6) % {ONE_IN} = 0) AS es
    FROM h
), c AS (
    SELECT doc_id, unnest(list_transform(range(1, len(es) + 1), lambda k: {{'a': CASE WHEN k = 1 THEN 1 ELSE es[k - 1] + 1 END, 'b': es[k]}})) AS x FROM e
), l AS (
    SELECT doc_id, i, line, {_WORDS} AS n FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM h)
), w AS (
    SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before FROM l
), s AS (
    SELECT doc_id, x.a AS a, x.b AS b, true AS chunk FROM c
    UNION ALL SELECT p.doc_id, p.i, q.i, false FROM (SELECT *, before + {LONG_LINE} AS want FROM w) p ASOF JOIN w q ON p.doc_id = q.doc_id AND p.want <= q.upto
    UNION ALL SELECT p.doc_id, q.i, p.i, false FROM (SELECT *, upto - {LONG_LINE} AS want FROM w) p ASOF JOIN w q ON p.doc_id = q.doc_id AND p.want >= q.before
), q AS (
    SELECT DISTINCT doc_id, a, b, array_to_string(ls[a:b], chr(10)) AS body, chunk FROM s JOIN h USING (doc_id)
), k AS (
    SELECT DISTINCT doc_id, a, b, body FROM q
    WHERE (NOT chunk OR b > a OR length(body) - length(replace(body, ' ', '')) + 1 >= {LONG_LINE}) AND length(trim(replace(replace(body, chr(10), ''), chr(9), ''))) > 0
), f AS (
    SELECT body, min({{'doc_id': doc_id, 'a': a, 'b': b}}) AS first FROM k GROUP BY body HAVING count(*) > 1
), g AS (
    SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM k JOIN f USING (body) WHERE NOT (doc_id = first.doc_id AND a <= first.b)
), r AS (
    SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_gone, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.i IS NULL), '') AS kept
    FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_gone, 0) AS n_gone, sha256(kept) AS text_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
