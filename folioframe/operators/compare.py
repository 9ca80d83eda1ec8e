"""Comparison of documents: word bags, near-copy pairs, anchors, diffs of lines and words, moved text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators import nearpairs


def word_bags(docs: DataFrame, words: str = "words", doc: str = "doc_id") -> DataFrame:
    """(doc, word, n): how often each word stands in a document; ``words`` is an array column. No shuffle where docs are dealt by ``doc``."""
    return docs.select(F.col(doc).alias("doc"), F.explode(words).alias("word")).groupBy("doc", "word").agg(F.count(F.lit(1)).alias("n"))


def dice_of_pairs(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, dice): 2 sum(min(n, m)) / (total of both) for each pair (a, b); two empty documents are alike."""
    totals = bags.groupBy("doc").agg(F.sum("n").alias("total"))
    old, new = (pairs.join(bags.select(F.col("doc").alias(side), "word", F.col("n").alias(n)), side).select("a", "b", "word", n) for side, n in (("a", "x"), ("b", "y")))
    shared = old.join(new, ["a", "b", "word"]).groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("both"))
    sides = pairs.join(shared, ["a", "b"], "left").join(totals.select(F.col("doc").alias("a"), F.col("total").alias("ta")), "a", "left").join(totals.select(F.col("doc").alias("b"), F.col("total").alias("tb")), "b", "left")
    total = F.coalesce("ta", F.lit(0)) + F.coalesce("tb", F.lit(0))
    return sides.select("a", "b", F.when(total == 0, 1.0).otherwise(2 * F.coalesce("both", F.lit(0)) / total).alias("dice"))


def dice_of_documents(pairs: DataFrame, docs: DataFrame, words: Callable[[Column], Column]) -> DataFrame:
    """(a, b, dice) as ``dice_of_pairs``, from texts (doc, text): those of a pair are brought together, and counted there."""
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("doc"), F.lit(True).alias("old")), F.struct(F.col("b").alias("doc"), F.lit(False).alias("old")))).alias("s"))
    texts = sides.select("a", "b", "s.*").join(docs, "doc").repartition("a", "b")
    n = texts.select("a", "b", "old", F.explode_outer(words(F.col("text"))).alias("word")).groupBy("a", "b", "word").agg(F.count_if(F.col("old") & F.col("word").isNotNull()).alias("x"), F.count_if(~F.col("old") & F.col("word").isNotNull()).alias("y"))
    sums = n.groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("both"), F.sum(F.col("x") + F.col("y")).alias("total"))
    return sums.select("a", "b", F.when(F.col("total") == 0, 1.0).otherwise(2 * F.col("both") / F.col("total")).alias("dice"))


def _kept(rows: DataFrame, _: str) -> DataFrame:
    return rows


def near_candidates(bags: DataFrame, threshold: float, written: Callable[[DataFrame, str], DataFrame] = _kept) -> DataFrame:
    """(a, b), a < b: all pairs of at least ``threshold`` and few others, without pairing all documents; see ``nearpairs``."""
    repeated = F.flatten(F.collect_list(F.array_repeat(F.xxhash64("word"), F.col("n").cast("int"))))
    return nearpairs.candidates(bags.groupBy("doc").agg(repeated.alias("words")), threshold, written)


def near_pairs(bags: DataFrame, threshold: float = 0.5, written: Callable[[DataFrame, str], DataFrame] = _kept) -> DataFrame:
    """(a, b, dice), a < b: all pairs of at least ``threshold``; only the bags of candidates are compared word by word."""
    pairs = written(near_candidates(bags, threshold, written), "candidates")
    both = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    return dice_of_pairs(pairs, bags.join(both, "doc", "left_semi")).where(F.col("dice") >= threshold)


def _copies(keyed: DataFrame) -> DataFrame:
    """(a, b): each document (doc, bag) of an equal bag with the first of its class."""
    first = keyed.groupBy("bag").agg(F.min("doc").alias("a"))
    return keyed.join(first, "bag").where(F.col("doc") > F.col("a")).select("a", F.col("doc").alias("b"))


def near_links(docs: DataFrame, bags: DataFrame, threshold: float = 0.5, written: Callable[[DataFrame, str], DataFrame] = _kept) -> DataFrame:
    """(a, b, dice), a < b: near pairs of different bags, and each document of an equal bag linked to the first of its class.

    ``docs`` is (doc), also of documents without words, which are one class. A class stands in pairs by its smallest
    document, so that a group of n copies gives n - 1 links and not all pairs of it. ``written`` writes what is read several times.
    """
    bags = written(bags, "bags")
    keys = bags.groupBy("doc").agg(F.array(F.sum("n"), F.count(F.lit(1)), *(F.bit_xor(F.xxhash64(F.lit(salt), "word", "n")) for salt in (1, 2, 3))).cast("string").alias("bag"))
    copies = written(_copies(docs.select("doc").distinct().join(keys, "doc", "left").withColumn("bag", F.coalesce("bag", F.lit("")))), "copies")
    firsts = bags.join(copies.select(F.col("b").alias("doc")), "doc", "left_anti")
    return near_pairs(firsts, threshold, written).unionByName(copies.withColumn("dice", F.lit(1.0)))


def near_links_of_documents(docs: DataFrame, words: Callable[[Column], Column], threshold: float = 0.5, written: Callable[[DataFrame, str], DataFrame] = _kept) -> DataFrame:
    """(a, b, dice) as ``near_links``, from texts (doc, text), which are read where they lie; the words of a repeated id are one bag.

    Shuffled are the rare elements of texts (``nearpairs``), the texts of repeated ids, and those of candidates once for each cell.
    """
    docs = docs.where("doc IS NOT NULL")
    repeated = written(docs.groupBy("doc").count().where("count > 1").select("doc"), "repeated")
    if not repeated.isEmpty():
        sent = nearpairs.sent(repeated)
        joined = docs.join(sent, "doc", "left_semi").groupBy("doc").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
        docs = docs.join(sent, "doc", "left_anti").unionByName(joined)
    found = F.coalesce(words(F.col("text")), F.array().cast("array<string>"))
    bag = F.sha2(F.array_join(F.sort_array("words"), " ").cast("binary"), 256)
    keyed = written(docs.select("doc", found.alias("words")).select("doc", bag.alias("bag"), F.size("words").alias("total")), "classes")
    copies = written(_copies(keyed), "copies")
    firsts = docs.join(nearpairs.sent(copies.select(F.col("b").alias("doc"))), "doc", "left_anti")
    hashed = firsts.select("doc", nearpairs.hashes(words(F.col("text"))).alias("words"))
    pairs = written(nearpairs.candidates(hashed, threshold, written, keyed.select("total")), "candidates")
    near = nearpairs.dice_within_cells(pairs, docs, words, written)
    return near.where(F.col("dice") >= threshold).unionByName(copies.withColumn("dice", F.lit(1.0)))


def anchors(tokens: DataFrame) -> DataFrame:
    """(pair, word, old_pos, new_pos): words that stand exactly once on either side (pair, side, pos, word)."""
    old, new = F.col("side") == "old", F.col("side") == "new"
    pos = lambda side: F.min(F.when(side, F.col("pos")))
    n = tokens.where(F.col("word").isNotNull()).groupBy("pair", "word").agg(F.count_if(old).alias("x"), F.count_if(new).alias("y"), pos(old).alias("old_pos"), pos(new).alias("new_pos"))
    return n.where("x = 1 AND y = 1 AND pair IS NOT NULL").select("pair", "word", "old_pos", "new_pos")


def _longest_run(places: Iterable[int]) -> list[int]:
    """Indices of a longest rising run of ``places``."""
    tails, at, back = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        back.append(at[k - 1] if k else -1)
        tails[k : k + 1], at[k : k + 1] = [p], [i]
    keep, i = [], at[-1] if at else -1
    while i >= 0:
        keep.append(i)
        i = back[i]
    return keep[::-1]


def anchor_chain(found: DataFrame) -> DataFrame:
    """The longest run of anchors in order on both sides, for each pair (a small group)."""

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("old_pos").reset_index(drop=True)
        return rows.iloc[_longest_run(rows["new_pos"])]

    return found.groupBy("pair").applyInPandas(chain, found.schema)


#: Cells of a table of lengths that is held at once; larger gaps are halved first.
CELLS = 4_000_000


def _by_table(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, by a table of the lengths of tails.

    A row of the table is one number, whose bit t is 1 where the length grows by one from the last t words of new to one
    more. A word of old is taken at its next place in new unless the words of new up to there give as much without it.
    """
    m, at = len(new), {}
    for j, w in enumerate(new):
        at.setdefault(w, []).append(j)
    masks = {}
    for w in set(old) & at.keys():
        bits = bytearray(m // 8 + 1)
        for j in at[w]:
            bits[(m - 1 - j) >> 3] |= 1 << ((m - 1 - j) & 7)
        masks[w] = int.from_bytes(bits, "little")
    row = whole = (1 << m) - 1
    rows = [0]  # of the tails of old, shortest first
    for w in reversed(old):
        if w in masks:
            met = row & masks[w]
            row = ((row + met) | (row - met)) & whole
        rows.append(row ^ whole)
    j, out = 0, []
    for i, w in enumerate(old):
        if w in at and j <= at[w][-1]:
            k = at[w][bisect_left(at[w], j)]
            if k == j or not (rows[len(old) - i - 1] >> (m - 1 - k)) & ((1 << (k - j + 1)) - 1):
                out.append((i, k))
                j = k + 1
    return out


def _lengths(old: list[str], new: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences of ``old`` with each head of ``new``, shortest head first.

    A row of the table is one number, of which a bit is 0 where the length grows by one from a head to the next; a word
    of old takes a few operations on it. Memory is that of a row.
    """
    at: dict[str, list[int]] = {}
    for j, w in enumerate(new):
        at.setdefault(w, []).append(j)
    kept: dict[str, int] = {}

    def mask(w: str) -> int:
        """The places of a word as bits; kept for words of many places, of which there are few."""
        if w in kept:
            return kept[w]
        bits = np.zeros(len(new) // 8 + 1, np.uint8)
        places = np.array(at[w])
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        out = int.from_bytes(bits.tobytes(), "little")
        if len(places) ** 2 > len(new):
            kept[w] = out
        return out

    whole = (1 << len(new)) - 1
    row = whole
    for w in old:
        if w in at:
            met = row & mask(w)
            row = ((row + met) | (row - met)) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(new) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(new)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_subsequence(old: list[str], new: list[str], cells: int = CELLS) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of any two lists, in memory proportional to their lengths.

    Words of one side only are left out, equal heads and tails are taken as they are. Where a table would be too large,
    the old side is halved and the new side cut where the two halves have most in common; both parts go on alone.
    """
    out: list[tuple[int, int]] = []
    both = set(old).intersection(new)
    a, b = [i for i, w in enumerate(old) if w in both], [j for j, w in enumerate(new) if w in both]
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and old[a[i]] == new[b[j]]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        while i < k and j < m and old[a[k - 1]] == new[b[m - 1]]:
            k, m = k - 1, m - 1
            out.append((a[k], b[m]))
        if i == k or j == m:
            continue
        x, y = [old[p] for p in a[i:k]], [new[p] for p in b[j:m]]
        if len(x) * len(y) <= cells or len(x) == 1:
            out += [(a[i + p], b[j + q]) for p, q in _by_table(x, y)]
            continue
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        todo += [(i, i + half, j, j + cut), (i + half, k, j + cut, m)]
    return sorted(out)


def _gap_changes(old: list[str], new: list[str]) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, old_text, new_text, i, j) of each change between two lists, by a longest common subsequence."""
    if old == new:
        return
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    old, new = old[head : len(old) - tail], new[head : len(new) - tail]
    i = j = 0
    for k, m in [*common_subsequence(old, new), (len(old), len(new))]:
        if i < k or j < m:
            kind = "added" if i == k else "removed" if j == m else "replaced"
            yield kind, " ".join(old[i:k]), " ".join(new[j:m]), head + i, head + j
        i, j = k + 1, m + 1


def word_diff(tokens: DataFrame, chain: DataFrame) -> DataFrame:
    """(pair, kind, old_text, new_text, at): removed, added and replaced runs between the anchors of a pair.

    Anchors cut a pair into gaps; equal heads and tails of a gap are stripped, and a longest common subsequence cuts what
    is left into changes, however long it is. ``at`` orders a pair's changes.
    """
    w = Window.partitionBy("pair", "side").orderBy("pos")
    marks = chain.select("pair", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old_pos").alias("pos")), F.struct(F.lit("new").alias("side"), F.col("new_pos").alias("pos")))).alias("m")).select("pair", "m.side", "m.pos", F.lit(1).alias("anchor"))
    placed = tokens.join(marks, ["pair", "side", "pos"], "left").withColumn("gap", F.sum(F.coalesce("anchor", F.lit(0))).over(w))
    rest = placed.where("anchor IS NULL")
    text = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "word")))), lambda s: s["word"])
    gaps = rest.groupBy("pair", "gap").agg(text("old").alias("o"), text("new").alias("n")).where("o <> n")

    def changes(batches):
        for batch in batches:
            out = []
            for pair, gap, o, n in zip(batch["pair"], batch["gap"], batch["o"], batch["n"], strict=True):
                out += [(pair, kind, a, b, gap, i, j) for kind, a, b, i, j in _gap_changes(list(o), list(n))]
            yield pd.DataFrame(out, columns=["pair", "kind", "old_text", "new_text", "gap", "i", "j"])

    kind = tokens.schema["pair"].dataType.simpleString()
    found = gaps.mapInPandas(changes, f"pair {kind}, kind string, old_text string, new_text string, gap long, i long, j long")
    at = F.row_number().over(Window.partitionBy("pair").orderBy("gap", "i", "j"))
    return found.withColumn("at", at.cast("bigint")).select("pair", "kind", "old_text", "new_text", "at")


#: Pairs whose changes are handed on together.
PAIRS_HELD = 100


def diff_of_documents(docs: DataFrame, words: Callable[[Column], Column], parts: int) -> DataFrame:
    """(pair, kind, old_text, new_text, at) as ``word_diff``, from texts (pair, side, text), their words without blanks.

    Texts are brought together by ``pair``, in ``parts`` partitions, and nothing is shuffled after that: words are grouped
    for anchors where their texts lie, and only a pair's anchors are joined to its texts, for the run that is kept and the
    changes between. Several texts of one side are read in turn, a word of each.
    """
    text, side = F.col("text"), F.col("side")
    # a struct is never null, so that no filter keeps the join's sides from sharing the shuffle
    met = docs.select(F.struct("pair").alias("pair"), "side", F.array_join(words(text), " ").alias("text")).repartition(parts, "pair")
    numbered = lambda t: F.transform(F.split(t, " "), lambda w, k: F.struct(k.alias("k"), w.alias("w")))

    def whole(s: str) -> Column:
        several = F.collect_list(F.when((side == s) & (text != ""), text))
        in_turn = F.transform(F.array_sort(F.flatten(F.transform(several, numbered))), lambda x: x["w"])
        return F.when(F.size(several) < 2, F.array_join(several, " ")).otherwise(F.array_join(in_turn, " "))

    texts = met.groupBy("pair").agg(whole("old").alias("old"), whole("new").alias("new")).where("old <> new")
    sides = texts.select("pair", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in ("old", "new")))).alias("s")).select("pair", "s.*")
    tokens = sides.select("pair", "side", F.posexplode(F.split(text, " ")).alias("pos", "word")).where("word <> ''")
    places = F.array_sort(F.collect_list(F.struct("old_pos", "new_pos")))
    marked = texts.join(anchors(tokens).groupBy("pair").agg(places.alias("a")), "pair", "left")
    both = marked.select("pair.pair", "old", "new", *(F.coalesce(F.col(f"a.{p}"), F.array().cast("array<int>")).alias(p) for p in ("old_pos", "new_pos")))

    def changes(batches):
        for batch in batches:
            for first in range(0, len(batch), PAIRS_HELD):
                out = []
                for pair, o, n, at_old, at_new in batch.iloc[first : first + PAIRS_HELD].itertuples(index=False):
                    old, new = o.split(" ") if o else [], n.split(" ") if n else []
                    i = j = at = 0
                    for k, m in [*((at_old[x], at_new[x]) for x in _longest_run(at_new)), (len(old), len(new))]:
                        for kind, a, b, *_ in _gap_changes(old[i:k], new[j:m]):
                            at += 1
                            out.append((pair, kind, a, b, at))
                        i, j = k + 1, m + 1
                yield pd.DataFrame(out, columns=["pair", "kind", "old_text", "new_text", "at"])

    kind = docs.schema["pair"].dataType.simpleString()
    return both.mapInPandas(changes, f"pair {kind}, kind string, old_text string, new_text string, at long")


def moved(removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, old_at, new_at): a removed and an added block of the same key are one move, k-th with k-th."""
    rank = lambda at: F.row_number().over(Window.partitionBy(*keys, "key").orderBy(at))
    old = removed.withColumn("k", rank("at")).select(*keys, "key", "k", F.col("at").alias("old_at"))
    new = added.withColumn("k", rank("at")).select(*keys, "key", "k", F.col("at").alias("new_at"))
    return old.join(new, [*keys, "key", "k"]).drop("k")


def align_pages(similar: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(pair, old_page, new_page): the monotone alignment of largest gain (similarity less threshold), gaps free.

    ``similar`` is (pair, old_page, new_page, sim), rows above the threshold only. A pair's rows are one group, whose time
    and memory are those of its rows (and a logarithm), not of all old by all new pages.
    """

    def align(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(group["old_page"], group["new_page"], group["sim"] - threshold, strict=True), key=lambda r: (r[0], -r[1]))
        places = {b: k for k, b in enumerate(sorted({b for _, b, _ in rows}), 1)}
        tree: list[tuple[float, int]] = [(0.0, -1)] * (len(places) + 1)  # best gain, and its last row, among new pages up to a place
        back, gains = [], []
        for i, (_, b, g) in enumerate(rows):
            at, best = places[b] - 1, (0.0, -1)
            while at:
                best, at = max(best, tree[at]), at & (at - 1)
            back.append(best[1])
            gains.append(best[0] + g)
            at = places[b]
            while at < len(tree):
                tree[at], at = max(tree[at], (gains[-1], i)), at + (at & -at)
        i, out = max(range(len(rows)), key=gains.__getitem__), []
        while i >= 0:
            out.append((group["pair"].iloc[0], rows[i][0], rows[i][1]))
            i = back[i]
        return pd.DataFrame(out[::-1], columns=["pair", "old_page", "new_page"])

    kind = similar.schema["pair"].dataType.simpleString()
    return similar.groupBy("pair").applyInPandas(align, f"pair {kind}, old_page long, new_page long")


def mutual_best(similar: DataFrame) -> DataFrame:
    """(pair, old_page, new_page, sim): greedy pairing by falling similarity, in rounds of pairs best on both sides."""
    left, out = similar, None
    while True:
        order = [F.desc("sim"), "old_page", "new_page"]
        ranked = left.withColumn("x", F.row_number().over(Window.partitionBy("pair", "old_page").orderBy(*order))).withColumn("y", F.row_number().over(Window.partitionBy("pair", "new_page").orderBy(*order)))
        best = ranked.where("x = 1 AND y = 1").drop("x", "y").checkpoint()
        if best.isEmpty():
            return out if out is not None else best
        out = best if out is None else out.unionByName(best)
        left = left.join(best.select("pair", "old_page"), ["pair", "old_page"], "left_anti").join(best.select("pair", "new_page"), ["pair", "new_page"], "left_anti").checkpoint()


