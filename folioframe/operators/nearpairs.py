"""Near pairs of word bags: elements dealt by sizes and hashes, met within tasks, told apart by sketches; texts compared in cells.

What a task makes of the documents that share an element stays in its memory; only pairs whose sketches are alike leave it.
A text goes once to a cell of documents that are near one another, however many pairs it stands in there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that are sorted at once, pairs that are compared at once, and 64-bit words of sketches compared at once.
ELEMENTS, PAIRS, SKETCHED = 500_000, 500_000, 1_000_000
#: Postings of a group, up to which a band of sizes is cut into at most SHARDS groups, and of larger bands.
POSTINGS, MOST_POSTINGS, SHARDS = 500_000, 4_000_000, 4
#: Rows of counted lists that are sent to every task; beyond, they are joined by a shuffle.
ROWS_SENT = 1_000_000
#: Documents of a cell, and of a block that a larger group is cut into.
DOCS, BLOCK = 500, 256
EPS = 1e-9


def bands(part: float) -> np.ndarray:
    """Least sizes of bands; what is at most 1/part of a size lies in its band or in the next."""
    out = [1]
    while out[-1] < 2**31:
        out.append(int(out[-1] / part + 1e-6) + 1)
    return np.array(out, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _elements(words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element), in order of rows: the k-th time that a word stands in a row is an element of its own."""
    row = np.repeat(np.arange(len(lens), dtype=np.uint16), lens)
    o = np.argsort(words)
    o = o[np.argsort(row[o], kind="stable")]
    w, row = words[o], row[o]
    at = np.arange(len(w))
    begins = np.ones(len(w), bool)
    begins[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
    k = at - np.maximum.accumulate(np.where(begins, at, 0))
    return row, _mixed(w.view(np.uint64) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(documents, words, words of each): batches of (doc, words) in pieces of about ``ELEMENTS`` words."""
    for batch in batches:
        docs, lists = batch.column("doc"), batch.column("words")
        ends = np.asarray(lists.offsets, dtype=np.int64)
        words = np.asarray(lists.values)
        i = 0
        while i < len(docs):
            k = min(max(int(np.searchsorted(ends, ends[i] + ELEMENTS, "right")) - 1, i + 1), i + 65_535, len(docs))
            yield docs.slice(i, k - i), words[ends[i] : ends[k]], np.diff(ends[i : k + 1])
            i = k


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words, lens in _chunks(batches):
        e, n = np.unique(_elements(words, lens)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(n.astype(np.int64))], ["e", "n"])


def _sketches(row: np.ndarray, e: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """For each row as many ``bits``: whether an odd number of its elements falls on a bit. Rows of 0 bits have none."""
    ends = np.cumsum(bits)
    have = bits[row] > 0
    row, e = row[have], e[have]
    at = (ends - bits)[row] + (_mixed(e) % bits[row].astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=int(ends[-1])) & 1).astype(np.uint8)).tobytes()
    return [data[(k - n) // 8 : k // 8] for k, n in zip(ends.tolist(), bits.tolist(), strict=True)]


def _cut(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` from each start to the next."""
    ends = np.append(starts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def candidates(hashed: DataFrame, threshold: float, written: Callable[[DataFrame, str], DataFrame], sizes: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of documents (doc, words) of Dice ``threshold`` and few others; words are hashes, as often as they stand.

    A word's k-th occurrence is an element, so that bags are sets. Two sets of sizes x and y that share ``need`` elements or
    more share one of the first x - need + 1 and y - need + 1 of theirs in any order of all elements; the rarest come first.
    Documents go to groups by bands of sizes, in which all partners of a size stand, and by hashes of these elements. Two
    that share one there are candidates if their sketches, parities of hashed elements, differ in no more bits than the
    sets may differ in elements. ``sizes`` (total) serves to tell how many groups are needed, if they are known already.
    """
    part = threshold / (2 - threshold)
    low = bands(part)
    bits = np.minimum(-(-2 * low[1:] // 64) * 64, 65_536)
    if sizes is None:
        sizes = hashed.select(F.size("words").alias("total"))
    often = written(hashed.mapInArrow(_tally, "e bigint, n bigint").groupBy("e").agg(F.sum("n").alias("n")).where("n > 1"), "often")
    by_log = F.floor(F.log2("n") * 4)
    left, least = ROWS_SENT, 2**62
    for log, n in sorted(often.groupBy(by_log).count().collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = log
    ranks = often.select("e", by_log.alias("log")).where(F.col("log") >= least).toArrow()
    order = np.argsort(np.asarray(ranks["e"]).view(np.uint64))
    sent = hashed.sparkSession.sparkContext.broadcast((np.asarray(ranks["e"]).view(np.uint64)[order], np.asarray(ranks["log"]).astype(np.uint16)[order] + np.uint16(1)))
    band = F.size(F.filter(F.array(*map(F.lit, low.tolist())), lambda b: b <= F.col("total"))) - 1
    words_of = dict(sizes.where("total > 0").groupBy(band).agg(F.sum("total")).collect())
    postings = [(1 - part) * (words_of.get(b, 0) + words_of.get(b + 1, 0)) for b in range(len(low))]
    shards = np.array([max(math.ceil(n / MOST_POSTINGS), min(SHARDS, math.ceil(n / POSTINGS)), 1) for n in postings])

    def deal(batches):
        common, rank = sent.value
        for docs, words, total in _chunks(batches):
            row, e = _elements(words, total)
            if not len(e):
                continue
            log = np.zeros(len(e), np.uint16)
            if len(common):
                at = np.minimum(np.searchsorted(common, e), len(common) - 1)
                log = np.where(common[at] == e, rank[at], np.uint16(0))
            o = np.argsort(e)
            o = o[np.argsort(log[o], kind="stable")]
            o = o[np.argsort(row[o], kind="stable")]
            row, e = row[o], e[o]
            place = np.arange(len(e)) - (np.cumsum(total) - total)[row] + 1
            own = np.searchsorted(low, total, "right") - 1
            for down in (0, 1):  # to the band of its size, and to the one before, where smaller partners stand
                group = own - down
                partner = np.maximum(low[group], np.ceil(total * part - EPS).astype(np.int64))
                goes = (group >= 0) & (total > 0) & (partner < low[group + 1])
                most = total - np.ceil(threshold * (partner + total) / 2 - EPS).astype(np.int64) + 1
                kept = np.flatnonzero(goes[row] & (place <= most[row]))
                if not len(kept):
                    continue
                shard = ((e[kept] >> np.uint64(32)) % shards[group][row[kept]].astype(np.uint64)).astype(np.int64)
                o = np.argsort(shard, kind="stable")
                o = o[np.argsort(row[kept][o], kind="stable")]
                kept, shard = kept[o], shard[o]
                starts = np.flatnonzero(np.append(True, (row[kept][1:] != row[kept][:-1]) | (shard[1:] != shard[:-1])))
                rows = row[kept[starts]]
                sketches = _sketches(row, e, np.where(goes, bits[group], 0))
                columns = [pa.array(group[rows] * 2**32 + shard[starts]), docs.take(pa.array(rows)), pa.array(total[rows].astype(np.int32))]
                columns += [_cut(v.astype(kind), starts) for v, kind in ((e[kept], np.uint32), (place[kept], np.uint16), (place[kept] >> 16, np.uint16))]
                columns.append(pa.array([sketches[r] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["group", "doc", "total", "elements", "places", "beyond", "sketch"])

    def meet(t: pa.Table) -> pa.Table:
        group, n = t["group"][0].as_py() >> 32, len(t)
        joined = lambda name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind)
        size = t["total"].to_numpy().astype(np.int64)
        sketch = joined("sketch", np.uint64).reshape(n, -1)
        doc = np.repeat(np.arange(n), pc.binary_length(t["elements"]).to_numpy() // 4)
        key = joined("elements", np.uint32).astype(np.uint64) << np.uint64(32) | size[doc].astype(np.uint64)
        o = np.argsort(key)
        key, doc, place = key[o], doc[o], (joined("places", np.uint16) + (joined("beyond", np.uint16).astype(np.int64) << 16))[o]
        total = size[doc]
        need = lambda x, y: np.ceil(threshold * (x + y) / 2 - EPS).astype(np.int64)
        end = np.searchsorted(key, key >> np.uint64(32) << np.uint64(32) | np.minimum(np.floor(total / part + EPS), 2**31).astype(np.uint64), "right")
        first = np.flatnonzero((total < low[group + 1]) & (place <= total - need(total, total) + 1) & (end > np.arange(len(key)) + 1))
        n_after = end[first] - first - 1
        upto = np.cumsum(n_after)
        found, once, i = [np.empty(0, np.int64)], 0, 0
        while i < len(first):
            k = max(int(np.searchsorted(upto, upto[i] - n_after[i] + PAIRS, "right")), i + 1)
            x = np.repeat(first[i:k], n_after[i:k])
            y = x + 1 + np.arange(len(x)) - np.repeat(upto[i:k] - n_after[i:k] - (upto[i] - n_after[i]), n_after[i:k])
            spare = need(total[x], total[y]) - 1
            both = (place[x] <= total[x] - spare) & (place[y] <= total[y] - spare) & (doc[x] != doc[y])
            x, y = doc[x[both]], doc[y[both]]
            met = np.unique(np.minimum(x, y) * n + np.maximum(x, y))
            step = max(SKETCHED // sketch.shape[1], 1)
            for j in range(0, len(met), step):
                x, y = np.divmod(met[j : j + step], n)
                differ = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
                found.append(met[j : j + step][differ <= size[x] + size[y] - 2 * need(size[x], size[y])])
            if sum(map(len, found)) > 2 * once + PAIRS:  # pairs of many common elements come again and again
                found = [np.unique(np.concatenate(found))]
                once = len(found[0])
            i = k
        x, y = np.divmod(np.unique(np.concatenate(found)), n)
        docs = t["doc"].combine_chunks()
        return pa.table({"a": docs.take(pa.array(x)), "b": docs.take(pa.array(y))})

    kind = hashed.schema["doc"].dataType.simpleString()
    dealt = hashed.mapInArrow(deal, f"group bigint, doc {kind}, total int, elements binary, places binary, beyond binary, sketch binary")
    n_groups = int(sum(s for s, n in zip(shards, postings, strict=True) if n))
    met = dealt.repartition(2 * n_groups + 1, "group").groupBy("group").applyInArrow(meet, f"a {kind}, b {kind}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hashes(words: Column) -> Column:
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def sent(rows: DataFrame) -> DataFrame:
    """A counted list, sent to every task unless it is long."""
    return F.broadcast(rows) if rows.count() <= ROWS_SENT else rows


def _compared(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """(a, b, dice) of the pairs (a, b) of a cell's documents (doc, words)."""
    lists = docs["words"].combine_chunks()
    lens = pc.list_value_length(lists).to_numpy()
    row = np.repeat(np.arange(len(lens)), lens)
    word = np.asarray(lists.flatten().dictionary_encode().indices).astype(np.int64)
    o = np.lexsort((word, row))
    row, word, at = row[o], word[o], np.arange(len(o))
    begins = np.ones(len(o), bool)
    begins[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    e = np.unique(word << 32 | at - np.maximum.accumulate(np.where(begins, at, 0)), return_inverse=True)[1]
    ends = np.cumsum(lens)
    of = [e[k - n : k] for k, n in zip(ends.tolist(), lens.tolist(), strict=True)]
    a, b = (pc.index_in(pairs[s].combine_chunks(), docs["doc"].combine_chunks()).to_numpy() for s in ("a", "b"))
    o = np.argsort(a, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, a[o][1:] != a[o][:-1])), len(o)).tolist()
    has, shared = np.zeros(len(e) + 1, bool), np.zeros(len(a), np.int64)
    for i, k in zip(cuts[:-1], cuts[1:], strict=True):
        own = of[a[o[i]]]
        has[own] = True
        upto = np.append(0, np.cumsum(has[np.concatenate([of[y] for y in b[o[i:k]]])]))
        last = np.cumsum(lens[b[o[i:k]]])
        shared[o[i:k]] = upto[last] - upto[last - lens[b[o[i:k]]]]
        has[own] = False
    total = lens[a].astype(np.int64) + lens[b]
    return pa.table({"a": pairs["a"], "b": pairs["b"], "dice": np.where(total == 0, 1.0, 2 * shared / np.maximum(total, 1))})


def dice_within_cells(pairs: DataFrame, docs: DataFrame, words: Callable[[Column], Column], written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(a, b, dice) for each pair (a, b), a < b, from texts (doc, text), an id once: a text goes to a cell once, not to each of its pairs.

    A pair stands where the first document that is paired with its a does, so that a group whose members are all near one
    another is in one place. Small groups share a cell; large ones are cut into blocks, a cell for each two of them.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    lead = written(pairs.groupBy("b").agg(F.min("a").alias("lead")), "leads")
    led = written(pairs.join(sent(lead.withColumnRenamed("b", "a")), "a", "left").select("a", "b", F.coalesce("lead", "a").alias("lead")), "led")
    n_cells = lead.count() // DOCS + 1
    large = led.groupBy("lead").agg(F.count_distinct("b").alias("n")).where(F.col("n") > BLOCK).select("lead", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    of = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = led.join(sent(written(large, "large")), "lead", "left").select("a", "b", of("lead", F.lit(n_cells)).alias("cell"), of("a", blocks).alias("i"), of("b", blocks).alias("k"))
    cell = ["cell", "i", "k"]
    placed = written(placed, "placed")
    members = written(placed.select(*cell, F.explode(F.array("a", "b")).alias("doc")).distinct(), "members")
    dealt = docs.join(sent(members), "doc").select(*cell, "doc", "text").repartition(n_cells, *cell)
    texts = dealt.select(*cell, "doc", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    both = texts.groupBy(*cell).cogroup(placed.repartition(n_cells, *cell).groupBy(*cell))
    return both.applyInArrow(_compared, f"a {kind}, b {kind}, dice double")
