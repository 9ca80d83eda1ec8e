"""Benchmark decontamination: Wu-Manber search for many word windows at once.

The alphabet is words. Every run of ``window`` words of a benchmark item (the whole item where it is shorter) is a
pattern; patterns of one length are searched together. For that length, a shift table over hashed blocks of two
words says how far a search may jump without missing a pattern. Where it says zero, the hash of the last block selects
a bucket and the hash of the first block the patterns of that bucket which may stand there; those are compared with
the text byte by byte. The texts of a block are searched side by side in lanes, so that each jump is one step of an
array for all lanes.

Rows: null text has no words. Texts without words, empty tables, null ids and repeated rows give rows like any other,
however many shards there are. Only the id and text columns are read, so further columns can't clash. The patterns are
gathered on the driver in shards of about ``SHARD_WORDS`` words; no more than two shards are held there and one is sent
to a task, however large the benchmark. Each shard is one pass over the texts, which gives the rows with spans only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.hashing import LOWER, mixed, window_hashes, word_hashes, word_spans
from folioframe.llm.shared import Tables, blocks

#: Words of benchmark items in one pass.
SHARD_WORDS = 2_000_000
#: Words of a lane; lanes overlap by the pattern length less one.
LANE = 1024
_TABLE = 1 << 20

#: Letters and digits of ASCII, and all that isn't ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Patterns:
    """Search tables for patterns of one length in words, over the words of the items that hold them."""

    def __init__(self, length: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, items: np.ndarray) -> None:
        """data: lower-case words joined by single blanks; starts, ends: of the words; first: each run's first word, and the end; items: the run's item number."""
        self.length, self.block, self.data = length, min(2, length), data
        words = word_hashes(data, starts, ends)
        blocks_of = window_hashes(words, self.block)
        n = np.maximum(0, np.diff(first) - length + 1)
        heads = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())  # each pattern's first word
        self.shift = np.full(_TABLE, length - self.block + 1, np.uint8 if length < 200 else np.int32)
        for k in range(length - self.block + 1):  # blocks nearer the end allow shorter jumps
            np.minimum.at(self.shift, self.slot(blocks_of[heads + k]), length - self.block - k)
        suffix, prefix = blocks_of[heads + length - self.block], blocks_of[heads]
        pair = mixed(suffix * np.uint64(31) + prefix)
        order = np.argsort(pair, kind="stable")
        #: The last blocks that patterns have; and the patterns by their last and first block.
        self.suffixes, self.pairs = np.unique(suffix), pair[order]
        self.starts, self.ends, self.items = starts[heads[order]], ends[heads[order] + length - 1], np.repeat(items, n)[order]

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(_TABLE - 1)).astype(np.int64)

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of a window's last word, first and end of the patterns to compare there)."""
        m, nothing = self.length, np.zeros(0, np.int64)
        lens = np.diff(first)
        n_lanes = np.maximum(0, -(-(lens - m + 1) // LANE))
        if not n_lanes.sum():
            return nothing, nothing, nothing
        text = np.repeat(np.arange(len(lens)), n_lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        at = first[text] + nth * LANE + m - 1  # the position of a window's last word
        stop = np.minimum(first[text + 1], at + LANE)
        blocks_of = window_hashes(words, self.block)
        jump = self.shift[self.slot(blocks_of)]  # of the block that ends block-1 words on
        found = []
        while len(at):
            by = jump[at - self.block + 1].astype(np.int64)
            found.append(at[by == 0])
            at = at + np.maximum(by, 1)
            keep = at < stop
            at, stop = at[keep], stop[keep]
        ends = np.concatenate(found)
        suffix = blocks_of[ends - self.block + 1]
        bucket = np.searchsorted(self.suffixes, suffix)  # the hash of the last block selects a bucket
        bucket[bucket == len(self.suffixes)] = 0
        filled = self.suffixes[bucket] == suffix
        ends, suffix = ends[filled], suffix[filled]
        pair = mixed(suffix * np.uint64(31) + blocks_of[ends - m + 1])  # and the first block those of its patterns
        low, high = np.searchsorted(self.pairs, pair), np.searchsorted(self.pairs, pair, side="right")
        return ends[low < high], low[low < high], high[low < high]

    def equal(self, low: int, high: int, text: bytes) -> list[int]:
        """Items of those patterns, from low up to high, that equal ``text``, compared byte by byte."""
        some = (k for k in range(low, high) if self.ends[k] - self.starts[k] == len(text))
        return sorted({int(self.items[k]) for k in some if self.data[self.starts[k] : self.ends[k]].tobytes() == text})


def item_patterns(items: list[bytes], window: int) -> list[Patterns]:
    """Search tables, one for each length, for the texts of a shard."""
    by_length: dict[int, list[tuple[int, list[bytes]]]] = {}
    for number, text in enumerate(items):
        raw = np.frombuffer(text, np.uint8)
        starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), IS_WORD)
        low = LOWER[raw].tobytes()
        if len(starts):
            by_length.setdefault(min(window, len(starts)), []).append((number, [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
    out = []
    for length, some in sorted(by_length.items()):
        words = [w for _, of in some for w in of]
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        first = np.concatenate([[0], np.cumsum([len(of) for _, of in some])])
        out.append(Patterns(length, np.frombuffer(b" ".join(words), np.uint8), starts, ends, first, np.array([number for number, _ in some])))
    return out


#: A shard: item ids, and their search tables.
Shard = tuple[list[str], list[Patterns]]


def shards(items: DataFrame, window: int, text: str, item_id: str, words: int) -> Iterator[Shard]:
    """The benchmark in shards of about ``words`` words, read row by row: one of them is held at a time."""
    wanted = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    ids, texts, size = [], [], 0
    for row in wanted.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"].encode())
        size += len(row["text"].split()) + 1
        if size >= words:
            yield ids, item_patterns(texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield ids, item_patterns(texts, window)


def occurrences(shard: Shard, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[list[dict]]]]:
    """Rows in runs: (first, end, their numbers of words, their spans in order)."""
    ids, tables = shard
    for i, j, data, offsets in blocks(column):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, IS_WORD)
        words = word_hashes(data, starts, ends)
        found: list[list[dict]] = [[] for _ in range(i, j)]
        for p in tables:
            for last, low, high in zip(*(x.tolist() for x in p.search(words, first)), strict=True):
                a = last - p.length + 1
                of = p.equal(low, high, b" ".join(data[starts[k] : ends[k]].tobytes() for k in range(a, last + 1)))
                if of:
                    d = int(np.searchsorted(first, a, side="right")) - 1
                    found[d].append({"start": a - int(first[d]), "end": last + 1 - int(first[d]), "items": [ids[x] for x in of]})
        for x in found:
            x.sort(key=lambda s: (s["start"], s["end"]))
        yield i, j, np.diff(first), found


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("items", pa.list_(pa.string()))]))
SPANS_SQL = "array<struct<start:bigint,end:bigint,items:array<string>>>"


def _one_or_more(found: Iterator[Shard]) -> tuple[Shard, Iterator[Shard] | None]:
    """The first shard, and all of them where there are more."""
    one = next(found, ([], []))
    two = next(found, None)
    return one, None if two is None else itertools.chain([one, two], found)


def _passes(numbered: DataFrame, some: Iterator[Shard], own: Tables) -> DataFrame:
    """(row, spans) of the rows (row, text) with spans, from one pass over them for each shard."""
    spark, parts = numbered.sparkSession, []
    for shard in some:
        sent = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, _, found in occurrences(sent.value, batch.column("text")):
                    whole = pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(found, SPANS)], ["row", "spans"])
                    yield whole.filter(pa.array([bool(x) for x in found]))

        parts.append(own.stash(numbered.mapInArrow(run, f"row bigint, spans {SPANS_SQL}"), "spans"))
        sent.destroy()
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def hits(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, spans): for each document the word spans <start, end, items> of benchmark windows, in order.

    ``items`` of a span are item ids as strings.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    one, more = _one_or_more(shards(items, window, item_text, item_id, shard_words))
    with Tables() as own:
        if more is not None:  # rows are numbered and written once, so that each of them meets its own spans again
            rows = own.keep(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
            spans = own.keep(_passes(rows.select("row", "text"), more, own), "spans")
            counted = _searched(rows.select("doc_id", "row", "text"), ([], []), f"doc_id {kind}, row bigint, n_words bigint, spans {SPANS_SQL}")
            told = counted.withColumnRenamed("spans", "none").join(spans, "row", "left")
            return told.select("doc_id", "n_words", F.coalesce("spans", "none").alias("spans"))
        return _searched(rows, one, f"doc_id {kind}, n_words bigint, spans {SPANS_SQL}")


def _searched(rows: DataFrame, shard: Shard, schema: str) -> DataFrame:
    """The columns of ``rows`` but text, their numbers of words and the spans of one shard."""
    sent = rows.sparkSession.sparkContext.broadcast(shard)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, n_words, found in occurrences(sent.value, batch.column("text")):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n_words, pa.int64()), pa.array(found, SPANS)], [*kept, "n_words", "spans"])

    return rows.mapInArrow(run, schema)


def without(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of ``docs``, with their columns, in which no window occurs; each row is judged by its own text."""
    one, more = _one_or_more(shards(items, window, item_text, item_id, shard_words))
    with Tables() as own:
        if more is not None:
            packed = own.keep(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("of"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")
            dirty = own.keep(_passes(packed.select("row", "text"), more, own).select("row"), "dirty")
            return packed.join(dirty, "row", "left_anti").select("of.*")
    sent = docs.sparkSession.sparkContext.broadcast(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, found in occurrences(sent.value, batch.column(text).cast(pa.string())):
                yield batch.slice(i, j - i).filter(pa.array([not x for x in found]))

    return docs.mapInArrow(run, docs.schema)


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what ``hits`` gives, in built-in functions."""
    items = F.array_sort(F.array_distinct(F.flatten(F.col("spans.items"))))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["reach"]))).alias("n"),
            F.greatest(acc["reach"], s["end"]).alias("reach"),
        ),
        lambda acc: acc["n"],
    )
    return (
        found.withColumn("n_hit", merged)
        .withColumn("item_ids", items)
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("item_ids").cast("long").alias("n_items"),
            F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )
