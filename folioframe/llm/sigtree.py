"""N-gram Jaccard join: exact links of 80 % and their components, with signature trees in blocks.

Texts become sets of hashed five-word shingles; equal sets are one class from then on. Two sets of similarity 0.8
share one of the first |s| - ceil(0.8 |s|) + 1 shingles of each in any one order of all shingles (prefix filter), so
sets that share such a shingle form a block, and no link lies outside the blocks. The order puts shingles that are
frequent in a bounded sample last; that choice changes only the sizes of blocks.

Within a block, sets are the leaves of signature trees. A node holds the OR of its sets' token bitmaps, their range
of sizes and the most tokens that one set has on one bit. Two nodes are traversed together unless the overlap that
bitmaps and sizes allow is too small. Bitmaps are of at least twice as many bits as the set has shingles, a power
of two; a block has a tree for each width, and the trees of neighbouring widths are traversed together over bitmaps
folded to the smaller one (sets of farther widths differ too much in size). Pairs that remain are compared over their
whole sets.

Large groups of near copies never make all their pairs: sets are first linked with the smallest set of the same
minimal hash, and only blocks of several components go on. Blocks of more than ``TILE`` sets are dealt out as tiles,
so that no task holds more than two tiles of one block. The trees of a tile give clusters of sets that they connect
over several components; whole sets go to those clusters only, and each gives the accepted links that connect its
sets, at most one fewer than those. Shingles of one block alone are joined back, after their counts have been combined
in the tasks; of shingles that stand in the same sets one is enough. Keys of many rows are dealt out over tasks.

Hashes are of 64 bits: two given shingles are confused with a chance of 2**-64.

Rows: null texts, and texts without words, have no shingles and are linked with nothing. Texts of fewer than five
words are one shingle. A row with a null id has a null component. Repeated rows give repeated rows. Where an id stands
for several texts, each row has the component of its own text. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from folioframe.llm.graph import components
from folioframe.llm.hashing import LOWER, mixed, window_hashes, word_hashes, word_spans
from folioframe.llm.shared import Tables, blocks, join_counted, sized

WIDTH, PERCENT = 5, 80
#: Rows of the sample that shows which shingles are frequent, and in how many of them those are.
SAMPLE_ROWS, SAMPLE_OFTEN = 4000, 5
#: Bits of a signature for each shingle and at least, sets under a node, sets of a block in one tile, minimal hashes
#: that link a set to another.
SPARSE, LEAST_BITS, FAN, TILE, STARS = 2, 256, 16, 2048, 4
#: Shingles of a tile, which bound its memory where sets are large.
TILE_SHINGLES = 4_000_000
#: Bytes of text that are shingled together.
BYTES = 1 << 18

IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def _shingles(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    words = word_hashes(data, starts, ends)
    runs = window_hashes(words, WIDTH)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(runs[a : b - WIDTH + 1] if b - a >= WIDTH else window_hashes(words[a:b], b - a) if b > a else runs[:0])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def tokens(docs: DataFrame) -> DataFrame:
    """(id, key, tokens) of each row of docs (id, text): a digest of its set, and all its hashes, ascending unsigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("text"), BYTES):
                sets = list(_shingles(data, offsets))
                keys = [xxh3_128_digest(u.tobytes()) for u in sets]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(keys, pa.binary()), _lists(sets)], ["id", "key", "tokens"])

    return docs.mapInArrow(run, "id bigint, key binary, tokens array<bigint>")


def signature(u: np.ndarray) -> tuple[bytes, int]:
    """The bitmap of a set, and the most tokens on one bit; folding a bitmap in halves gives that of fewer bits."""
    bits = max(LEAST_BITS, 1 << int(SPARSE * len(u) - 1).bit_length()) if len(u) else LEAST_BITS
    at = (u >> np.uint64(20)).astype(np.int64) & (bits - 1)
    count = np.bincount(at, minlength=bits)
    return np.packbits(count > 0, bitorder="little").tobytes(), int(count.max(initial=0))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) OR-ed down to ``words`` words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def summaries(docs: DataFrame, frequent: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(id, of, n, key, prefix, stars, bits, heap) of each row (id, of, text): what blocks and trees need of its set."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = sent.value
        turns = np.arange(1, STARS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("text"), BYTES):
                sizes, keys, prefixes, stars, bits, heaps = [], [], [], [], [], []
                for u in _shingles(data, offsets):
                    n = len(u)
                    common = np.isin(u, last, assume_unique=True) if len(last) and n else np.zeros(n, bool)
                    rare = u[~common]
                    prefixes.append(np.concatenate([rare, u[common]])[: n - -(-percent * n // 100) + 1 if n else 0])
                    stars.append(np.array([mixed(u ^ t).min() for t in turns], np.uint64) if n else u)
                    b, heap = signature(u)
                    sizes.append(n)
                    keys.append(xxh3_128_digest(u.tobytes()))
                    bits.append(b)
                    heaps.append(heap)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), batch.column("of").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(prefixes), _lists(stars), pa.array(bits, pa.binary()), pa.array(heaps, pa.int32())],
                    ["id", "of", "n", "key", "prefix", "stars", "bits", "heap"],
                )

    return docs.mapInArrow(run, "id bigint, of bigint, n bigint, key binary, prefix array<bigint>, stars array<bigint>, bits binary, heap int")


def whole_sets(nodes: DataFrame, heads: DataFrame, docs: DataFrame, own: Tables) -> DataFrame:
    """(node, tokens): the whole set of each of ``nodes`` (node), made again from the text of its head."""
    wanted = own.stash(heads.select("node", "id", "key").join(sized(nodes), "node", "left_semi"), "wanted")
    some = tokens(docs.join(sized(wanted.select("id").distinct()), "id", "left_semi"))
    return own.stash(some.join(wanted, ["id", "key"]).select("node", "tokens"), "whole-sets")


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, own: Tables, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets are similar enough; an ``a`` of many pairs is dealt out."""
    pairs = own.stash(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sets = whole_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), heads, docs, own)
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).join(sets.toDF("a", "of_a"), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    both = join_counted(pairs.join(sets.toDF("b", "of_b"), "b"), hubs, ["a"], F.col("b"))
    return both.where(shared * (100 + percent) >= (F.size("of_a") + F.size("of_b")) * percent).select("a", "b").distinct()


class Tree:
    """A signature tree over sets in order of size: levels of (bitmaps, smallest size, largest size, most on a bit)."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, heap: np.ndarray) -> None:
        self.levels = [(bits, n, n, heap)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, heap = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(heap, at)))

    def under(self, level: int, i: int) -> np.ndarray:
        return np.arange(i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][1])))


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, leaves: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of nodes i of level x, and j of y) that may hold sets similar enough."""
    bits_x, low_x, high_x, heap_x = (v[i] for v in x)
    bits_y, low_y, high_y, heap_y = (v[j] for v in y)
    both = np.bitwise_count(bits_x[:, None] & bits_y[None]).sum(2, dtype=np.int64)
    if leaves:  # every bit of one alone is a token that the other lacks
        most = np.minimum((low_x - np.bitwise_count(bits_x).sum(1, dtype=np.int64))[:, None], (low_y - np.bitwise_count(bits_y).sum(1, dtype=np.int64))[None]) + both
        ok = most * (100 + percent) >= (low_x[:, None] + low_y[None]) * percent
    else:
        most = np.minimum(np.minimum(high_x[:, None], high_y[None]), both * np.minimum(heap_x[:, None], heap_y[None]))
        ok = most * 100 >= np.maximum(low_x[:, None], low_y[None]) * percent
    a, b = np.nonzero(ok)
    return i[a], j[b]


def close(one: Tree, other: Tree | None, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of leaf pairs that may be similar, within one tree (other: None) or between two."""
    two = other or one
    todo = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while todo:
        p, i, q, j = todo.pop()
        down_p, down_q = p >= q and p > 0, q >= p and q > 0
        a = one.under(p, i) if down_p else np.array([i])
        b = two.under(q, j) if down_q else np.array([j])
        p, q = p - down_p, q - down_q
        a, b = possible(one.levels[p], a, two.levels[q], b, p == q == 0, percent)
        if other is None and p == q:
            a, b = (a[a < b], b[a < b]) if p == 0 else (a[a <= b], b[a <= b])
        if p == q == 0:
            if len(a):
                yield a, b
        else:
            todo += [(p, x, q, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def near_leaves(side: np.ndarray, n: np.ndarray, bits: list[bytes], heap: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one tile that may be similar: within it (side 0), or between its sides 1 and 2."""
    width = np.array([len(b) // 8 for b in bits])
    trees: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for s in np.unique(side).tolist():
        for w in np.unique(width).tolist():
            rows = np.flatnonzero((side == s) & (width == w))
            if len(rows):
                rows = rows[np.argsort(n[rows], kind="stable")]
                trees[s, w] = rows, np.frombuffer(b"".join([bits[k] for k in rows]), np.uint64).reshape(len(rows), w)

    def tree(s: int, w: int, to: int) -> tuple[np.ndarray, Tree]:
        rows, own = trees[s, w]
        return rows, Tree(n[rows], folded(own, to), heap[rows] * (w // to))  # a folded bit holds what two bits held at most

    for s, w in trees:
        for t, v in trees:
            if (s, t) not in ((0, 0), (1, 2)) or v > 2 * w or w > 2 * v or s == t and w > v:
                continue
            rows, one = tree(s, w, min(w, v))
            others, two = (rows, None) if (s, w) == (t, v) else tree(t, v, min(w, v))
            for a, b in close(one, two, percent):
                yield rows[a], others[b]


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Unite the groups of a[i] and b[i] in ``root`` (each row's smallest member); the pairs that were needed for it."""
    used = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = root[x], root[y]
        if p != q:
            root[root == max(p, q)] = min(p, q)
            used.append(i)
    return used


def plausible(pairs: DataFrame, heads: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) that bitmaps and sizes allow."""
    one = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).join(heads.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    two = heads.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ba", "bb")), strict=True):
                x, y = (np.frombuffer(v, np.uint64)[None] for v in (x, y))
                words = min(x.shape[1], y.shape[1])
                x, y = folded(x, words), folded(y, words)
                lone = min(na - int(np.bitwise_count(x).sum()), nb - int(np.bitwise_count(y).sum()))
                keep.append((lone + int(np.bitwise_count(x & y).sum())) * (100 + percent) >= (na + nb) * percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return join_counted(pairs.join(two, "b"), one, ["a"], F.col("b")).mapInArrow(run, "a bigint, b bigint")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys, which stand together, as one batch each; such a run may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        last = [batch.column(k)[len(batch) - 1].as_py() for k in keys]
        if all(held[0].column(k)[0].as_py() == x for k, x in zip(keys, last, strict=True)):
            continue  # one run so far
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        differs = np.zeros(len(whole), bool)
        for k in keys:
            codes = whole.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            differs[1:] |= codes[1:] != codes[:-1]
        edges = [0, *np.flatnonzero(differs).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield whole.slice(a, b - a)
        held = [whole.slice(edges[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def clusters(tiles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cluster, node): sets of a tile that the trees connect over several components, and that are to be compared.

    ``tiles`` (token, tile, side, node, comp, n, bits, heap) stand together. A set stands in one cluster of a tile at
    most, so that the rows are no more than those of the tiles, however many pairs the trees leave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in _runs(batches, ["token", "tile"]):
            side, nodes, comp, n, heap = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "node", "comp", "n", "heap"))
            if len(nodes) < 2 or side[0] and (side == side[0]).all() or (comp == comp[0]).all():
                continue
            root = np.arange(len(nodes))
            for a, b in near_leaves(side, n, batch.column("bits").to_pylist(), heap, percent):
                far = (comp[a] != comp[b]) & (root[a] != root[b])
                merged(root, a[far], b[far])
            for r in np.flatnonzero(np.bincount(root, minlength=len(root)) > 1).tolist():
                some = np.unique(nodes[root == r])
                key = xxh3_128_digest(some.tobytes())
                if len(some) > 1 and key not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.binary()), pa.array(some, pa.int64())], ["cluster", "node"])

    return tiles.mapInArrow(run, "cluster binary, node bigint")


def _spanning(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect what can be connected: at most one fewer than there are sets."""
    m = len(sets)
    bits, heap = zip(*(signature(u) for u in sets), strict=True)
    n = np.array([len(u) for u in sets])
    at = np.concatenate([[0], np.cumsum(n)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.zeros(int(ids.max(initial=0)) + 1, bool)
    first = np.unique(comp, return_index=True, return_inverse=True)
    root = first[1][first[2]]
    out = []
    for a, b in near_leaves(np.zeros(m, np.int64), n, list(bits), np.array(heap), percent):
        far = root[a] != root[b]
        a, b = a[far], b[far]
        for x in np.unique(a).tolist():
            others = b[(a == x) & (root[b] != root[x])]
            if not len(others):
                continue
            own = ids[at[x] : at[x + 1]]
            held[own] = True
            both = np.array([np.count_nonzero(held[ids[at[y] : at[y + 1]]]) for y in others.tolist()])
            held[own] = False
            alike = others[both * (100 + percent) >= (n[x] + n[others]) * percent]
            out += [(x, int(alike[k])) for k in merged(root, np.full(len(alike), x), alike)]
    return out


def spanning_links(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): accepted links of clusters (cluster, node, comp, tokens) that stand together, no more than connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, ["cluster"]):
            nodes, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp"))
            rows = batch.column("tokens")
            flat, at = rows.values.to_numpy(zero_copy_only=False).view(np.uint64), rows.offsets.to_numpy()
            one = np.unique(nodes, return_index=True)[1]  # rows that repeat an id and text repeat their node
            sets = [flat[at[k] : at[k + 1]] for k in one.tolist()]
            pairs = _spanning(sets, comp[one], percent)
            a, b = (np.array([nodes[one[p[k]]] for p in pairs], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return members.mapInArrow(run, "a bigint, b bigint")


def _noded(some: DataFrame, classes: DataFrame, own: Tables) -> DataFrame:
    """``some`` (id, key, ..) with ``node``, a number for each class of equal sets.

    It is the smallest id of the class, or, where an id is the smallest of several classes (an id that stands for
    different texts), a hash of the class's digest.
    """
    twice = classes.groupBy("low").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("low")
    clash = own.stash(classes.join(twice, "low").select("key", F.xxhash64("key").alias("apart")), "clashes")
    return some.join(sized(clash), "key", "left").withColumn("node", F.coalesce("apart", "id")).drop("apart")


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return linked(docs, text, doc_id, percent).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component) of every row.

    The hash tells texts of one id apart, and the last column components of one smallest id; it is null without shingles.
    """
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(body).alias("of"), body.alias("text"))
    every = max(1, rows.count() // SAMPLE_ROWS)
    sample = tokens(rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).select("tokens").distinct()
    often = sample.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLE_OFTEN)
    frequent = np.array([r["t"] for r in often.select("t").toLocalIterator()], np.int64).view(np.uint64)  # bounded by the sample
    with Tables() as own:
        return _joined(rows, frequent, percent, own)


def _joined(rows: DataFrame, frequent: np.ndarray, percent: int, own: Tables) -> DataFrame:
    base = own.stash(summaries(rows, frequent, percent), "sets")
    some = base.where("n > 0 AND id IS NOT NULL")
    classes = own.stash(some.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("k")), "classes")
    twins = join_counted(some.select("id", "key"), classes.where("k > 1"), ["key"], F.col("id"))
    others = own.stash(twins.where("id <> low").select("id", "key").distinct(), "copies")
    heads = _noded(some.join(sized(others), ["id", "key"], "left_anti"), classes, own)

    star = own.stash(heads.select("node", F.posexplode("stars").alias("turn", "star")), "stars")
    first = own.stash(star.groupBy("turn", "star").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1"), "star-heads")
    starred = own.stash(join_counted(star, first, ["turn", "star"], F.col("node")).where("node <> a").select("a", F.col("node").alias("b")).distinct(), "starred")
    stars = own.stash(verified(plausible(starred, heads, percent), heads, rows, own, percent), "star-links")
    label = components(stars).toDF("node", "comp")

    postings = heads.select("node", "n", "prefix").join(label, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"), F.explode("prefix").alias("token"))
    # two sums of hashes tell blocks of different members apart
    member = lambda seed: F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(seed)), 24))
    found = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), member(1).alias("m1"), member(2).alias("m2"))
    mixed_tokens = own.stash(found.where("low <> high").groupBy("k", "size", "m1", "m2").agg(F.min("token").alias("token")).select("token", F.ceil(F.greatest(F.col("k") / TILE, F.col("size") / TILE_SHINGLES)).cast("int").alias("parts")), "blocks")
    placed = postings.join(sized(mixed_tokens), "token")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = (
        placed.withColumn("mine", mine)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("token", (F.least("mine", "with") * F.col("parts") + F.greatest("mine", "with")).alias("tile"), F.when(F.col("mine") == F.col("with"), 0).when(F.col("mine") < F.col("with"), 1).otherwise(2).alias("side"), "node", "comp", "n")
        .join(heads.select("node", "bits", "heap"), "node")
        .repartition("token", "tile")
        .sortWithinPartitions("token", "tile")
    )
    near = own.stash(clusters(tiles, percent).distinct(), "clusters")
    sets = whole_sets(near.select("node").distinct(), heads, rows, own)
    told = sets.join(label, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "tokens")
    links = spanning_links(near.join(told, "node").repartition("cluster").sortWithinPartitions("cluster"), percent)
    final = components(own.stash(stars.union(links), "links")).toDF("node", "component")

    # components by their smallest id, which is their smallest node unless an id stands for several texts
    named = _noded(classes.withColumnRenamed("low", "id"), classes.select("key", "low"), own).select("key", "id", "node", "k").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = own.stash(named, "named")
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    ids = base.select("id", "of", "n", "key")
    of_class = join_counted(named, smallest, ["component"], F.col("node"), "m").select("key", "component_id", "component", "k")
    out = join_counted(ids.where("n > 0 AND id IS NOT NULL"), of_class, ["key"], F.col("id")).select(F.col("id").alias("doc_id"), F.col("of").alias("text_hash"), F.col("n").alias("n_shingles"), "component_id", "component")
    alone = ids.where("n = 0 OR id IS NULL").select(F.col("id").alias("doc_id"), F.col("of").alias("text_hash"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("bigint").alias("component"))
    return own.keep(out.unionByName(alone), "components")


def distinct(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with their columns, of one document of each component: that of the smallest id.

    Rows that repeat an id and text count as one document and stay together; where the smallest id stands for several
    texts of a component, one of those stays. Rows with a null id stay.
    """
    with Tables() as own:
        found = own.stash(linked(docs, text, doc_id, percent).where("doc_id IS NOT NULL AND n_shingles > 0").drop("n_shingles"), "linked")
        heads = found.where("doc_id = component_id").groupBy("component", "doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
        several = own.stash(heads.where("low <> high").select("component", "doc_id", "low"), "several")
        beside = found.join(sized(several), ["component", "doc_id"]).where("text_hash <> low").select("doc_id", "text_hash")
        gone = own.keep(found.where("doc_id <> component_id").select("doc_id", "text_hash").union(beside).distinct(), "gone")
    # names that no column of docs can have meet in the join
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    return packed.join(sized(gone), ["doc_id", "text_hash"], "left_anti").select("row.*")


SQL = """
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
    FROM w
), c AS (
    SELECT min(doc_id) AS cid, len(sh) AS n, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY ALL
), t AS (
    SELECT cid, n, unnest(sh) AS g FROM c
), rare AS (
    SELECT t.cid, t.n, t.g FROM t WHERE g IN (SELECT g FROM t GROUP BY g HAVING count(*) > 1)
), p AS (
    SELECT a.cid AS a, b.cid AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM rare a JOIN rare b ON a.g = b.g AND a.cid < b.cid GROUP BY 1, 2
), e AS (
    SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)
), g AS (
    SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (
    WITH RECURSIVE r(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a) SELECT * FROM r
), m AS (
    SELECT a AS cid, least(a, min(b)) AS component FROM reach GROUP BY a
), d AS (
    SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.cid FROM s LEFT JOIN c ON len(s.sh) > 0 AND c.sh = list_sort(s.sh)
)
SELECT doc_id, n_shingles, coalesce(m.component, d.cid, doc_id) AS component_id FROM d LEFT JOIN m ON m.cid = d.cid
"""
