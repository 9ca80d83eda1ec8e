"""The prefix trie of conversations: what turns they share from their first on, and what sharing them would save.

Every conversation is first rebuilt (``rebuild``) as a row for each turn: digest, place and length; texts stay behind.
Turns are cut into segments of ``SEGMENT`` places, so that a conversation of any length is rows of bounded size; equal
segments after equal beginnings are counted before they are sent on. The segments, sorted by beginning and turns, are
cut into shards of bounded size. Each shard packs a double-array trie: its turns have dense ids, and the child of
state s by turn t is ``BASE[s] + t`` where ``CHECK`` of that names s. Traversing all its segments gives the
aggregates of its nodes, by the node's key: the xor of a 128-bit hash of each turn and place on the way to it.

All aggregates are sums or minima, so that the upper nodes that several shards share are merged by one grouping.
What two neighbouring shards both count of a shared node (its length, the child on the way to both, an end that the
next shard continues) is known from the last segment of the one and the first of the other, and is taken off again.
Tries of later segments come first, and give what hangs below the ends of earlier ones: a round for every ``SEGMENT``
turns of the longest conversation.

Nulls: rows without a conversation id are no conversation; a null role or text is empty, a null turn comes first.
Turns of one number are ordered by their digest; repeated rows are turns of their own. An empty table has no nodes.
Further columns are not read. The ids that end at a node are joined in a stream, of which a task holds
``2 ** ID_BITS`` at most; a node of very many ends is one task's stream, as one digest covers them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.merkle import CRC32_SQL
from folioframe.llm.ranks import sort_rows, with_ranks
from folioframe.llm.shared import Tables, join_counted

#: Turns of a segment, and of a shard.
SEGMENT, SHARD = 4096, 1 << 18
#: Ids whose decimal texts are joined before they are streamed: those of one range of 2 ** ID_BITS.
ID_BITS = 12
#: Conversations take over at most this many turns less one of their base, the first of each ``BASES``.
HEADS, BASES = 6, 100

_SUMS = ["n", "all_chars", "own_chars", "leaves", "children"]
_NODE = f"depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv_id bigint, {', '.join(f'{c} bigint' for c in _SUMS)}"
_EDGE = "pid bigint, s1 bigint, s2 bigint, first binary, first_z binary, first_lens array<bigint>, l1 bigint, l2 bigint, last binary"


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits that tell turns apart by role and text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def heads(conv_id: Column) -> Column:
    """How many turns of its base a conversation takes over at most."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def rebuild(conversations: DataFrame, own: Tables) -> DataFrame:
    """(conv_id, pos, d, len) of every rebuilt conversation; each has a row of place 0 besides, without a digest."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("d"), F.coalesce(F.length("text"), F.lit(0)).alias("len"))
    rows, pieces = sort_rows(own.stash(turns, "turns"), ["conv_id"], ["turn", "d"], own)
    ranked = own.stash(with_ranks(rows, pieces, ["conv_id"]).select("conv_id", (F.col("rank") + 1).alias("pos"), "d", "len"), "ranked")
    h = heads(F.col("conv_id"))
    convs = own.stash(pieces.groupBy("conv_id").agg(F.max("n").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASES).alias("base")), "conversations")
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = own.stash(convs.join(bases, "base", "left").select("conv_id", "n", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")), "taken")
    first = ranked.where((F.col("pos") < HEADS) & (F.col("conv_id") % BASES == 0)).withColumnRenamed("conv_id", "base")
    over = convs.join(first, "base").where(F.col("pos") <= F.col("taken")).select("conv_id", "pos", "d", "len")
    kept = join_counted(ranked, convs, ["conv_id"], F.col("pos"), "n").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d", "len")
    roots = convs.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("d"), F.lit(0).alias("len"))
    return over.union(kept).union(roots)


def segments(rebuilt: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, s1, s2, e1, e2, path, z, lens): turns of each segment, and the keys before and after it.

    path and z hold 16 bytes a turn: its digest, and the hash of digest and place that node keys are made of.
    """
    at = F.col("pos") > 0
    z1, z2 = F.xxhash64("d", "pos"), F.xxhash64("pos", "d", F.lit(1))
    turn = F.when(at, F.struct("pos", "d", F.concat(F.lpad(F.hex(z1), 16, "0"), F.lpad(F.hex(z2), 16, "0")).alias("z"), "len"))
    seg = F.greatest((F.col("pos") - 1), F.lit(0)) / segment
    rows = rebuilt.groupBy("conv_id", F.floor(seg).alias("seg")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), *(F.coalesce(F.bit_xor(F.when(at, z)), F.lit(0)).alias(name) for z, name in ((z1, "x1"), (z2, "x2")))
    )
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    start = [F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(s) for x, s in (("x1", "s1"), ("x2", "s2"))]
    packed = [F.unhex(F.array_join(F.col(f"turns.{c}"), "")).alias(name) for c, name in (("d", "path"), ("z", "z"))]
    return rows.select("conv_id", "seg", *start, "x1", "x2", *packed, F.col("turns.len").alias("lens")).withColumns(
        {"e1": F.col("s1").bitwiseXOR(F.col("x1")), "e2": F.col("s2").bitwiseXOR(F.col("x2"))}
    ).drop("x1", "x2")


class DoubleArray:
    """A trie over dense ids in two arrays: the child of state s by id t is ``base[s] + t`` where check names s."""

    def __init__(self, roots: int, ids: int) -> None:
        self.ids, self.top = ids, roots  # states 0 .. roots - 1 are the roots
        self.base, self.check = np.zeros(max(roots, 16), np.int64), np.full(max(roots, 16), -1, np.int64)
        self.taken = np.zeros(len(self.base), bool)
        self.taken[:roots] = True

    def _room(self, top: int) -> None:
        if top > len(self.base):
            more = max(top, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.taken = np.concatenate([self.taken, np.zeros(more, bool)])
        self.top = max(self.top, top)

    def add(self, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """States of new children (parent, id), which are sorted by both and have no children of those parents yet."""
        n = len(parents)
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, n))
        out = np.empty(n, np.int64)
        holes = np.flatnonzero(~self.taken[: self.top])
        for i, m in zip(first[sizes > 1], sizes[sizes > 1], strict=True):  # several ids need places in their distances
            codes, base = ids[i : i + m], None
            for hole in holes[: 32 if m < 64 else 0]:
                places = hole - codes[0] + codes
                if places[-1] < self.top and not self.taken[places].any():
                    base = hole - codes[0]
                    break
            if base is None:
                base = self.top - codes[0]
            places = base + codes
            self._room(int(places[-1]) + 1)
            self.taken[places], out[i : i + m], self.base[parents[i]] = True, places, base
            if len(holes) and places[0] <= holes[-1]:
                holes = holes[~self.taken[holes]]
        one = first[sizes == 1]  # a single id fits any free place
        holes = np.flatnonzero(~self.taken[: self.top])[: len(one)]
        fresh = np.arange(self.top, self.top + len(one) - len(holes))
        places = np.concatenate([holes, fresh])
        self._room(self.top + len(fresh))
        self.taken[places], out[one], self.base[parents[one]] = True, places, places - ids[one]
        self.check[out] = parents
        return out

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of states by ids; -1 where there are none."""
        to = self.base[states] + ids
        inside = (to >= 0) & (to < self.top)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def pack(roots: np.ndarray, n_roots: int, offsets: np.ndarray, ids: np.ndarray, n_ids: int) -> DoubleArray:
    """The trie of sequences: sequence i starts at root ``roots[i]`` and has the ids between its offsets."""
    out, sizes = DoubleArray(n_roots, n_ids), np.diff(offsets)
    states, active, d = roots.astype(np.int64), np.flatnonzero(sizes > 0), 0
    while len(active):
        pair = states[active] * n_ids + ids[offsets[active] + d]
        new, which = np.unique(pair, return_inverse=True)
        states[active] = out.add(new // n_ids, new % n_ids)[which]
        d += 1
        active = active[sizes[active] > d]
    return out


def shard_nodes(start: np.ndarray, offsets: np.ndarray, digests: np.ndarray, z: np.ndarray, lens: np.ndarray, depth: int, members: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Aggregates of the nodes of a shard's trie, roots included.

    start: two keys a sequence; digests: 16 bytes a turn; z: two hashes a turn; members: n and conv_id of each
    sequence, and what hangs below its end (all_chars, own_chars, leaves, children).
    """
    roots, at_root = np.unique(start, axis=0, return_inverse=True)
    at_root = at_root.reshape(-1)
    known, ids = np.unique(digests, return_inverse=True)
    trie = pack(at_root, len(roots), offsets, ids.reshape(-1), max(len(known), 1))

    size, sizes = trie.top, np.diff(offsets)
    node_depth, parent, length = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    keys, conv = np.zeros((size, 2), np.int64), np.full(size, np.iinfo(np.int64).max)
    n, all_chars = np.zeros(size, np.int64), np.zeros(size, np.int64)
    below = {c: np.zeros(size, np.int64) for c in ("own_chars", "leaves", "children")}
    total = np.concatenate([[0], np.cumsum(lens)])

    states, active, d = at_root.astype(np.int64), np.arange(len(sizes)), 0
    now = start.copy()
    node_depth[: len(roots)], keys[: len(roots)] = 0, roots
    order = []
    while len(active):
        at = states[active]
        np.add.at(n, at, members["n"][active])
        np.minimum.at(conv, at, members["conv_id"][active])
        rest = total[offsets[active + 1]] - total[offsets[active] + d - (d > 0)]  # with the node's own length
        np.add.at(all_chars, at, members["n"][active] * rest + members["all_chars"][active])
        order.append(np.unique(at))
        ended = active[sizes[active] == d]
        for c in below:
            np.add.at(below[c], states[ended], members[c][ended])
        active = active[sizes[active] > d]
        if len(active):
            turn = offsets[active] + d
            before = states[active]
            states[active] = trie.step(before, ids[turn])
            now[active] ^= z[turn]
            to = states[active]
            parent[to], keys[to], length[to], node_depth[to] = before, now[active], lens[turn], d + 1
        d += 1
    used = np.concatenate(order)
    inner = used[parent[used] >= 0]
    np.add.at(below["children"], parent[inner], 1)
    below["leaves"][used[below["children"][used] == 0]] = 1
    below["own_chars"][used] += length[used]
    for at in reversed(order[1:]):
        for c in ("own_chars", "leaves"):
            np.add.at(below[c], parent[at], below[c][at])
    up = np.where(parent[used] >= 0, parent[used], used)
    return {
        "depth": node_depth[used] + depth, "k1": keys[used, 0], "k2": keys[used, 1], "p1": keys[up, 0], "p2": keys[up, 1], "conv_id": conv[used],
        "n": n[used], "all_chars": all_chars[used], **{c: below[c][used] for c in ("own_chars", "leaves", "children")},
    }


def overlap(last: tuple[np.ndarray, np.ndarray], first: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], depth: int) -> dict[str, np.ndarray] | None:
    """What to take off the nodes that the last sequence of a shard and the first of the next have in common.

    last: start and digests; first: start, digests, z and lengths.
    """
    if (last[0] != first[0]).any():
        return None
    m = min(len(last[1]), len(first[1]))
    apart = np.flatnonzero(last[1][:m] != first[1][:m])
    q = int(apart[0]) if len(apart) else m
    keys = first[0] ^ np.concatenate([np.zeros((1, 2), np.int64), np.bitwise_xor.accumulate(first[2][:q], axis=0)]) if q else first[0][None, :]
    lens = np.concatenate([[0], first[3][:q]]).astype(np.int64)
    continued = q == len(last[1]) and len(first[1]) > q
    children = np.ones(q + 1, np.int64)
    children[q] = 0
    zero = np.zeros(q + 1, np.int64)
    up = np.concatenate([keys[:1], keys[:-1]])
    return {
        "depth": np.arange(q + 1) + depth, "k1": keys[:, 0], "k2": keys[:, 1], "p1": up[:, 0], "p2": up[:, 1], "conv_id": np.full(q + 1, np.iinfo(np.int64).max),
        "n": zero, "all_chars": zero, "own_chars": -np.cumsum(lens[::-1])[::-1], "leaves": zero - int(continued), "children": -children,
    }


def _batch(found: dict[str, np.ndarray], edge: dict | None = None) -> pa.RecordBatch:
    """Rows of nodes, or the one row of what a partition begins and ends with."""
    kinds = {"pid": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "first": pa.binary(), "first_z": pa.binary(), "first_lens": pa.list_(pa.int64()), "l1": pa.int64(), "l2": pa.int64(), "last": pa.binary()}
    names = [c.split()[0] for c in _NODE.split(", ")]
    if edge:
        columns = [pa.nulls(1, pa.int64()) for _ in names] + [pa.array([edge[k]], t) for k, t in kinds.items()]
    else:
        columns = [pa.array(found[c].astype(np.int64)) for c in names] + [pa.nulls(len(found["depth"]), t) for t in kinds.values()]
    return pa.RecordBatch.from_arrays(columns, names=names + list(kinds))


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict]:
    """Runs of sorted segments of at most so many turns, unless one alone has more."""
    have, turns = [], 0
    for batch in batches:
        sizes = np.diff(batch.column("lens").offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
        i = 0
        while i < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(sizes[i:]), most - turns, side="right"))
            j = min(batch.num_rows, i + max(fits, 0 if have else 1), i + most)
            if j > i:
                have.append(batch.slice(i, j - i))
                turns += int(sizes[i:j].sum())
            if j < batch.num_rows:
                yield _columns(have)
                have, turns = [], 0
            i = j
    if have:
        yield _columns(have)


def _columns(parts: list[pa.RecordBatch]) -> dict:
    table = pa.Table.from_batches(parts).combine_chunks()
    number = lambda c: table.column(c).to_numpy().astype(np.int64)
    raw = {c: b"".join(x for x in table.column(c).to_pylist()) for c in ("path", "z")}
    lens = table.column("lens").combine_chunks()
    lens = lens.chunk(0) if isinstance(lens, pa.ChunkedArray) else lens
    return {
        "start": np.stack([number("s1"), number("s2")], axis=1),
        "offsets": np.concatenate([[0], np.cumsum(np.diff(lens.offsets.to_numpy()))]).astype(np.int64),
        "digests": np.frombuffer(raw["path"], "S16"),
        "z": np.frombuffer(raw["z"], ">i8").astype(np.int64).reshape(-1, 2),
        "lens": lens.flatten().to_numpy().astype(np.int64),
        "members": {c: number(c) for c in ("n", "conv_id", "all_chars", "own_chars", "leaves", "children")},
    }


def _first(x: dict) -> tuple[np.ndarray, ...]:
    end = x["offsets"][1]
    return x["start"][0], x["digests"][:end], x["z"][:end], x["lens"][:end]


def _last(x: dict) -> tuple[np.ndarray, np.ndarray]:
    return x["start"][-1], x["digests"][x["offsets"][-2] :]


def _level(classes: DataFrame, depth: int, shard: int, own: Tables) -> DataFrame:
    """Written nodes of the tries over distinct segments that start at a depth; their roots are among them."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for x in _shards(batches, shard):
            yield _batch(shard_nodes(x["start"], x["offsets"], x["digests"], x["z"], x["lens"], depth, x["members"]))
            if first is None:
                first = _first(x)
            elif (twice := overlap(last, _first(x), depth)) is not None:
                yield _batch(twice)
            last = _last(x)
        if first is not None:
            pid = TaskContext.get().partitionId()
            yield _batch({}, {"pid": pid, "s1": first[0][0], "s2": first[0][1], "first": first[1].tobytes(), "first_z": first[2].tobytes(), "first_lens": first[3], "l1": last[0][0], "l2": last[0][1], "last": last[1].tobytes()})

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for r in batch.to_pylist():
                first = np.array([r["s1"], r["s2"]]), np.frombuffer(r["first"], "S16"), np.frombuffer(r["first_z"], np.int64).reshape(-1, 2), np.array(r["first_lens"], np.int64)
                if last is not None and (twice := overlap(last, first, depth)) is not None:
                    yield _batch(twice)
                last = np.array([r["l1"], r["l2"]]), np.frombuffer(r["last"], "S16")

    keys = ["s1", "s2", "path"]
    found = own.stash(classes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tries, f"{_NODE}, {_EDGE}"), "shards")
    edges = found.where(F.col("pid").isNotNull()).repartition(1).sortWithinPartitions("pid")  # a row for each partition
    partial = found.where(F.col("pid").isNull()).union(edges.mapInArrow(borders, f"{_NODE}, {_EDGE}"))
    merged = partial.groupBy("depth", "k1", "k2").agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in _SUMS))
    return own.stash(merged, "nodes")


def _ends(segs: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end."""
    last = F.max(F.struct("seg", "e1", "e2")).alias("last")
    at = segs.groupBy("conv_id").agg(last, F.sum(F.size("lens")).alias("depth")).select("depth", F.col("last.e1").alias("k1"), F.col("last.e2").alias("k2"), "conv_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = at.groupBy("depth", "k1", "k2", F.shiftright("conv_id", ID_BITS).alias("run")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, have = None, None
        for batch in batches:
            keys, shas = [], []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")), strict=True):
                if now == key:
                    have.update(b"," + ids.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    shas.append(have.hexdigest())
                key, have = now, hashlib.sha256(ids.encode())
            yield _digests(keys, shas)
        if key is not None:
            yield _digests([key], [have.hexdigest()])

    def _digests(keys: list[list[int]], shas: list[str]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(shas, pa.string())], names=["depth", "k1", "k2", "ends_sha256"])

    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_node = runs.repartition(parts, "depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "run")
    return by_node.mapInArrow(digest, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def nodes(conversations: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    with Tables() as own:
        segs = own.stash(segments(rebuild(conversations, own), segment), "segments")
        top = segs.agg(F.max("seg")).head()[0]
        levels: list[DataFrame] = []
        hanging = ["all_chars", "own_chars", "leaves", "children"]
        for g in range(0 if top is None else top, -1, -1):
            classes = segs.where(F.col("seg") == g).groupBy("s1", "s2", "path", "z", "lens", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
            if levels:
                tails = levels[-1].where(F.col("depth") == (g + 1) * segment).select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.lit(segment).alias("_size"), *hanging)
                classes = classes.withColumn("_size", F.size("lens")).join(tails, ["e1", "e2", "_size"], "left")
                classes = classes.fillna(0, hanging)
            else:
                classes = classes.withColumns({c: F.lit(0).cast("bigint") for c in hanging})
            levels.append(_level(own.stash(classes.select("s1", "s2", "path", "z", "lens", "n", "conv_id", *hanging), "classes"), g * segment, shard, own))
        every = levels[-1]
        for k, found in enumerate(reversed(levels[:-1]), start=1):
            every = every.union(found.where(F.col("depth") > k * segment))  # their roots are ends of the level above
        if len(levels) > 1:
            every = own.stash(every, "every")
        parents = every.where("children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("children").alias("k"))
        below = join_counted(every.where("depth > 0"), parents, ["depth", "p1", "p2"], F.col("k1"))
        columns = ["depth", "k1", "k2", "conv_id", "parent_conv_id", *_SUMS]
        out = below.select(*columns).union(every.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*columns))
        out = out.join(_ends(segs), ["depth", "k1", "k2"], "left")
        nobody = hashlib.sha256(b"").hexdigest()
        return own.keep(
            out.select(
                "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                (F.col("all_chars") - F.col("own_chars")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
            ),
            "trie",
        )


#: The same rows in SQL, by prefixes as lists; each node's weight is added to all nodes on the way to it.
SQL = f"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos, d, len FROM (
        SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, ''))::VARCHAR, ':', coalesce(role, ''), coalesce(text, '')))[1:32] AS d, length(coalesce(text, ''))::BIGINT AS len FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
    SELECT conv_id, conv_id - conv_id % {BASES} AS base, {CRC32_SQL.format(id='conv_id')} % {HEADS} AS h, count(*) AS n FROM t GROUP BY conv_id
), r AS (
    SELECT c.conv_id, pos, d, len FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h
    UNION ALL
    SELECT conv_id, pos - h + least(h, coalesce((SELECT b.n FROM c b WHERE b.conv_id = c.base), 0)), d, len FROM c JOIN t USING (conv_id) WHERE pos > h
), w AS (
    SELECT c.conv_id, coalesce(list(d ORDER BY pos) FILTER (pos > 0), []) AS ds, coalesce(list(len ORDER BY pos) FILTER (pos > 0), []) AS lens FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), p AS (
    SELECT conv_id, depth, array_to_string(ds[1:depth], '') AS k, array_to_string(ds[1:depth - 1], '') AS up, coalesce(lens[depth], 0) AS len, depth = len(ds) AS ended
    FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS depth FROM w)
), nodes AS (
    SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len) AS len, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM p GROUP BY depth, k
), kids AS (
    SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), sums AS (
    SELECT p.depth, p.k, sum((x.n_convs - 1) * x.len)::BIGINT AS saved_tokens, count(*) FILTER (x.n_children IS NULL) AS n_leaves
    FROM (SELECT * FROM nodes LEFT JOIN kids USING (depth, k)) x JOIN p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.depth, p.k
)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, a.ends_sha256
FROM nodes a LEFT JOIN kids USING (depth, k) JOIN sums USING (depth, k) LEFT JOIN nodes b ON a.depth > 0 AND b.depth = a.depth - 1 AND b.k = a.up
"""
