"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, and streaming decoding.

The merges of a vocabulary decide which tokens may stand side by side: a token sequence is the encoding of its
bytes if and only if merging the bytes of each neighbouring pair alone gives that pair back. So the last token of
the encoding of every prefix is fixed by the bytes so far, and reading bytes from left to right needs only the
positions from which a longer token may still begin. The transducer's states are (last token written, bytes
waiting); a step reads one byte and writes the tokens on which all open continuations agree, so that what waits
is bounded by the longest token. Determinisation is lazy: a step is added to the table when a state has lacked one
for the second time; until then, and when the table has reached its set size, the rest of the piece is read without
the table, by the same rule.

Rows: null text counts as empty and has no ids. Any other text gives one row, however long or often repeated.
Extra columns are ignored; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import gc
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import blocks

#: Steps, words and token pairs kept by each Python worker.
MAX_STEPS, MAX_WORDS, MAX_PAIRS = 60_000, 120_000, 200_000
#: Ids that streaming decoding takes at once.
DECODE_IDS = 65_536


BYTES = [bytes((b,)) for b in range(256)]


class Transducer:
    """Reads a piece's bytes and writes token ids; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], max_steps: int = MAX_STEPS) -> None:
        self.ranks, self.max_steps = ranks, max_steps
        #: The tokens' bytes as a tree: (node * 256 + byte) -> node; what token a node is (or -1), and if it leads on.
        self.tree: dict[int, int] = {}
        self.token, self.leads = [-1], [True]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                self.leads[node] = True
                below = self.tree.get(node << 8 | byte)
                if below is None:
                    below = self.tree[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.leads.append(False)
                node = below
            self.token[node] = i
        self.text = {i: t for t, i in ranks.items()}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, float]] | None] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first."""
        self.pairs: dict[int, bool] = {}
        self.number: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.states: list[tuple] = [(-1, b"", (), ((0, 0),))]
        self.lacked: list[int] = [0]
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.made = 0

    def merged(self, piece: bytes) -> list[list[bytes]]:
        """The definition of BPE, from which the transducer is compiled: the parts after each merge."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        seen = [parts]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 40:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            seen.append(parts)
        return seen

    def edge(self, token: int, last: bool) -> list[tuple[bytes, float]] | None:
        """What stands at the token's last (or first) place while its bytes are merged, and the rank of the merge
        that ends it; None if merging doesn't give the token."""
        if (token, last) not in self.edges:
            seen = self.merged(self.text[token])
            if len(seen[-1]) > 1:
                self.edges[token, last] = None
            else:
                parts = list(dict.fromkeys(x[-1 if last else 0] for x in seen))
                self.edges[token, last] = [(x, self.ranks[y]) for x, y in zip(parts, parts[1:], strict=False)] + [(parts[-1], float("inf"))]
        return self.edges[token, last]

    def stands(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` (-1: the piece begins)? Not if parts that meet at the border merge first."""
        known = self.pairs.get(left << 24 | right)
        if known is None:
            a, b = (None if left < 0 else self.edge(left, True)), self.edge(right, False)
            known = b is not None and (left < 0 or a is not None)
            i = j = 0
            while known and left >= 0 and i < len(a) and j < len(b):
                (x, x_ends), (y, y_ends) = a[i], b[j]
                rank = self.ranks.get(x + y)
                known = rank is None or rank >= x_ends or rank > y_ends  # of equal ranks the leftmost is merged first
                i, j = (i + 1, j) if x_ends <= y_ends else (i, j + 1)
            self.pairs[left << 24 | right] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the step out of ``state`` on ``byte``: (next state, tokens written)."""
        last, waiting, back, live = self.states[state]
        tree, tokens, leads, pairs = self.tree, self.token, self.leads, self.pairs
        n, now, found = len(waiting) + 1, [], None
        for q, node in live:
            node = tree.get(node << 8 | byte)
            if node is None:
                continue
            token = tokens[node]
            if found is None and token >= 0:
                left = back[q - 1][1] if q else last
                ok = pairs.get(left << 24 | token)
                if ok or ok is None and self.stands(left, token):
                    found = (q, token)
            if leads[node]:
                now.append((q, node))
        if found is None:
            raise ValueError("the vocabulary lacks a byte")
        waiting += BYTES[byte]
        back += (found,)
        commit = n
        for q, _ in now:  # the last position through which all open continuations go
            while q != commit:
                if q > commit:
                    q = back[q - 1][0]
                else:
                    commit = back[commit - 1][0]
        now.append((n, 0))
        written = ()
        if commit:
            q = commit
            while q:
                q, token = back[q - 1]
                written = (token, *written)
            last, waiting = written[-1], waiting[commit:]
            back = tuple([(q - commit, t) for q, t in back[commit:]])  # those that begin before the commit are never asked again
            now = [(q - commit, node) for q, node in now]
        to = self.number.get((last, waiting))
        if to is None:
            to = self.number[last, waiting] = len(self.states)
            self.states.append((last, waiting, back, tuple(now)))
            self.steps.append({})
            self.lacked.append(0)
        self.made += 1
        out = self.steps[state][byte] = (to, written)
        return out

    def rest(self, state: int, piece: bytes, at: int) -> list[int]:
        """The tokens still to be written when ``piece`` is read on from ``at`` to its end, without the table."""
        last, waiting, back, live = self.states[state]
        back, n = list(back), len(waiting)
        tree, tokens, leads, pairs = self.tree, self.token, self.leads, self.pairs
        for byte in piece[at:]:
            now, found = [], None
            for q, node in live:
                node = tree.get(node << 8 | byte)
                if node is None:
                    continue
                token = tokens[node]
                if found is None and token >= 0:
                    left = back[q - 1][1] if q else last
                    ok = pairs.get(left << 24 | token)
                    if ok or ok is None and self.stands(left, token):
                        found = (q, token)
                if leads[node]:
                    now.append((q, node))
            if found is None:
                raise ValueError("the vocabulary lacks a byte")
            back.append(found)
            n += 1
            now.append((n, 0))
            live = now
        tail = []
        while n:
            n, token = back[n - 1]
            tail.append(token)
        tail.reverse()
        return tail

    def encode(self, piece: bytes) -> list[int]:
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        out: list[int] = []
        state, steps = 0, self.steps
        for at, byte in enumerate(piece):
            to = steps[state].get(byte)
            if to is None:
                if not self.lacked[state] or self.made >= self.max_steps:
                    self.lacked[state] = 1
                    return out + self.rest(state, piece, at)
                to = self.step(state, byte)
            state, written = to
            if written:
                out += written
        return out + self.rest(state, b"", 0)


class Words(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, through the transducer when first met.

    Two generations are kept: what was not met in the last ``MAX_WORDS`` new pieces is forgotten.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.machine, self.older = ranks, Transducer(ranks), {}

    def tidy(self) -> None:
        if len(self) > MAX_WORDS:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        known = self.older.get(piece)
        if known is not None:
            self[piece] = known
            return known
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.machine.encode(raw)
        out = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Utf8Stream:
    """Incremental UTF-8: bytes go in as they come, whole characters come out, up to three bytes wait."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, more: bytes) -> str:
        raw = self.waiting + more
        keep = 0
        for back in range(1, min(3, len(raw)) + 1):
            lead = raw[-back]
            if lead < 0x80:
                break
            if lead >= 0xC0:  # a lead byte: does its character end within what has come?
                keep = back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else 0
                break
        self.waiting = raw[len(raw) - keep :]
        return raw[: len(raw) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _words(path: str) -> Words:
    out = Words(vocabulary(path))
    gc.freeze()  # the tables live as long as the worker and hold no cycles
    gc.set_threshold(200_000, 50, 100)
    return out


def _latin(pattern: str) -> str:
    """``pattern`` with its classes written out for code points below 256, where Python's quicker ``re`` reads them."""

    def listed(kind: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if regex.match(kind, chr(c)))

    letters, numbers, space = listed(r"\p{L}"), listed(r"\p{N}"), listed(r"\s")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    return out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of ``pattern`` in a text, one after another."""
    wide, narrow = regex.compile(pattern), re.compile(_latin(pattern))
    beyond = re.compile(r"[^\x00-\xff]")
    return lambda x: (wide if beyond.search(x) else narrow).findall(x)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) batches -> (doc_id, ids)."""
    find, words = splitter(pattern), _words(path)
    for batch in batches:
        texts = batch.column("text")
        for i, j, _, _ in blocks(texts):
            out = []
            for x in texts.slice(i, j - i).to_pylist():
                out.append(b"".join(map(words.__getitem__, find(x))) if x else b"")
                words.tidy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(out, pa.binary())], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) batches -> (doc_id, ids, text), as a stream of blocks of ids."""
    table = _spelled(path)
    for batch in batches:
        _, ids = batch.columns
        for i in range(0, len(ids), 256):
            out = []
            for raw in ids.slice(i, 256).to_pylist():
                stream, got = Utf8Stream(), []
                of = np.frombuffer(raw or b"", "<u4")
                for k in range(0, len(of), DECODE_IDS):
                    got.append(stream.feed(b"".join(table[of[k : k + DECODE_IDS]].tolist())))
                out.append("".join([*got, stream.end()]))
            yield pa.RecordBatch.from_arrays([*(c.slice(i, 256) for c in batch.columns), pa.array(out, pa.string())], ["doc_id", "ids", "text"])


@lru_cache(2)
def _spelled(path: str) -> np.ndarray:
    """The bytes of each id."""
    ranks = vocabulary(path)
    table = np.full(max(ranks.values(), default=0) + 1, b"", dtype=object)
    for t, i in ranks.items():
        table[i] = t
    return table


def _texts(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), docs.schema[doc_id].dataType.simpleString()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids BINARY): the ids of each whole text, little-endian unsigned 32-bit integers one after another.

    ``path`` names a vocabulary file that every executor has (as part of an installed package or a shared mount).
    """
    rows, kind = _texts(docs, text, doc_id)
    return rows.mapInArrow(lambda batches: _encoded(batches, path, pattern), f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): what the ids of ``encode`` stand for."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, path), f"doc_id {kind}, ids binary, text string")


def roundtrip(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, text) of encoding and decoding, in one Python worker for each task."""
    rows, kind = _texts(docs, text, doc_id)
    return rows.mapInArrow(lambda batches: _decoded(_encoded(batches, path, pattern), path), f"doc_id {kind}, ids binary, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding every text and decoding its ids."""
    return roundtrip(docs, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
