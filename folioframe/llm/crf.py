"""Language identification of words by a linear-chain conditional random field.

Each word of a text has a language; features are hashed byte trigrams of the word with its borders, its prefixes and
suffixes of two to four bytes, and its entry in a lexicon of the training words. Weights of features and of the
transitions between languages are learned together by gradient ascent on the conditional likelihood, whose marginals
come from the forward-backward algorithm. Training sequences join pieces of different documents, so that texts that
switch languages are known to the model. A document's language is that with the largest mean marginal of its words.

Training rows are a bounded sample (``PER_LANG`` documents of each language, at most ``PIECES`` pieces of ``PIECE`` words
of each); prediction reads whole texts. Forward-backward runs over all words of a block of texts side by side: each text is cut
into chunks, the chunks' transfer matrices are multiplied first, messages pass from chunk to chunk, and then run
within all chunks at once; the marginals are those of the whole text.

Rows: null texts and texts without letters are `und` with score 0. Of languages with equal marginals the first in
alphabetical order is taken. Repeated rows are predicted alike. With no
training rows every text is `und`. Only id, text and, for training, the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.hashing import LOWER, word_hashes, word_spans
from folioframe.llm.shared import blocks

#: Training documents of a language, pieces of a document, words of a piece, pieces of a training sequence.
PER_LANG, PIECES, PIECE, JOINED = 150, 20, 12, 3
#: Labels that are learned, the most frequent ones, and bytes of a word of a training piece.
LABELS, WORD_BYTES = 256, 64
#: Sizes of the hashed tables; rounds of training; words of a chunk.
GRAMS, AFFIXES, ROUNDS, CHUNK = 1 << 16, 1 << 15, 40, 32
UNKNOWN = "und"

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case: A-Z, and the capitals of the Latin-1 block in UTF-8."""
    out = LOWER[data]
    if len(out) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 32
    return out


class Features:
    """Feature indices of all words of a block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = lowered(data)
        self.starts, self.ends, self.first = word_spans(data, offsets, IS_LETTER)
        starts, ends = self.starts, self.ends
        self.hash = word_hashes(data, starts, ends)
        size = ends - starts
        self.edge = np.concatenate([[0], np.cumsum(size)])  # where each word's trigrams begin
        at = np.arange(self.edge[-1]) + np.repeat(starts - self.edge[:-1], size)  # positions of the words' bytes
        d = data.astype(np.int64)
        here = d[at]
        before = np.where(at == np.repeat(starts, size), 0, d[np.maximum(at - 1, 0)])
        after = np.where(at == np.repeat(ends, size) - 1, 1, d[np.minimum(at + 1, max(len(d) - 1, 0))] if len(d) else at)
        self.grams = (((before * 257 + here) * 257 + after) * 2654435761 >> 7) & (GRAMS - 1)
        self.affixes = []
        for k in (2, 3, 4):
            for turn, base in ((1, starts), (2, ends - k)):
                h = np.full(len(starts), 7 * k + turn, np.int64)
                for step in range(k):
                    p = np.clip(base + step, starts, ends - 1)
                    h = (h * 1000003 + d[p]) & 0x7FFFFFFFFFFF if len(d) else h
                self.affixes.append((h * 2654435761 >> 9) & (AFFIXES - 1))


class Model:
    """Weights, and what is computed with them."""

    def __init__(self, labels: list[str], lexicon: np.ndarray) -> None:
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = [np.zeros((GRAMS, n), np.float32), np.zeros((AFFIXES, n), np.float32), np.zeros((len(lexicon) + 1, n), np.float32), np.zeros((n, n), np.float32), np.zeros((1, n), np.float32)]

    def entries(self, f: Features) -> np.ndarray:
        """Rows of the lexicon's weights; the last is for unknown words."""
        at = np.searchsorted(self.lexicon, f.hash)
        at[at == len(self.lexicon)] = 0
        known = self.lexicon[at] == f.hash if len(self.lexicon) else np.zeros(len(at), bool)
        return np.where(known, at, len(self.lexicon))

    def emissions(self, f: Features) -> np.ndarray:
        grams, affixes, words, _, _ = self.weights
        if not len(f.starts):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.add.reduceat(grams[f.grams], f.edge[:-1], axis=0)
        for a in f.affixes:
            out += affixes[a]
        return out + words[self.entries(f)]

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(language) of each word; ``first``: each text's first word, and the end."""
        return self.messages(scores, first)[0]

    def messages(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(language) of each word given its whole text, and the forward message of each word, up to a factor."""
        n, k = scores.shape
        if not n:
            return scores, scores
        lens = np.diff(first)
        texts = np.flatnonzero(lens)
        per = -(-lens[texts] // CHUNK)
        head = np.concatenate([[0], np.cumsum(per)])  # the texts' first chunks
        nth = np.arange(head[-1]) - np.repeat(head[:-1], per)
        begin = np.repeat(first[:-1][texts], per) + nth * CHUNK
        end = np.minimum(begin + CHUNK, np.repeat(first[1:][texts], per))
        slot = begin[:, None] + np.arange(CHUNK)
        real = slot < end[:, None]
        emit = np.exp(scores - scores.max(1, keepdims=True))[np.minimum(slot, n - 1)]  # chunk, place, language
        move = np.exp(self.weights[3] - self.weights[3].max())
        start = np.exp(self.weights[4][0] - self.weights[4].max())
        c = len(begin)
        # the transfer matrix of each chunk but a text's first: what its last word gets from the word before it
        total = np.broadcast_to(np.eye(k, dtype=np.float32), (c, k, k)).copy()
        for t in range(CHUNK):
            step = total @ move * emit[:, t, None, :]
            step /= step.max((1, 2), keepdims=True)
            total = np.where(real[:, t, None, None], step, total)
        alpha = np.empty((c, CHUNK, k), np.float32)
        come = np.zeros((c, k), np.float32)  # forward message into each chunk, from the chunk before
        beta_out = np.ones((c, k), np.float32)  # backward message into each chunk's last word, from the chunk after
        at_first = np.zeros(c, bool)
        at_first[head[:-1]] = True

        def first_chunks() -> np.ndarray:
            a = start * emit[head[:-1], 0]
            for t in range(1, CHUNK):
                new = (a @ move) * emit[head[:-1], t]
                a = np.where(real[head[:-1], t, None], new / new.max(1, keepdims=True), a)
            return a

        passing, deep = first_chunks(), int(per.max())
        for j in range(1, deep):
            some = np.flatnonzero(per > j)
            chunk = head[:-1][some] + j
            come[chunk] = passing[some]
            new = np.einsum("ck,ckl->cl", passing[some], total[chunk])
            passing[some] = new / new.max(1, keepdims=True)
        back = np.ones((len(texts), k), np.float32)
        for j in range(deep - 1, 0, -1):
            some = np.flatnonzero(per > j)
            chunk = head[:-1][some] + j
            new = np.einsum("ckl,cl->ck", total[chunk], back[some])
            back[some] = new / new.max(1, keepdims=True)
            beta_out[chunk - 1] = back[some]
        a = come
        for t in range(CHUNK):
            a = ((a @ move) if t else np.where(at_first[:, None], start, come @ move)) * emit[:, t]
            a = a / np.maximum(a.max(1, keepdims=True), 1e-30)
            alpha[:, t] = a
        forward = alpha[real]
        b = beta_out
        for t in range(CHUNK - 1, -1, -1):
            if t + 1 < CHUNK:
                inner = (emit[:, t + 1] * b) @ move.T
                inner /= np.maximum(inner.max(1, keepdims=True), 1e-30)
                b = np.where(real[:, t + 1, None], inner, b)
            alpha[:, t] *= b
        out = alpha[real]
        return out / out.sum(1, keepdims=True), forward

    def pairs(self, p: np.ndarray, forward: np.ndarray, linked: np.ndarray) -> np.ndarray:
        """P(language of a word, language of the next) for the words whose next is in the same text (``linked``).

        That is alpha(a) move(a, b) emit(b) beta(b) / Z, where emit(b) beta(b) is what the next word's marginal holds
        beyond its forward part.
        """
        move = np.exp(self.weights[3] - self.weights[3].max())
        left, right = forward[:-1][linked], p[1:][linked]
        joint = left[:, :, None] * move * (right / np.maximum(left @ move, 1e-30))[:, None, :]
        return joint / joint.sum((1, 2), keepdims=True)


def train(texts: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fit to (text, language) rows; see the module's text for how sequences are made."""
    labels = sorted({y for _, y in texts})
    rng = np.random.default_rng(seed)
    order = sorted(texts)
    raw = [t.encode() for t, _ in order]
    data = np.frombuffer(b"".join(raw), np.uint8)
    f = Features(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    pieces, tag = [], []
    for d, (_, y) in enumerate(order):
        a, b = int(f.first[d]), int(f.first[d + 1])
        starts = np.arange(a, b, PIECE)
        for s in rng.permutation(starts)[:PIECES].tolist():
            pieces.append((s, min(s + PIECE, b)))
            tag.append(labels.index(y))
    turn = rng.permutation(len(pieces))
    words = np.concatenate([np.arange(*pieces[p]) for p in turn]) if len(turn) else np.zeros(0, np.int64)
    y = np.concatenate([np.full(pieces[p][1] - pieces[p][0], tag[p]) for p in turn]) if len(turn) else words
    lens = [pieces[p][1] - pieces[p][0] for p in turn]
    first = np.concatenate([[0], np.cumsum(lens)])[:: JOINED]
    first = np.unique(np.append(first, len(words)))

    class Taken:  # the features of the pieces' words only, in the pieces' order
        pass

    g = Taken()
    size = np.diff(f.edge)[words]
    g.edge = np.concatenate([[0], np.cumsum(size)])
    g.grams = f.grams[np.arange(g.edge[-1]) + np.repeat(f.edge[:-1][words] - g.edge[:-1], size)]
    g.affixes, g.hash, g.starts = [a[words] for a in f.affixes], f.hash[words], f.starts[words]
    known, often = np.unique(g.hash, return_counts=True)
    model = Model(labels, known[often >= 3])
    n, k = len(words), len(labels)
    if n == 0 or k < 2:
        return model
    of_gram, entry = np.repeat(np.arange(n), size), model.entries(g)
    squares = [np.full_like(w, 1e-6) for w in model.weights]
    is_first = np.zeros(n, bool)
    is_first[first[:-1]] = True
    truth = np.eye(k, dtype=np.float32)[y]
    for _ in range(rounds):
        scores = model.emissions(g)
        p, forward = model.messages(scores, first)
        gap = (truth - p) / n
        grads = [np.stack([np.bincount(at, gap[of, c], len(w)) for c in range(k)], 1) for w, at, of in ((model.weights[0], g.grams, of_gram), (model.weights[2], entry, slice(None)))]
        affix = sum(np.stack([np.bincount(a, gap[:, c], AFFIXES) for c in range(k)], 1) for a in g.affixes)
        joint = model.pairs(p, forward, ~is_first[1:])
        seen = truth[:-1][~is_first[1:]].T @ truth[1:][~is_first[1:]]
        grads = [grads[0], affix, grads[1], (seen - joint.sum(0)) / n, gap[is_first].sum(0)[None]]
        for w, s, d in zip(model.weights, squares, grads, strict=True):
            d = d - 1e-6 * w
            s += d * d
            w += (0.3 * d / np.sqrt(s)).astype(np.float32)
    return model


def pieces(rows: DataFrame) -> DataFrame:
    """(h, y, piece) of rows (h, y, t): at most ``PIECES`` runs of ``PIECE`` words from anywhere in each whole text.

    Words of more than ``WORD_BYTES`` bytes are left out. Which pieces are taken is told by h alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("t")):
                starts, ends, first = word_spans(data, offsets, IS_LETTER)
                whole = data.tobytes()
                at, said = [], []
                for d, h in enumerate(batch.column("h").slice(i, j - i).to_pylist()):
                    a, b = int(first[d]), int(first[d + 1])
                    for x in np.random.default_rng(h % 2**32).permutation(np.arange(a, b, PIECE))[:PIECES].tolist():
                        words = [whole[starts[w] : ends[w]] for w in range(x, min(x + PIECE, b)) if ends[w] - starts[w] <= WORD_BYTES]
                        at.append(i + d)
                        said.append(b" ".join(words).decode(errors="replace"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("h", "y")), pa.array(said, pa.string())], ["h", "y", "piece"])

    return rows.mapInArrow(run, "h bigint, y string, piece string")


def sample(labelled: DataFrame, text: str, label: str, key: Column, per_label: int = PER_LANG) -> list[tuple[str, str]]:
    """(piece, label) rows of at most ``per_label`` documents of each of the ``LABELS`` most frequent labels.

    Documents are taken by the order of a hash, the same ones in every run. Pieces are cut in the tasks, so that the
    driver gets no more than labels x documents x PIECES x PIECE words of WORD_BYTES bytes, however long the texts.
    """
    body = F.col(text).cast("string")
    rows = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(body.alias("t"), F.col(label).cast("string").alias("y"), F.xxhash64(key, body).alias("h"))
    counts = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(LABELS)
    # more than enough of each label by their hashes, equal rows once, then exactly the first of each label
    near = rows.join(F.broadcast(counts), "y").where(F.pmod("h", F.lit(2**32)) < 1.5 * per_label / F.col("n") * 2**32)
    once = near.groupBy("y", "h").agg(F.min("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h"))
    chosen = once.withColumn("rank", rank).where(F.col("rank") <= per_label).select("h", "y", "t")
    return [(r["piece"], r["y"]) for r in pieces(chosen).collect()]


def label_words(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, runs): runs <lang, first, end> are stretches of words of one language."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = model.labels
        for batch in batches:
            texts = batch.column("text")
            for i, j, data, offsets in blocks(texts):
                f = Features(data, offsets)
                p = model.marginals(model.emissions(f), f.first) if names else np.zeros((len(f.starts), 0))
                best = p.argmax(1) if names else np.zeros(len(p), np.int64)
                ascii_letters = np.concatenate([[0], np.cumsum(IS_LETTER[data] & (data < 128))])[offsets]
                langs, scores, counts, runs = [], [], [], []
                for d in range(j - i):
                    a, b = int(f.first[d]), int(f.first[d + 1])
                    letters = b > a and names and (ascii_letters[d + 1] > ascii_letters[d] or any(c.isalpha() for c in texts[i + d].as_py()))
                    mean = p[a:b].mean(0) if letters else None
                    top = int(mean.argmax()) if letters else 0
                    langs.append(names[top] if letters else UNKNOWN)
                    scores.append(float(min(1.0, mean[top])) if letters else 0.0)
                    counts.append(b - a)
                    cut = [a, *(np.flatnonzero(np.diff(best[a:b])) + a + 1).tolist(), b] if letters else []
                    runs.append([{"lang": names[best[x]], "first": x - a, "end": y - a} for x, y in zip(cut, cut[1:], strict=False)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(runs, run_type)],
                    ["doc_id", "lang_pred", "score", "n_words", "runs"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_words bigint, runs array<struct<lang:string,first:bigint,end:bigint>>")


def identify(docs: DataFrame, train_on: Column, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Train on the rows where ``train_on`` holds, and label the words of all rows."""
    model = train(sample(docs.where(train_on), text, label, F.col(doc_id)))
    return label_words(docs, model, text, doc_id)
