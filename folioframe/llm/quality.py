"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are texts labelled 1, the unlabelled set is a sample of all texts of the training rows, and pi is
the estimated share of positives among them. With the logistic loss l and a linear score g, training minimises

    pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])

where the bracket, the risk on negatives, can't fall below zero as it does when a model learns its sample by heart;
once it would, the step goes against it. Labels other than 1 are never looked at.

The prior pi is that of a mixture: a rough model is fitted to one half of both samples, and on the other half the share
of unlabelled texts that score at least c, divided by that of positives, bounds pi from above for every c; the c of
the least bound, with allowance for the samples' sizes, gives the estimate (best bin). The halves change places and
the mean of both is taken.

Features of a whole text: shares of byte-class trigrams (lower case, upper case, digit, blank, line break, sentence
mark, other mark, non-ASCII), hashed words and pairs of words, logarithms of its sizes, and how far words and lines
repeat. Training samples are bounded (``POSITIVE`` and ``UNLABELLED`` rows); scoring reads all rows.

Rows: a null text counts as empty; empty texts have features of zero and get a score like any other. Repeated rows
score alike, and so do texts of equal features. Without positives every score is the prior 0.5. Only id, text and
label are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.hashing import LOWER, mixed, word_hashes, word_spans
from folioframe.llm.shared import blocks

POSITIVE, UNLABELLED, ROUNDS = 2000, 4000, 250
CLASSES = 8
KIND = np.full(256, 6, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 7
KIND[[32, 9]], KIND[[10, 11, 12, 13]], KIND[[44, 46, 59, 58, 39, 34, 63, 33]] = 3, 4, 5
IS_WORD = ~np.isin(KIND, [3, 4])
#: Slots of hashed words and word pairs; the least spread that they are scaled by, so that rare words weigh little;
#: rows whose features are held at once.
HASHED, LEAST_SPREAD, ROWS = 1024, 0.2, 256
#: Bytes of text whose features are made together; what is made on the way takes about a hundred times as much memory.
BYTES = 1 << 18
SHAPES = CLASSES**3 + 9
N_FEATURES = SHAPES + HASHED


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each text of a block."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kind = KIND[data].astype(np.int64)
    out = np.zeros((n, N_FEATURES), np.float32)
    text = np.repeat(np.arange(n), size)
    if len(data) > 2:
        gram = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        inside = text[:-2] == text[2:]
        counts = np.bincount(text[:-2][inside] * CLASSES**3 + gram[inside], minlength=n * CLASSES**3).reshape(n, -1)
        out[:, : CLASSES**3] = np.sqrt(counts / np.maximum(size - 2, 1)[:, None])
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    words, of, count = word_hashes(data, starts, ends), np.repeat(np.arange(n), np.diff(first)), np.diff(first)
    line_starts, line_ends, first_line = word_spans(data, offsets, data_not_break)
    lines, of_line, n_lines = word_hashes(data, line_starts, line_ends), np.repeat(np.arange(n), np.diff(first_line)), np.diff(first_line)
    share = lambda a, b: a / np.maximum(b, 1)

    def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        return np.bincount(o[np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1]))], minlength=n) if len(v) else np.zeros(n)

    same = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1])) if len(words) else np.zeros(0, np.int64)
    pairs = words[:-1] * np.uint64(31) + words[1:] if len(words) > 1 else words[:0]
    kept = of[1:] == of[:-1]
    slots = np.concatenate([words >> np.uint64(40), mixed(pairs[kept]) >> np.uint64(40)]).astype(np.int64) % HASHED
    owner = np.concatenate([of, of[1:][kept]])
    place, times = np.unique(owner * HASHED + slots, return_counts=True)
    out[place // HASHED, SHAPES + place % HASHED] = np.sqrt(times / np.maximum(count, 1)[place // HASHED])
    out[:, CLASSES**3 : SHAPES] = np.stack(
        [
            np.log1p(size) / 10,
            np.log1p(count) / 10,
            np.log1p(n_lines) / 10,
            share(np.bincount(of, ends - starts, n), count) / 10,
            share(np.bincount(of[same], minlength=n), count),
            share(distinct(words, of), count),
            share(distinct(pairs[kept], of[1:][kept]), np.maximum(count - 1, 0)),
            share(distinct(lines, of_line), n_lines),
            share(distinct(words, of), np.sqrt(count)) / 10,
        ],
        1,
    )
    return out


data_not_break = ~np.isin(KIND, [4])


class Model:
    """A linear score on standardised features, and the prior."""

    def __init__(self, prior: float) -> None:
        self.prior = prior
        self.mean, self.scale, self.weight, self.bias = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -50, 50)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk on positives, the bracket (before it is held at zero), and the gradients of both in w."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    zp, zu = p @ w, u @ w
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    d_negative = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
    return positive, negative, -prior * (p.T @ sigmoid(-zp)) / len(p), d_negative


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS, decay: float = 1e-3, rate: float = 0.02) -> Model:
    """Minimise the non-negative risk by gradient steps with running means (Adam)."""
    model = Model(prior)
    if not len(positive) or not len(unlabelled):
        return model
    n = len(positive) + len(unlabelled)
    model.mean = (positive.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n
    squares = sum(np.sum((x[i : i + ROWS] - model.mean) ** 2, 0) for x in (positive, unlabelled) for i in range(0, len(x), ROWS))
    model.scale = np.maximum(np.sqrt(squares / n), np.where(np.arange(N_FEATURES) < SHAPES, 1e-2, LEAST_SPREAD))

    def ready(x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), N_FEATURES + 1), np.float32)
        for i in range(0, len(x), ROWS):
            out[i : i + ROWS, :-1] = np.clip((x[i : i + ROWS] - model.mean) / model.scale, -6, 6)
        return out

    p, u = ready(positive), ready(unlabelled)
    w, m, v = np.zeros(p.shape[1], np.float32), 0.0, 0.0
    for k in range(1, rounds + 1):
        _, negative, d_positive, d_negative = risk(w, p, u, prior)
        d = (d_positive + d_negative if negative >= 0 else -d_negative) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        w = (w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    model.weight, model.bias = w[:-1].astype(np.float64), float(w[-1])
    return model


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among scores of unlabelled texts, from scores of positives; see the module's text."""
    at = np.unique(positive)
    share = lambda z: 1 - np.searchsorted(np.sort(z), at, side="left") / len(z)
    of_p, of_u = share(positive), share(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    best = int(np.argmin((of_u + (1 + gamma) * slack) / of_p))
    return float(of_u[best] / of_p[best])


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from features of trusted positives and of unlabelled texts."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    found = []
    for turn in (0, 1):
        rough = fit(positive[turn::2], unlabelled[turn::2], 0.5, 60, decay=1e-2)
        found.append(best_bin(rough.raw(positive[1 - turn :: 2]), rough.raw(unlabelled[1 - turn :: 2])))
    return float(min(0.99, max(0.01, np.mean(found))))


def _described(rows: DataFrame) -> DataFrame:
    """rows (id, text) -> (id, x): the features as bytes of half precision, which is enough to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("text"), BYTES, ROWS):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x binary")


def _first(rows: DataFrame, most: int) -> np.ndarray:
    """Features of the ``most`` rows (id, text) that a hash of id and text puts first: the same ones in every run.

    Beyond twice as many, rows are chosen by that hash before their features are made.
    """
    rows = rows.withColumn("id", F.xxhash64("id", "text"))
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(F.pmod("id", F.lit(2**32)) < int(1.5 * most / n * 2**32))
    got = _described(rows).orderBy("id", "x").limit(most).collect()
    return np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float16).reshape(-1, N_FEATURES).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, train_on: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on the rows of ``docs`` and ``labels`` where ``train_on``, an expression of the id column, holds."""
    rows = docs.where(train_on).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    trusted = labels.where(train_on).where(F.col(label).cast("int") == 1).select(F.col(doc_id).alias("id")).distinct()
    n = trusted.count()
    if n > 2 * POSITIVE:
        trusted = trusted.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2**32)) < int(1.5 * POSITIVE / n * 2**32))
    chosen = trusted.orderBy(F.xxhash64("id"), "id").limit(POSITIVE)
    positive = _first(rows.join(F.broadcast(chosen), "id"), POSITIVE)  # bounded by the sample's size
    unlabelled = _first(rows, UNLABELLED)
    return fit(positive, unlabelled, prior_of(positive, unlabelled))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row; score is the model's belief that the text is of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("text"), BYTES, ROWS):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sent.value.score(features(data, offsets)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, that the model does not reject; rows keep to their partitions."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text).cast(pa.string())
            for i, j, data, offsets in blocks(column, BYTES, ROWS):
                yield batch.slice(i, j - i).filter(pa.array(sent.value.score(features(data, offsets)) >= least))

    return docs.mapInArrow(run, docs.schema)
