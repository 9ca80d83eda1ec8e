"""Quality rules by host: a host whose documents fail a rule too often loses all of them.

Each whole text is measured once, in Arrow batches; only its counts go on. Failures of each rule are summed by host.
Hosts of few documents say little, so their rates are shrunk: the rates of all hosts give a beta prior by moments (the
correlation of documents within hosts), and a host's rate is the mean of its posterior. A host with a rate beyond
``MOST`` for any rule is rejected, and its documents with it; a document that fails a base rule itself goes anyway.

Words are runs of characters other than space and U+0009 .. U+000D; lines end at line feeds. Windows and lines are
compared within one text, by 64-bit hashes. A null text has no words. Documents without a host get no host verdict.
Rows that repeat an id count as documents of their own. Of further columns none is read. A text is measured as a
whole: a task needs some 40 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.hashing import mixed, window_hashes, word_hashes, word_spans
from folioframe.llm.shared import Tables, blocks, join_counted

#: A document of fewer words, or with more than this percentage of its words in repeated windows, fails by itself.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words of a window.
WINDOW = 3
#: A host is rejected where the shrunken rate of a rule's failures is beyond this.
MOST = 0.5
#: Correlation of documents within hosts where the rates can't tell it, and its least value, which caps the prior at 9999 documents.
UNKNOWN, LEAST = 0.01, 1e-4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_WORD, _SYMBOL = np.ones(256, bool), np.zeros(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True



def rules() -> dict[str, Column]:
    """Rules by name: whether a document with these counts fails. The first two are the base rules."""
    n = F.col("n_words")
    return {
        "short": n < LEAST_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MOST_REPEATED * n,
        "odd_words": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_of(url: Column) -> Column:
    """The host that an address names, in lower case and without ``www.``; null where it names none."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def _inside(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each two offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeated(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with a hash and the index of their text: of how many equal ones in the text each is, and whether it is the first."""
    _, first, which, n = np.unique(mixed(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(hashes), bool)
    is_first[first] = True
    return n[which], is_first


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of the texts in a block of bytes."""
    n_texts = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, _WORD)
    n_words = np.diff(first)
    out = {"n_words": n_words, "word_chars": _inside(_WORD[data] & ((data & 0xC0) != 0x80), offsets), "n_symbols": _inside(_SYMBOL[data], offsets)}

    of = np.repeat(np.arange(n_texts), n_words)
    covered = np.zeros(len(of) + 1, np.int64)
    if len(of) >= WINDOW:
        whole = np.flatnonzero(of[: len(of) - WINDOW + 1] == of[WINDOW - 1 :])
        n, _ = _repeated(window_hashes(word_hashes(data, starts, ends), WINDOW)[whole], of[whole])
        again = whole[n > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(of[np.cumsum(covered)[:-1] > 0], minlength=n_texts)

    feeds = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    line_of = np.repeat(np.arange(n_texts), np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1)
    said = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_of = line_starts[said], line_ends[said], line_of[said]
    _, is_first = _repeated(word_hashes(data, line_starts, line_ends), line_of)
    out["n_lines"] = np.bincount(line_of, minlength=n_texts)
    out["n_dup_lines"] = np.bincount(line_of[~is_first], minlength=n_texts)
    return out


def measure(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """(key, host, and COUNTS) of each whole text."""
    rows = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("text")):
                found = counts(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), batch.column("host").slice(i, j - i), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=["key", "host", *COUNTS])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, host string, {', '.join(f'{c} bigint' for c in COUNTS)}")


def prior(n_hosts: float, n: float, n_squared: float, failed: float, spread: float) -> tuple[float, float]:
    """(alpha, beta) from sums over hosts of n documents, x of them failed: count, n, n * n, x, x * x / n."""
    p = failed / n if n else 0.0
    rest = n - n_squared / n - (n_hosts - 1) if n else 0.0
    if rest <= 0 or p <= 0 or p >= 1:
        rho = UNKNOWN
    else:
        rho = ((spread - p * p * n) / (p * (1 - p)) - (n_hosts - 1)) / rest
    rho = min(max(rho, LEAST), 1 - LEAST)
    return p * (1 - rho) / rho, (1 - p) * (1 - rho) / rho


def hosts(measured: DataFrame, most: float = MOST) -> DataFrame:
    """(host, n, rate_<rule> .., rejected) of each host, by the failures of its documents that ``measure`` counted."""
    names = list(rules())
    failed = measured.where(F.col("host").isNotNull()).select("host", *(c.cast("bigint").alias(f"x_{k}") for k, c in rules().items()))
    by_host = failed.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"x_{k}").alias(f"x_{k}") for k in names))
    n = F.col("n").cast("double")
    sums = [F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")]
    for k in names:
        x = F.col(f"x_{k}").cast("double")
        sums += [F.sum(x).alias(f"x_{k}"), F.sum(x * x / n).alias(f"q_{k}")]
    s = by_host.agg(*sums).head()
    rates = {}
    for k in names:
        alpha, beta = prior(s["k"], s["n"] or 0.0, s["nn"] or 0.0, s[f"x_{k}"] or 0.0, s[f"q_{k}"] or 0.0)
        rates[k] = (F.col(f"x_{k}") + F.lit(alpha)) / (n + F.lit(alpha + beta))
    rejected = F.greatest(*rates.values()) > F.lit(most)
    return by_host.select("host", "n", *(r.alias(f"rate_{k}") for k, r in rates.items()), rejected.alias("rejected"))


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", most: float = MOST) -> DataFrame:
    """(key, host, COUNTS, base_failed, host_rejected, kept) of each document.

    The measures are written once, for the sums by host and for the join of the verdicts, in which hosts of many
    documents are dealt out.
    """
    base = rules()
    with Tables() as own:
        measured = own.stash(measure(docs, key, host, text), "measures")
        verdicts = own.stash(hosts(measured, most).select("host", "n", "rejected"), "hosts")
        named = join_counted(measured.where(F.col("host").isNotNull()), verdicts, ["host"], F.col("key"), "n").select("key", "host", *COUNTS, "rejected")
        both = named.union(measured.where(F.col("host").isNull()).select("key", "host", *COUNTS, F.lit(False)))
        failed = base["short"] | base["repetitive"]
        out = both.select(F.col("key").alias(key), F.col("host").alias(host), *COUNTS, failed.alias("base_failed"), F.col("rejected").alias("host_rejected"), (~failed & ~F.col("rejected")).alias("kept"))
        return own.keep(out, "verdicts")


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_FAILS = {
    "short": f"n_words < {LEAST_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "odd_words": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}


def _rho_sql(k: str) -> str:
    p = f"(sum(x_{k}) / sum(n))"
    rest = "(sum(n) - sum(n * n) / sum(n) - (count(*) - 1))"
    return f"""greatest({LEAST}, least({1 - LEAST}, CASE WHEN {rest} <= 0 OR {p} <= 0 OR {p} >= 1 THEN {UNKNOWN}
        ELSE ((sum(x_{k} * x_{k} / n) - {p} * {p} * sum(n)) / ({p} * (1 - {p})) - (count(*) - 1)) / {rest} END))"""


#: The same rows in SQL; rates near ``MOST`` could differ in their last digits.
SQL = f"""
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents
), c AS (
    SELECT r, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w
), win AS (
    SELECT r, k, array_to_string(ws[k:k + {WINDOW - 1}], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS k FROM w)
), again AS (
    SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1
), rep AS (
    SELECT r, count(DISTINCT place)::BIGINT AS n_repeat_words FROM (SELECT r, unnest(range(k, k + {WINDOW})) AS place FROM again) GROUP BY r
), m AS (
    SELECT r, doc_id, source, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM c LEFT JOIN rep USING (r)
), h AS (
    SELECT source, count(*)::DOUBLE AS n, {', '.join(f'(count(*) FILTER ({c}))::DOUBLE AS x_{k}' for k, c in _FAILS.items())} FROM m WHERE source IS NOT NULL GROUP BY source
), pr AS (
    SELECT {', '.join(f'{_rho_sql(k)} AS rho_{k}, sum(x_{k}) / sum(n) AS p_{k}' for k in _FAILS)} FROM h
), v AS (
    SELECT source, greatest({', '.join(f'(x_{k} + p_{k} * (1 - rho_{k}) / rho_{k}) / (n + (1 - rho_{k}) / rho_{k})' for k in _FAILS)}) > {MOST} AS rejected FROM h JOIN pr ON TRUE
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_FAILS['short']} OR {_FAILS['repetitive']} AS base_failed,
    NOT ({_FAILS['short']} OR {_FAILS['repetitive']}) AND NOT coalesce(rejected, FALSE) AS kept
FROM m LEFT JOIN v USING (source)
"""
