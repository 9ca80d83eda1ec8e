"""The registered queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe, crf, decontaminate, domtree, hostrules, imatch, linechunks, merkle, pii, quality, sigtree, trie, warc
from folioframe.plans import Registry
from folioframe.sources.tables import table

REGISTRY = Registry()

#: The vocabulary of the token queries, by its name in the installed package of public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WINDOW_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

WARC_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages
), k AS (
    SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d
)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (d)
"""

WINDOW_SQL = f"""
WITH dw AS (
    SELECT doc_id, {_WINDOW_WORDS} AS ws FROM documents
), im AS (
    SELECT item_id, ws, least(10, len(ws)) AS m FROM (SELECT item_id, {_WINDOW_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
), win AS (
    SELECT DISTINCT item_id, m, array_to_string(ws[k:k + m - 1], ' ') AS w FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM im)
), occ AS (
    SELECT doc_id, k, m, array_to_string(ws[k:k + m - 1], ' ') AS w
    FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM dw CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(ws) >= m)
), hit AS (
    SELECT DISTINCT doc_id, k, m, item_id FROM occ JOIN win USING (m, w)
), pos AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM hit) GROUP BY doc_id
), it AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@REGISTRY.add("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text and decode its ids; see bpe."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@REGISTRY.add("op9_wu_manber", WINDOW_SQL)
def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in every whole text; see decontaminate."""
    return decontaminate.summary(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@REGISTRY.add("op6_disclosure")
def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it, in every whole text; see pii."""
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


@REGISTRY.add("op5_warc", WARC_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to seekable bundles and read all of them back; see warc."""
    back = warc.read(warc.archive(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@REGISTRY.add("op4_line_chunks", linechunks.SQL)
def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages taken out of every whole text, in any context; see linechunks."""
    out = linechunks.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_gone").cast("long").alias("n_gone"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@REGISTRY.add("op10_imatch", imatch.SQL)
def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every whole text, its edited text and the next document's; see imatch."""
    out = imatch.fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@REGISTRY.add("op8_signature_trees", sigtree.SQL)
def op8_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of whole texts that share 80 % of their five-word shingles; see sigtree."""
    return sigtree.join(table(spark, sf_dir, "documents"))


def _crc(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``: the folds of the labelled rows."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of))


@REGISTRY.add("op1_crf")
def op1_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, from the languages of its words; see crf."""
    held_out = _crc("doc_id", 4) == 2
    out = crf.identify(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words")


@REGISTRY.add("op2_nnpu")
def op2_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, from trusted positives and unlabelled texts; see quality."""
    docs, held_out = table(spark, sf_dir, "documents"), _crc("doc_id", 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@REGISTRY.add("op3_dom_tree")
def op3_dom_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; see domtree."""
    return domtree.main_text(table(spark, sf_dir, "pages"))


@REGISTRY.add("op12_merkle", merkle.SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every row against the root of the dataset, and whether the row handed on fits it; see merkle."""
    return merkle.verify(table(spark, sf_dir, "documents"))


@REGISTRY.add("op13_host_rules", hostrules.SQL)
def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text, its base rules and the verdict on its source; see hostrules."""
    return hostrules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@REGISTRY.add("op11_prefix_trie", trie.SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations; see trie."""
    return trie.nodes(table(spark, sf_dir, "conversations"))
