"""A training-data pipeline over the documents table: filter, dedup lines, dedup documents, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them one after another, writing each
result as Parquet in the shared folder and reading it back. All but the last return the columns of documents.
Stages work on whole texts of all rows that their predecessor kept. Rows with null or empty texts pass the filters
on their scores like any other; rows with a null id are never merged with others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe, decontaminate, linechunks, quality, sigtree
from folioframe.llm.shared import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The vocabulary of the last stage, by its name in the installed package of public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def train_on() -> Column:
    """Rows whose labels may be learned from; the others stay for measuring."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the positive-unlabelled model scores below one half."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train_on())
    return quality.keep(docs.select(*COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take later copies of repeated passages out of the texts.

    A document of which nothing is left is a copy itself and goes; all others stay, those that were empty before too.
    """
    out = linechunks.dedup(docs.select(*COLUMNS))
    left = F.length(F.trim(F.translate("text", "\n\t", ""))) > 0
    return _counted(out.where((F.col("_n_gone") == 0) | left))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies keep the document of the smallest id.

    Rows that repeat an id and text count as one document and stay together.
    """
    return sigtree.distinct(docs.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows in whose texts a window of benchmark words occurs; each row is judged by its own text."""
    return decontaminate.without(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): token ids of each text, and what they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality", filter_quality),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", remove_benchmark),
    ("tokens", encode),
]

#: SQL has no trained model and no byte-level BPE; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            now = Tables()
            docs = now.stash(docs, name)
            held.drop()  # what this stage read is not read any more
            held = now
    return docs
