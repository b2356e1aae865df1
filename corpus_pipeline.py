"""From raw documents to packed training sequences: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.llm import bagminhash, packing, quality, substrings, surrogates
from tidewall.session import checkpoint_dir
from tidewall.sources.tables import read_table


def _columns(docs: DataFrame, row: Column, text: Column) -> list[Column]:
    """The columns of ``docs`` in their order, out of ``row``, with another text and its length."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return [(new[c] if c in new else row[c]).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line-first rules reject, and failed lines of those that stay.

    Null and empty texts have too few words and go; equal rows are judged alike and all stay or go. Columns of any name are the
    caller's and pass unchanged, but for text and n_chars. An empty table gives no row.
    """
    judged = quality.clean_lines(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("doc_text")), "doc_text").where("kept")
    return judged.select(*_columns(docs, F.col("doc"), F.col("clean_text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest doc_id, of equal rows any one.

    Null texts are one class with empty ones; a null doc_id stays only where its class has no other. Columns of any name pass
    unchanged. An empty table gives no row.
    """
    return bagminhash.keep_first(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 20 words and more that occur earlier in the corpus, by doc_id, then by place.

    Null texts stay null; of rows with one doc_id and one text none is earlier. Columns of any name pass unchanged, but for
    text and n_chars. An empty table gives no row.
    """
    cut = substrings.remove_repeats(docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc")))
    return cut.select(*_columns(docs, F.col("doc"), F.col("text")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates, the same in every row.

    Null texts stay null. Columns of any name pass unchanged, but for text and n_chars. An empty table gives no row.
    """
    new = surrogates.pseudonymise(docs.select("text", F.struct(*docs.columns).alias("doc")))
    return new.select(*_columns(docs, F.col("doc"), F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 2,048 ids.

    A null text is an empty one and gives the end id alone; equal rows are packed each. Other columns than doc_id and text are left
    out. An empty table gives no row.
    """
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("pii", pii),
    ("packing", pack),
]

# Signatures, keyed permutations and the tokenizer are outside SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
