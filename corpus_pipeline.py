"""The corpus pipeline, from documents to token digests.

Each stage takes all documents that the one before kept; every stage but the last returns the columns of documents.
Between stages the documents are written as Parquet and read again.

In every stage a null text counts as empty, an empty table stays empty, repeated rows are judged alike (of whole repeated
rows exact dedup keeps one), and columns of any name stay but in the last one. Rows without a doc_id take part: near dedup
never drops them, and drops rows that share a doc_id together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sightline.llm import byte_bpe, exact_dedup, language_id, mixing, near_dedup, queries, shared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those most of whose words are foreign to every learned language."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hands out every document at least once and documents of small sources again, as a row for each time."""
    return mixing.repeat(docs, queries.MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row handed out, as counts and digests."""
    return byte_bpe.digest_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, entries=200_000)


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte bpe", encode),
]

#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = shared.write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            shared.drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
