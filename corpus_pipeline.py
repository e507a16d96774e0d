"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), docs being what the one before kept, and returns a frame; it is written as
Parquet and read again for the next one. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricemill.llm import exact, mixing, packing, quality, simhash
from pricemill.llm.common import read_table
from pricemill.llm.queries import tokenizer_file
from pricemill.session import staged


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier rejects; it learns from the labelled rows of `docs`."""
    return quality.keep_good(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that agree up to blanks, keep the one with the smallest doc_id."""
    return exact.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keep the document with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources asks for."""
    return mixing.take(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality classifier", good_texts),
    ("exact dedup", no_exact_copies),
    ("simhash near-dedup", no_near_copies),
    ("source mix", mixed_sources),
    ("packing", packed_sequences),
]

#: The classifier, fingerprints, rounding and tokens are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
