"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.llm import (
    embedding,
    exact,
    language_model,
    lines,
    mixing,
    packing,
    pii,
    prefix_trie,
    quality,
    simhash,
    substring,
    toxicity,
    whitening,
)
from pricemill.llm.common import crc_part, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def sha_hex(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


@query
def op1_line_dedup(spark, folder):
    found = lines.line_dedup(read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", sha_hex("kept_text").alias("kept_sha256"))


@query
def op2_curve_packing(spark, folder):
    return packing.pack(read_table(spark, folder, "documents"), tokenizer_file())


@query
def op3_simhash_dedup(spark, folder):
    return simhash.fingerprint_groups(read_table(spark, folder, "documents"))


@query
def op4_compression_quality(spark, folder):
    docs = read_table(spark, folder, "documents")
    model = quality.fit_quality(docs, read_table(spark, folder, "labels"))
    held_out = F.coalesce(crc_part("doc_id", 4) == 2, F.lit(False))
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op5_exact_dedup(spark, folder):
    return exact.exact_groups(read_table(spark, folder, "documents"))


@query
def op6_personal_data(spark, folder):
    found = pii.find_personal_data(read_table(spark, folder, "documents"))
    return found.withColumn("base_sha256", sha_hex("base_spans")).drop("base_spans")


@query
def op7_substring_dedup(spark, folder):
    found = substring.substring_dedup(read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op8_lm_scoring(spark, folder):
    return language_model.score_texts(read_table(spark, folder, "documents"))


@query
def op9_source_mix(spark, folder):
    found = mixing.mix(read_table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source", "source_size", "target", "copies", "taken")


@query
def op10_embedding_dedup(spark, folder):
    return embedding.near_vectors(read_table(spark, folder, "embeddings"))


@query
def op11_embedding_whitening(spark, folder):
    return whitening.whiten(read_table(spark, folder, "embeddings"))


@query
def op12_factor_toxicity(spark, folder):
    docs = read_table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, read_table(spark, folder, "labels"))
    held_out = F.coalesce(crc_part("doc_id", 4) == 2, F.lit(False))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op13_conversation_trie(spark, folder):
    return prefix_trie.prefix_trie(read_table(spark, folder, "conversations"))


@query
def pipeline(spark, folder):
    from corpus_pipeline import run

    return run(spark, folder)
