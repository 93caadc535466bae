"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.llm import backoff, decontamination, licenses, merkle, packing, pivots, sentence_spans, simhash, substrings, token_counts, token_files, toxicity, whitening
from punctual.llm.common import read

BYTE_BPE = "byte_bpe_50k.json"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return token_files.encode_to_files(docs, public_tokenizers.path(BYTE_BPE))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.find(docs, read(spark, sf_dir, "benchmark")))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The documents as files below their source and language, a hundred to a directory.
    path = F.concat_ws(
        "/", "source", "lang", F.floor(F.col("doc_id") / 100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    )
    return licenses.scan(read(spark, sf_dir, "documents").withColumn("path", path), ["doc_id"])


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.remove_repeats(docs).select(
        "doc_id", "__kept.n_sentences", "__kept.n_removed", F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_decontamination, op3_substrings, op4_simhash, op5_pivots, op6_toxicity, op7_licenses, op8_sentence_spans, op9_packing, op10_backoff, op11_whitening, op12_merkle, op13_token_counts)}
SQL: dict[str, str] = {"op7_licenses": licenses.oracle(), "op12_merkle": merkle.oracle()}
