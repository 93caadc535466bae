"""From raw documents to packed training sequences: five stages, each one operator.

Every stage takes the documents that its predecessor left and returns the columns of
``documents``; the last returns packed pieces. ``run`` writes each stage's rows to the shared
folder and reads them again. Rows without ``doc_id`` or text stay until they are packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from punctual.llm import decontamination, packing, sentence_spans, simhash, toxicity
from punctual.llm.common import read, stored
from punctual.llm.queries import BYTE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below the threshold."""
    grammar = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar, column="__score").filter(
        F.col("__score") < toxicity.THRESHOLD
    ).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints the document with the smallest ``doc_id``."""
    found = stored(simhash.near_duplicates(docs), "near-duplicates")
    later = found.filter("doc_id <> component_id").select("doc_id").distinct()
    # Rows with one doc_id are a group as well.
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one_each = (
        docs.join(repeated, "doc_id", "left_semi").join(later, "doc_id", "left_anti")
        .withColumn("__number", F.row_number().over(first)).filter("__number = 1")
    )
    alone = docs.join(later.unionByName(repeated).distinct(), "doc_id", "left_anti")
    return alone.select(*docs.columns).unionByName(one_each.select(*docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of repeated passages; ``n_chars`` follows."""
    kept = sentence_spans.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontamination.find(docs, read(spark, sf_dir, "benchmark"), column="__found")
    return found.filter(F.col("__found.n_hit") == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL has no tokenizer, no learned grammar and no graph components: tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
