"""Training-data pipeline over ``documents``: quality, line dedup, near-duplicates, decontamination, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which the caller
writes and gives to the next as docs.  All but the last return the columns of ``documents``.  Stages work on all rows
they get; nothing is learnt from rows that an earlier stage has not kept, but for the labels of the quality classifier.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from groundling.llm import decontaminate, line_dedup, near_text, packing, quality
from groundling.llm.common import cut

#: Words that a worker of the packing stage remembers: fewer than in a job of its own, since it comes after other stages.
MEMO_WORDS = 200_000


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the classifier's threshold; it learns from the labelled rows outside the held-out fold."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many documents hold; documents stay, even if nothing is left of their text."""
    return line_dedup.line_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_text.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo=MEMO_WORDS)


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: The stages hash, learn and tokenise, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
