"""A training-data pipeline over ``documents``: five stages, each reading what the one before wrote.

language ID -> quality classifier -> near-duplicates -> mixing to target weights -> best-fit packing.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lotflow.llm import language, mixing, packing, quality, simhash
from lotflow.runtime import shared_checkpoint_dir, table


#: By how much of its phrases the runner-up must need more, for a language to be told.
LEAST_MARGIN = 0.02


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, named where ``lang`` is null; those without a letter, or alike in two, go."""
    return language.told(docs, LEAST_MARGIN)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    return quality.good_only(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 alike), that with the smallest doc_id."""
    return simhash.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, a partly taken one with the words it takes."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document of the mix goes."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the models and hashes of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and goes after the next.

    Null and empty texts go in the first stage, so no later one meets them from ``documents``. Rows with a null id are
    judged like others but never taken for copies; repeated rows are copies. Extra columns of any names come through all
    stages but the last. An empty table gives an empty result.
    """
    base = f"{shared_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if before:
            _discard(spark, before)
        before = f"{base}/{k}-{name}"
    return docs


def _discard(spark: SparkSession, folder: str) -> None:
    """Delete what a stage wrote once the next one's result is written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
