"""A training-data pipeline over ``documents``: each stage reads what its predecessor kept.

quality        drops documents that the classifier rejects
near_dedup     keeps one document (the smallest id) of each near-duplicate group
decontaminate  drops documents that hold a benchmark item
secrets        masks credentials in the texts
packing        packs the rest into token sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate as _decontaminate
from tessera.llm import packing as _packing
from tessera.llm import quality as _quality
from tessera.llm import secret_scan as _secrets
from tessera.llm import simhash_dedup as _simhash
from tessera.llm.queries import vocabulary
from tessera.session import durable
from tessera.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more, all columns as they are.

    A null or empty text scores like a text without words; ties don't arise, equal texts score
    alike and repeated rows stay repeated. Without labels every score is 0.5, so all stay.
    """
    model = _quality.train_model(docs, read_table(spark, sf_dir, "labels"))
    return _quality.keep_good(docs, model, threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group, all columns as they are.

    Null and empty texts are copies of each other; rows without an id stay; of repeated rows of
    a kept id the one of the smallest text, then of the smallest other columns, stays.
    """
    return _simhash.keep_one(docs, words=4, radius=4, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, all columns as they are.

    The text alone decides, so ids may be null or repeated; null and empty texts hold nothing.
    An empty benchmark removes nothing.
    """
    return _decontaminate.without_contamination(docs, read_table(spark, sf_dir, "benchmark"), words=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials in their texts masked and n_chars counted anew; null texts stay null, other columns as they are."""
    return _secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens; a null text is an empty one (its end id alone), repeated rows give repeated pieces."""
    return _packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: SQL expresses neither the classifier nor the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stored before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
