"""Corpus pipeline: stages that turn documents into packed training sequences.

Defined results: a document without text or without a letter has no language and is dropped by the
first stage. A null source is a source of its own; a null language is filled in by the first stage.
Repeated rows are copies of each other, of which the second stage keeps one. Of equal candidates the
smallest ``doc_id`` stays, null last. An empty table gives no rows. Long texts are read whole. Extra
columns, whatever their names, pass through all stages but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import credentials, curriculum, langid, order_minhash, slack_packing
from siltstone.llm.common import discard, read_table, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language."""
    return langid.keep_identified(docs, langid.fit_documents(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    return order_minhash.first_of_class(docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace found credentials in the texts."""
    return credentials.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave documents so that sources meet their targets, in training order."""
    return curriculum.whole_in_training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut and pack every document."""
    return slack_packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", scan_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    *stages, (_, last) = STAGES
    for number, (_, apply) in enumerate(stages, 1):
        before, docs = docs, stage(apply(spark, docs, sf_dir), f"pipeline-{number}")
        discard(before)  # nothing reads a stage's table once the next one stands
    return last(spark, docs, sf_dir)
