"""The corpus pipeline: five of the corpus operators in a row, each stage written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common, langid, mixing, neardup, pieces, quality

#: None: near-duplicate signatures, EM and a trained network are not SQL. tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without an identifiable language: null texts and those without a letter. lang, where null, becomes the prediction."""
    held_out = common.id_remainder("doc_id", 4) == 2
    return langid.identified(docs, langid.fit(docs.filter(~held_out)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores below its threshold."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.accepted(docs, *model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode(docs, pieces.load(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    began = common.folders()
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        common.release(spark, began, common.folders() - 1)  # what the stage wrote on its way, and the table it read
    return docs
