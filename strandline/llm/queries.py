"""The registered queries of the corpus operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fingerprints, langid, licenses, mixing, neardup, neighbours, pieces, quality, sharding, warc


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_pieces(spark: SparkSession, sf_dir: str, model: str = pieces.DEFAULT_MODEL) -> DataFrame:
    return pieces.encode(common.table(spark, sf_dir, "documents"), pieces.load(model))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(common.table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.id_remainder("doc_id", 4) == 2
    found = langid.predict(docs, langid.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("score"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_pieces, op3_neighbours, op4_licenses, op5_near_duplicates, op6_warc, op7_sharding, op8_mixing, op9_language, op10_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op4_licenses": licenses.oracle(), "op6_warc": warc.ORACLE, "op8_mixing": mixing.ORACLE}
