"""Immutable prediction builds: Parquet with a manifest, verified on reading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "profile_id STRING, schema_version STRING, prediction_mode STRING, timestamp TIMESTAMP, state_ids ARRAY<STRING>, state_probabilities ARRAY<DOUBLE>, "
    "dominant_state STRING, confidence DOUBLE, entropy DOUBLE, candidate_id STRING, fold_id STRING, evaluation_plan_hash STRING, "
    "feature_selection_definition_hash STRING, feature_selection_execution_hash STRING"
)


class CorruptBuild(ValueError):
    pass


def _checksum(rows: DataFrame) -> tuple[int, str]:
    """Row count and a hash that doesn't depend on order or files."""
    r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], str(r["h"] or 0)


def publish(rows: DataFrame, root: str, profile: str, build: str, **facts: str) -> dict:
    """Writes a build once: an existing one is an error. The manifest comes last, so a build without it was never published."""
    spark = rows.sparkSession
    path = f"{root}/{profile}/{build}"
    rows = spark.createDataFrame([], SCHEMA).unionByName(rows)
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/predictions")
    n, h = _checksum(spark.read.schema(SCHEMA).parquet(f"{path}/predictions"))
    manifest = {"build_id": build, "profile_id": profile, "row_count": n, "checksum": h, **facts}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value STRING").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest


def exists(spark: SparkSession, root: str, profile: str, build: str) -> bool:
    """Whether the build was published, its manifest included."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{profile}/{build}/manifest/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read(spark: SparkSession, root: str, profile: str, build: str) -> tuple[dict, DataFrame]:
    path = f"{root}/{profile}/{build}"
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/predictions")
    if _checksum(rows) != (manifest["row_count"], manifest["checksum"]):
        raise CorruptBuild(f"{profile}/{build}: rows don't have the manifest's count and checksum")
    return manifest, rows


def oos_slice(rows: DataFrame, start: object, end: object, time: str = "timestamp", p: str = "state_probabilities") -> DataFrame:
    """Rows of [start, end]; any row of the build, in the slice or not, that isn't a distribution is an error."""
    from ..functions.columns import normalised

    bad = rows.filter(~F.coalesce(normalised(F.col(p)), F.lit(False))).limit(1).count()
    if bad:
        raise CorruptBuild("a row's probabilities don't sum to one")
    return rows.filter(F.col(time).between(F.lit(start), F.lit(end)))
