"""Session factory with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and AQE on. Partition counts and memory are the cluster's business unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    return builder.config(map=fixed | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
