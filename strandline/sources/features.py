"""Reading a typed panel: catalog, lineage, request, materialisation rules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA_DISCOVERY, RESOLVED_MODEL = "schema_discovery", "resolved_model"
_NAME = re.compile(r"^[a-z_][a-z0-9_]{0,62}$")


class ContractError(ValueError):
    """The source doesn't hold what its contract says."""


@dataclass(frozen=True)
class Request:
    """What to read: features (all when empty) and inclusive bounds of the time column."""

    features: tuple[str, ...] = ()
    start: object = None
    end: object = None
    mode: str = SCHEMA_DISCOVERY

    def __post_init__(self) -> None:
        if self.mode not in (SCHEMA_DISCOVERY, RESOLVED_MODEL):
            raise ContractError(f"unknown mode {self.mode}")
        if len(set(self.features)) != len(self.features):
            raise ContractError("a feature is requested twice")
        if self.start is not None and self.end is not None and self.start > self.end:
            raise ContractError("start is after end")


class FeatureSource(Protocol):
    def read(self, request: Request) -> DataFrame: ...


def catalog(panel: DataFrame, time: str = "ts") -> DataFrame:
    """(ordinal, name, type) of the panel's features, in order. Only DOUBLE features with plain names are admitted."""
    spark, rows = panel.sparkSession, []
    for field in panel.schema.fields:
        if field.name == time:
            continue
        if field.dataType.simpleString() != "double" or not _NAME.match(field.name):
            raise ContractError(f"{field.name}: {field.dataType.simpleString()}")
        rows.append((len(rows) + 1, field.name, "double"))
    return spark.createDataFrame(rows, "ordinal long, name string, type string")


def violations(panel: DataFrame, time: str = "ts") -> DataFrame:
    """(violations): rows whose time is null or not unique. Order is a key here, not a property, so a repeated key is the only way not to increase."""
    repeated = panel.groupBy(time).agg(F.count("*").alias("n")).filter(F.col(time).isNull() | (F.col("n") > 1))
    return repeated.agg(F.coalesce(F.sum(F.when(F.col(time).isNull(), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).cast("long").alias("violations"))


def finite_or_fail(panel: DataFrame, features: list[str]) -> DataFrame:
    """NULL is missing evidence; NaN and infinities are a breach that stops the query."""

    def checked(name: str):
        x = F.col(name)
        bad = F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"{name}: not finite")).cast("double")).otherwise(x).alias(name)

    return panel.select(*[checked(c) if c in features else F.col(c) for c in panel.columns])


class PanelSource:
    """A FeatureSource over any DataFrame (Parquet, JDBC, ...): projection and bounds are pushed down by the optimizer."""

    def __init__(self, panel: DataFrame, time: str = "ts") -> None:
        self.panel, self.time = panel, time
        self.features = [c for c in panel.columns if c != time]

    def read(self, request: Request) -> DataFrame:
        unknown = set(request.features) - set(self.features)
        if unknown:
            raise ContractError(f"unknown features: {sorted(unknown)}")
        wanted = [c for c in self.features if not request.features or c in request.features]
        rows = self.panel.select(self.time, *wanted)
        if request.start is not None:
            rows = rows.filter(F.col(self.time) >= F.lit(request.start))
        if request.end is not None:
            rows = rows.filter(F.col(self.time) <= F.lit(request.end))
        rows = finite_or_fail(rows, wanted)
        return rows.na.drop("any", subset=wanted) if request.mode == RESOLVED_MODEL else rows

    def skipped(self, request: Request) -> DataFrame:
        """(total, retained, skipped) of the request's rows."""
        rows = self.read(Request(request.features, request.start, request.end))
        features = [c for c in rows.columns if c != self.time]
        complete = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0)) == 0
        counts = rows.agg(F.count("*").alias("total"), F.count_if(complete).alias("retained"))
        return counts.withColumn("skipped", F.col("total") - F.col("retained"))


class SnapshotSource(PanelSource):
    """A source whose reads all see one state: the panel is written to folder once, under its content hash, and every read is of that table.

    A second reader of the same content finds the table; a panel that has changed since is another snapshot.
    """

    def __init__(self, panel: DataFrame, folder: str, time: str = "ts") -> None:
        self.lineage = lineage(panel, folder, "snapshot", time).first().asDict()
        path = f"{folder.rstrip('/')}/{self.lineage['data_sha256']}"
        try:
            panel.write.mode("errorifexists").parquet(path)
        except Exception as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
        pinned = panel.sparkSession.read.schema(panel.schema).parquet(path)
        if lineage(pinned, folder, "snapshot", time).first().asDict() != self.lineage:
            raise ContractError("the source changed while its snapshot was written")
        super().__init__(pinned, time)

    def read_with_catalog(self, request: Request) -> tuple[DataFrame, DataFrame]:
        """(catalog, rows) of the same snapshot."""
        return catalog(self.panel, self.time), self.read(request)

    def read_all_with_catalog(self, start: object = None, end: object = None) -> tuple[DataFrame, DataFrame]:
        return self.read_with_catalog(Request((), start, end))


def jdbc(spark: SparkSession, url: str, relation: str, time: str, lower: str, upper: str, partitions: int, timeout_s: int = 60, **options: str) -> DataFrame:
    """A panel over JDBC, read in ranges of the time column."""
    fixed = {"partitionColumn": time, "lowerBound": lower, "upperBound": upper, "numPartitions": str(partitions), "queryTimeout": str(timeout_s)}
    return spark.read.format("jdbc").options(url=url, dbtable=relation, **fixed, **options).load()


def lineage(panel: DataFrame, dataset: str, build_id: str, time: str = "ts") -> DataFrame:
    """One row: dataset, build, content hash, row count and bounds. The hash doesn't depend on row order: a sum of row hashes."""
    row_hash = F.xxhash64(*panel.columns).cast("decimal(38,0)")
    return panel.agg(
        F.lit(dataset).alias("source_dataset"), F.lit(build_id).alias("source_build_id"), F.count("*").alias("row_count"),
        F.min(time).alias("min_timestamp"), F.max(time).alias("max_timestamp"),
        F.sha2(F.concat_ws("|", F.lit("1"), *[F.lit(c) for c in panel.columns], F.coalesce(F.sum(row_hash), F.lit(0)).cast("string")).cast("binary"), 256).alias("data_sha256"),
    )


def lookup_lineage(control: DataFrame, dataset: str, schema_version: int, feature_version: int) -> dict:
    """The one row of a control table for dataset, or an error."""
    rows = control.filter(F.col("source_dataset") == dataset).limit(2).collect()
    if len(rows) != 1:
        raise ContractError(f"{len(rows)} lineage rows for {dataset}")
    if (rows[0]["schema_version"], rows[0]["feature_version"]) != (schema_version, feature_version):
        raise ContractError("versions differ")
    return rows[0].asDict()


def latest_gap(panel: DataFrame, time: str = "ts"):
    """Largest step between neighbouring times, for monitoring."""
    step = F.datediff(F.col(time), F.lag(time).over(W.orderBy(time)))
    return panel.select(time).select(step.alias("step")).agg(F.max("step").alias("largest_step"))
