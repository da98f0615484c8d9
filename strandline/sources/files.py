"""Panels from files other than Parquet."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def arrow_ipc(spark: SparkSession, path: str) -> DataFrame:
    """A small Arrow IPC snapshot on the driver. Larger inputs are read as Parquet, by tasks."""
    with pa.memory_map(path) as source:
        try:
            table = pa.ipc.open_file(source).read_all()
        except pa.ArrowInvalid:
            source.seek(0)
            table = pa.ipc.open_stream(source).read_all()
        return spark.createDataFrame(table)


def text_panel(spark: SparkSession, path: str, features: list[str], kind: str = "csv", time: str = "ts") -> DataFrame:
    """CSV with a header, JSON lines, or ORC, with the schema stated rather than inferred."""
    schema = f"{time} TIMESTAMP, " + ", ".join(f"{f} DOUBLE" for f in features)
    reader = spark.read.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, mode="FAILFAST")
    return reader.json(path, mode="FAILFAST") if kind == "json" else reader.format(kind).load(path)
