"""Runs, parameters and metric points as append-only Parquet tables; diagnostics and reports as JSON."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "runs": "run_id STRING, experiment STRING, name STRING, started TIMESTAMP, status STRING",
    "params": "run_id STRING, key STRING, value STRING",
    "metrics": "run_id STRING, key STRING, step BIGINT, value DOUBLE",
    "artifacts": "run_id STRING, name STRING, body STRING",
}


class Tracking:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, TABLES[table]).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def log(self, experiment: str, name: str, params: dict, metrics: dict[str, list[float] | float], documents: dict[str, object] | None = None, status: str = "FINISHED") -> str:
        """Writes a run whole; a run is in the table only after its parameters, metrics and documents (canonical JSON) are."""
        run = uuid.uuid4().hex
        self._append("params", [(run, k, str(v)) for k, v in sorted(params.items())])
        self._append("metrics", [(run, k, i, float(v)) for k, vs in sorted(metrics.items()) for i, v in enumerate(vs if isinstance(vs, list) else [vs])])
        self._append("artifacts", [(run, k, canonical_json(v)) for k, v in sorted((documents or {}).items())])
        self._append("runs", [(run, experiment, name, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), status)])
        return run

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}")


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON object a line, for a lifecycle report or a fold's diagnostics."""
    rows.coalesce(1).write.mode("errorifexists").json(path)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, no NaN or infinity."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)
