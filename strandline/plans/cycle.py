"""One pass of the model's life: nothing if the source is unchanged, else evaluate, refit, publish and register."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import features, predictions
from ..sources.registry import Registry, package
from . import refit


@dataclass(frozen=True)
class Outcome:
    changed: bool
    version: int | None = None
    build: str | None = None
    valid_folds: int = 0
    results: str = ""


def build_id(results: list[refit.FoldResult]) -> str:
    return hashlib.sha256(f"walk_forward:{refit.result_hash(results)}".encode()).hexdigest()[:16]


def publish_oos(spark: SparkSession, panel: DataFrame, results: list[refit.FoldResult], builds: str, name: str, source: str, time: str = "ts") -> str:
    """Publishes the union of the valid folds' TEST months, once: the same results have the same build."""
    build = build_id(results)
    if not predictions.exists(spark, builds, name, build):
        predictions.publish(refit.oos_rows(panel, results, name, time), builds, name, build, source_data_sha256=source, result_hash=refit.result_hash(results))
    return build


def deploy(spark: SparkSession, panel: DataFrame, newest: refit.FoldResult, settings: refit.Settings, registry: Registry, name: str, source: str, min_rows: int, time: str = "ts", tracking=None) -> int:
    """Refits exactly what the newest valid fold selected, its components included, and registers it. With tracking, package and version are one run's."""
    found = refit.final_refit(spark, panel, list(newest.selected), newest.states, newest.family, seeds=settings.seeds, min_rows=min_rows, time=time, fits=newest.fits)
    facts = {"data_sha256": source, "evaluation": newest.package, "profile_hash": settings.profile_hash}
    pack = package(found["model"], found["features"], found["scaler"], found["trained_through"].isoformat(), found["alpha"], facts, found["pca"])
    version = registry.register(name, pack)
    if tracking is not None:
        tracking.log("deploy", name, {"version": version, "package_hash": pack["package_hash"], "fold": newest.fold_id}, {"rows": float(found["rows"])}, {"package.json": pack})
    return version


def run_cycle(spark: SparkSession, panel: DataFrame, settings: refit.Settings, registry: Registry, name: str, builds: str, last_folds: int | None = None, min_rows: int = refit.MIN_REFIT_ROWS, time: str = "ts", store=None, tracking=None) -> Outcome:
    source = features.lineage(panel, name, "current", time).first()["data_sha256"]
    known = registry.versions(name)
    if known and registry.load(name, known[-1])["lineage"].get("data_sha256") == source:
        return Outcome(False, known[-1])
    results = refit.run_monthly(spark, panel, settings, last=last_folds, time=time, source=source, store=store, tracking=tracking)
    valid = [r for r in results if r.valid]
    if not valid:
        return Outcome(True, results=refit.result_hash(results))
    build = publish_oos(spark, panel, results, builds, name, source, time)
    version = deploy(spark, panel, valid[-1], settings, registry, name, source, min_rows, time, tracking)
    return Outcome(True, version, build, len(valid), refit.result_hash(results))
