"""The evidence of decisions: relational tables, written idempotently, and what is read from them."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCOPE = "fold_id STRING, profile_hash STRING, source_build_id STRING"
TABLES = {
    "feature_registry": "feature_identity STRING, source_dataset STRING, source_build_id STRING, source_catalog_hash STRING, feature_name STRING, role STRING, family STRING, transformation_name STRING, transformation_parameters_json STRING, first_seen_utc TIMESTAMP, lifecycle_status STRING",
    "fold_feature_stats": f"{SCOPE}, feature_name STRING, eligible BOOLEAN, quality_reason STRING, direct_participation BOOLEAN, pc_participation BOOLEAN, pca_credit DOUBLE, representative BOOLEAN, sffs_participation BOOLEAN, final_selection BOOLEAN, ablation_loss DOUBLE",
    "pca_loadings": f"{SCOPE}, family STRING, pc_ordinal INT, source_feature STRING, loading DOUBLE, squared_loading DOUBLE, explained_variance DOUBLE",
    "correlation_mapping": f"{SCOPE}, candidate STRING, chosen_representative STRING, full_abs_correlation DOUBLE, subwindow_1_abs_correlation DOUBLE, subwindow_2_abs_correlation DOUBLE, subwindow_3_abs_correlation DOUBLE, full_support_count BIGINT, subwindow_1_support_count BIGINT, subwindow_2_support_count BIGINT, subwindow_3_support_count BIGINT, retained BOOLEAN, reason STRING",
    "sffs_steps": f"{SCOPE}, state_count INT, step_number INT, action STRING, candidate STRING, selected_tuple_hash STRING, forecast_score DOUBLE, calibration_score DOUBLE, stability_score DOUBLE, robustness_score DOUBLE, total_score DOUBLE, eligible BOOLEAN, rejection_reason STRING",
    "fold_model_stats": f"{SCOPE}, state_count INT, model_family STRING, selected_tuple_hash STRING, valid BOOLEAN, diagnostics_json STRING, tracking_run_id STRING, bundle_hash STRING",
}
SCOPE_KEYS = ["fold_id", "profile_hash", "source_build_id"]
KEYS = {
    "feature_registry": ["feature_identity"],
    "fold_feature_stats": [*SCOPE_KEYS, "feature_name"],
    "pca_loadings": [*SCOPE_KEYS, "family", "pc_ordinal", "source_feature"],
    "correlation_mapping": [*SCOPE_KEYS, "candidate"],
    "sffs_steps": [*SCOPE_KEYS, "state_count", "step_number", "action", "candidate"],
    "fold_model_stats": [*SCOPE_KEYS, "state_count", "model_family"],
}


_LOG = "seq BIGINT, scope STRING, bundle_hash STRING, commits ARRAY<STRING>"


class Conflict(ValueError):
    """A key is stored already, with other values."""


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last writer wins: new's row for a key replaces old's. Both sides are hashed by key once."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__v")))
    return both.withColumn("__rn", rn).filter("__rn = 1").drop("__rn", "__v")


def absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows whose key isn't stored."""
    return new.join(old.select(*keys), keys, "left_anti")


def conflicts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys stored with values other than new's."""
    values = [c for c in new.columns if c not in keys]
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    joined = old.alias("o").join(new.alias("n"), keys)
    return joined.filter(~same).select(*keys)


class EvidenceStore:
    """Tables as Parquet folders, a subfolder per commit, named by its content.

    A commit writes its rows beside the others and then its name into the log, so a reader sees all of a commit or nothing, and the same commit again
    changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> list:
        """(seq, scope, bundle_hash, commits) of every commit, in order. commits are table:folder."""
        try:
            return sorted(set(map(tuple, self.spark.read.schema(_LOG).json(f"{self.root}/_log").select("seq", "scope", "bundle_hash", F.concat_ws(" ", "commits")).collect())))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _commits(self) -> list[str]:
        return [c for row in self._log() for c in row[3].split()]

    def _append(self, log: list, scope: str, bundle_hash: str, commits: list[str]) -> None:
        """One line in one file, which the write's own commit renames into place: readers see all of it or nothing."""
        seq = (log[-1][0] if log else 0) + 1
        self.spark.createDataFrame([(seq, scope, bundle_hash, commits)], _LOG).coalesce(1).write.mode("append").json(f"{self.root}/_log")

    def read(self, table: str) -> DataFrame:
        """The table's rows; of several commits of one key (only an upsert makes them) the last one's."""
        parts = [c.split(":")[1] for c in self._commits() if c.split(":")[0] == table]
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        reader = self.spark.read.schema(TABLES[table])
        if not any(p.startswith("upsert-") for p in parts):
            return reader.parquet(*[f"{self.root}/{table}/{p}" for p in parts])
        out = reader.parquet(f"{self.root}/{table}/{parts[0]}")
        for p in parts[1:]:
            new = reader.parquet(f"{self.root}/{table}/{p}")
            out = upsert(out, new, KEYS[table]) if p.startswith("upsert-") else out.unionByName(new)
        return out

    def _typed(self, table: str, rows: list[dict] | DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], TABLES[table]).schema
        if isinstance(rows, list):
            return self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)
        return rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])

    def commit_fold(self, bundle: dict[str, list[dict]]) -> bool:
        """All six tables of a fold in one commit. False: the same bundle is stored already. Conflict: another bundle of this fold is, or a feature's identity
        has other values. Features that are known are not written again. Until the log has its line, nothing of the bundle is read."""
        if set(bundle) != set(TABLES):
            raise ValueError(f"a bundle has the tables {sorted(TABLES)}")
        scopes = {tuple(r[k] for k in SCOPE_KEYS) for t, rows in bundle.items() if t != "feature_registry" for r in rows}
        if len(scopes) != 1:
            raise ValueError("all rows of a bundle share one fold, profile and build")
        scope = "|".join(map(str, next(iter(scopes))))
        bundle_hash = hashlib.sha256(json.dumps(bundle, sort_keys=True, default=str).encode()).hexdigest()
        log = self._log()
        if stored := {row[2] for row in log if row[1] == scope and not row[2].startswith("upsert")}:
            if stored != {bundle_hash}:
                raise Conflict(f"{scope}: stored with another content")
            return False
        registry = self._typed("feature_registry", bundle["feature_registry"])
        known, keys = self.read("feature_registry"), KEYS["feature_registry"]
        if clash := conflicts(known, registry, keys).limit(1).collect():
            raise Conflict(f"feature_registry: {clash[0].asDict()}")
        commits = []
        for table, rows in bundle.items():
            fresh = absent(known, registry, keys) if table == "feature_registry" else self._typed(table, [r | ({"bundle_hash": bundle_hash} if table == "fold_model_stats" else {}) for r in rows])
            fresh.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{table}/{bundle_hash}")
            commits.append(f"{table}:{bundle_hash}")
        self._append(log, scope, bundle_hash, commits)
        return True

    def upsert(self, table: str, rows: list[dict] | DataFrame) -> bool:
        """Last writer wins by key: rows replace what is stored. False without rows."""
        rows = self._typed(table, rows)
        if rows.groupBy(*KEYS[table]).count().filter("count > 1").limit(1).count():
            raise Conflict(f"{table}: a key twice in one commit")
        log, name = self._log(), f"upsert-{uuid.uuid4().hex}"
        if rows.isEmpty():
            return False
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/{name}")
        self._append(log, "", name, [f"{table}:{name}"])
        return True

    @staticmethod
    def content_hash(rows: DataFrame) -> str:
        """Independent of row order and partitioning."""
        h = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
        total = rows.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
        return f"{total['n']}-{total['h'] or 0}".replace("--", "-m")

    def commit(self, table: str, rows: DataFrame) -> bool:
        """Inserts rows whose keys are absent. False: all were stored already. Raises Conflict if a key has other values."""
        keys = KEYS[table]
        rows = self._typed(table, rows)
        if rows.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise Conflict(f"{table}: a key twice in one commit")
        old = self.read(table)
        if clash := conflicts(old, rows, keys).limit(1).collect():
            raise Conflict(f"{table}: {clash[0].asDict()}")
        fresh = absent(old, rows, keys)
        name = self.content_hash(fresh)
        if name.startswith("0-"):
            return False
        fresh.write.mode("overwrite").parquet(f"{self.root}/{table}/{name}")
        self._append(self._log(), "", name, [f"{table}:{name}"])
        return True

    def ordered(self, table: str) -> DataFrame:
        """The table in its canonical order: by its key."""
        return self.read(table).orderBy(*KEYS[table])

    def tables(self) -> list[str]:
        return sorted({c.split(":")[0] for c in self._commits()})


def with_ablation(stats: DataFrame, losses: DataFrame) -> DataFrame:
    """stats with final_selection and ablation_loss from losses (feature_name, loss), kept where there is none."""
    joined = stats.join(losses, "feature_name", "left")
    joined = joined.withColumn("final_selection", F.col("final_selection") | F.col("loss").isNotNull())
    return joined.withColumn("ablation_loss", F.coalesce("loss", "ablation_loss")).select(*stats.columns)


def pca_credit(loadings: DataFrame, component_losses: DataFrame) -> DataFrame:
    """(feature, credit): each source feature's share of its components' losses, |loss| times squared loading."""
    credit = F.sum(F.abs("loss") * F.col("squared_loading")).alias("credit")
    return loadings.join(component_losses, ["family", "pc_ordinal"]).groupBy(F.col("source_feature").alias("feature")).agg(credit)


def with_credit(stats: DataFrame, credit: DataFrame) -> DataFrame:
    joined = stats.join(credit.withColumnRenamed("feature", "feature_name"), "feature_name", "left")
    return joined.withColumn("pca_credit", F.coalesce("credit", "pca_credit")).select(*stats.columns)


def global_stats(stats: DataFrame, fold: str = "fold_id", by: tuple[str, ...] = ()) -> DataFrame:
    """A row per feature over its folds: counts, rates (NULL without an eligible fold), losses, credit, and folds since the last selection.

    by separates profiles and builds, which are otherwise counted together.
    """
    w = W.partitionBy(*by, "feature_name").orderBy(F.desc(fold))
    rows = stats.withColumn("age", F.row_number().over(w) - 1)
    final, eligible = F.col("final_selection"), F.col("eligible")
    loss = F.when(final, F.col("ablation_loss"))
    out = rows.groupBy(*by, "feature_name").agg(
        F.count("*").alias("folds"), F.count_if(eligible).alias("eligible_folds"), F.count_if(F.col("representative")).alias("representative_folds"),
        F.count_if(F.col("sffs_participation")).alias("sffs_folds"), F.count_if(final).alias("selected_folds"),
        F.avg(loss).alias("mean_loss"), F.median(loss).alias("median_loss"), F.sum(F.when(F.col("pc_participation"), F.col("pca_credit"))).alias("total_credit"),
        F.max(F.when(final, F.col(fold))).alias("last_selected"), F.coalesce(F.min(F.when(final, F.col("age"))), F.count("*")).cast("long").alias("folds_since_selection"),
    )
    return out.withColumn("selection_rate", F.try_divide("selected_folds", "eligible_folds"))


STALE_FOLDS, STALE_CREDIT = 20, 1e-12


def lifecycle(registry: DataFrame, stats: DataFrame, recent: int = STALE_FOLDS, fold: str = "fold_id") -> DataFrame:
    """(feature_name, role, eligible_folds, total_credit, recent_credit, recent_selected, recent_representative, recommended, automatic).

    A transformation is stale if its last recent eligible folds show no selection, no representation and no credit; one
    that was deprecated and shows any is to be reactivated. Core features are only ever recommended for review.
    """
    eligible = stats.filter("eligible").withColumn("age", F.row_number().over(W.partitionBy("feature_name").orderBy(F.desc(fold))))
    now = F.col("age") <= recent
    credit = F.coalesce("pca_credit", F.lit(0.0))
    s = eligible.groupBy("feature_name").agg(
        F.count("*").alias("eligible_folds"), F.sum(credit).alias("total_credit"), F.sum(F.when(now, credit).otherwise(0.0)).alias("recent_credit"),
        F.count_if(now & F.col("final_selection")).alias("recent_selected"), F.count_if(now & F.col("representative")).alias("recent_representative"),
    )
    j = registry.select("feature_name", "role", "lifecycle_status").join(s, "feature_name", "left")
    zero = {c: 0 for c in ("eligible_folds", "recent_selected", "recent_representative")} | {"total_credit": 0.0, "recent_credit": 0.0}
    j = j.na.fill(zero)
    idle = (F.col("recent_selected") == 0) & (F.col("recent_representative") == 0) & (F.col("recent_credit") < STALE_CREDIT)
    stale = (F.col("eligible_folds") >= recent) & idle
    recommended = F.when((F.col("lifecycle_status") == "deprecated") & ~idle, "reactivate").when(stale & (F.col("role") == "transformation"), "deprecate").when(stale, "review").otherwise("keep")
    return j.select(
        "feature_name", "role", "eligible_folds", "total_credit", "recent_credit", "recent_selected", "recent_representative",
        recommended.alias("recommended"), ((F.col("role") == "transformation") & recommended.isin("deprecate", "reactivate")).alias("automatic"),
    )
