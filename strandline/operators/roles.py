"""Roles of features by the grammar of their names. The grammar is configuration: a profile names the core set and the families."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE, TRANSFORMATION, GENERATED = "core", "transformation", "generated"


@dataclass(frozen=True)
class RoleProfile:
    core: tuple[str, ...]
    families: tuple[str, ...]
    time: str = "ts"

    @property
    def ordered(self) -> tuple[str, ...]:
        """Longest first, so that a family whose name begins with another's is recognised."""
        return tuple(sorted(self.families, key=lambda f: (-len(f), f)))


def raw_universe(names: DataFrame, name: str = "name") -> DataFrame:
    """names without those of global components, which are made and never read from a source."""
    return names.filter(~F.col(name).rlike(r"^pca_pc_[0-9]{3}$"))


def family_of(name: Column, profile: RoleProfile) -> Column:
    expr = F.when(F.lit(False), F.lit(""))
    for f in profile.ordered:
        expr = expr.when(name.startswith(f + "_"), f)
    return expr


def classify(names: DataFrame, profile: RoleProfile, name: str = "name") -> DataFrame:
    """names with role and family. A name outside the grammar has the role NULL; require() turns that into an error."""
    n = F.col(name)
    family = family_of(n, profile)
    role = (
        F.when(n.isin(*profile.core), CORE)
        .when(n.rlike(r"^family_pc_[a-z0-9_]+_[1-8]$") | n.rlike(r"^pca_pc_[0-9]{3}$"), GENERATED)
        .when(family.isNotNull() & n.rlike(r"^[a-z0-9_]+_[0-9]+$"), TRANSFORMATION)
    )
    return names.withColumn("role", role).withColumn("family", F.when(role == TRANSFORMATION, family))


def require(classified: DataFrame, profile: RoleProfile, name: str = "name") -> DataFrame:
    """classified, or an error for an unknown name or a missing core feature."""
    unknown = [r[0] for r in classified.filter("role IS NULL").select(name).limit(5).collect()]
    missing = missing_core(classified, profile, name).limit(5).collect()
    if unknown or missing:
        raise ValueError(f"unknown names {unknown}; missing core {[r[0] for r in missing]}")
    return classified


def missing_core(classified: DataFrame, profile: RoleProfile, name: str = "name") -> DataFrame:
    core = classified.sparkSession.createDataFrame([(c,) for c in profile.core], f"{name} string")
    return core.join(classified.filter(F.col("role") == CORE), name, "left_anti")


def breaches(assigned: DataFrame, stage_roles: DataFrame) -> DataFrame:
    """Rows (stage, name, role) whose role their stage doesn't admit."""
    return assigned.join(F.broadcast(stage_roles), ["stage", "role"], "left_anti")


def provenance(names: DataFrame, profile: RoleProfile, name: str = "name") -> DataFrame:
    """(feature_identity, name, transformation, parameters): what the name says was computed, and a content hash of it."""
    rows = classify(names, profile, name).filter(F.col("role") == TRANSFORMATION)
    number = F.regexp_extract(name, r"_([0-9]+)$", 1)
    base = F.regexp_replace(name, r"_[0-9]+$", "")
    inner = F.substring(base, F.length("family") + 2, F.length(base))
    rows = rows.select(name, F.when(inner != "", inner).otherwise(F.col("family")).alias("transformation"), number.cast("long").alias("window"), "family")
    text = F.concat_ws("|", "family", "transformation", F.col("window").cast("string"), name)
    return rows.select(F.sha2(text.cast("binary"), 256).alias("feature_identity"), name, "family", "transformation", "window")
