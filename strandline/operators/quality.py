"""Feature quality on TRAIN rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.features import finite_or_fail

MIN_COVERAGE, MIN_VARIANCE, MIN_FEATURES = 0.90, 1e-12, 3
LOW_COVERAGE, LOW_VARIANCE = "coverage_below_minimum", "variance_below_or_equal_minimum"


def feature_quality(panel: DataFrame, features: list[str], min_coverage: float = MIN_COVERAGE, min_variance: float = MIN_VARIANCE) -> DataFrame:
    """(feature, finite_count, source_rows, coverage, variance, eligible, reason): coverage decides first, then population variance.

    Columns become rows inside each task and one partial aggregation by feature follows, so width costs no plan size.
    """
    rows = finite_or_fail(panel.select(*features), features).unpivot([], features, "feature", "value")
    stats = rows.groupBy("feature").agg(F.count("value").alias("finite_count"), F.count("*").alias("source_rows"), F.var_pop("value").alias("variance"))
    stats = stats.withColumn("coverage", F.col("finite_count") / F.col("source_rows"))
    low_variance = F.col("variance").isNull() | (F.col("variance") <= min_variance)
    reason = F.when(F.col("coverage") < min_coverage, LOW_COVERAGE).when(low_variance, LOW_VARIANCE)
    return stats.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def enough_features(quality: DataFrame, minimum: int = MIN_FEATURES) -> bool:
    """Gate: whether at least minimum features are eligible."""
    return quality.filter("eligible").limit(minimum).count() >= minimum


def train_scaler(rows: DataFrame, features: list[str], by: tuple[str, ...] = ("fold_id",)) -> DataFrame:
    """(*by, feature, n, mean, variance, scale) with population variance; a constant feature's scale is 1."""
    long = rows.unpivot(list(by), features, "feature", "value")
    stats = long.groupBy(*by, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    return stats.withColumn("scale", F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0))


def scaled(panel: DataFrame, features: list[str]) -> DataFrame:
    """panel's complete rows, features replaced by z-scores over those rows."""
    complete = panel.na.drop("any", subset=features)
    stats = complete.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("v", F.var_pop))])
    z = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"v_{c}") > 0, F.sqrt(f"v_{c}")).otherwise(1.0)).alias(c) for c in features]
    others = [c for c in panel.columns if c not in features]
    return complete.crossJoin(F.broadcast(stats)).select(*others, *z)  # stats is one row
