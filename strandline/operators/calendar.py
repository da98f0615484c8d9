"""Expanding calendar-month walk-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import local_month

MIN_TRAIN = 1260
ZONE = "Europe/Berlin"


def plan_folds(panel: DataFrame, min_train: int = MIN_TRAIN, cutoff: object = None, zone: str = ZONE, time: str = "ts") -> DataFrame:
    """A row per fold: TRAIN is every row up to a month's end, TEST the next calendar month, present and closed.

    A month is closed if the source's cutoff (its last time unless given) falls on or after the month's last local day.
    Months without a successor, or with fewer than min_train rows of TRAIN, give no fold; ids are dense. The panel is
    reduced to one row per month by a partial aggregation; the windows run over months.
    """
    local_day = lambda ts: F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("date")
    months = panel.groupBy(local_month(F.col(time), zone).alias("month")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))
    order = W.orderBy("month")
    months = (
        months.withColumn("train_n", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("train_first", F.min("first").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("end", F.max("last").over(W.partitionBy()) if cutoff is None else F.lit(cutoff))
    )
    for name, source in (("test_month", "month"), ("test_first", "first"), ("test_last", "last"), ("test_n", "n")):
        months = months.withColumn(name, F.lead(source).over(order))
    folds = months.filter(
        (F.col("test_month") == F.add_months("month", 1)) & (F.col("train_n") >= min_train) & (local_day(F.col("end")) >= F.last_day("test_month"))
    )
    number = (F.row_number().over(order) - 1).cast("long")
    text = lambda c: F.date_format(c, "yyyy-MM")
    return folds.select(
        F.concat(F.lit("fold_"), F.lpad(number.cast("string"), 3, "0")).alias("fold_id"),
        text("month").alias("train_month"), text("test_month").alias("test_month"),
        "train_first", F.col("last").alias("train_cutoff"), "test_first", "test_last", "train_n", "test_n",
    )


def fold_rows(panel: DataFrame, folds: DataFrame, time: str = "ts") -> DataFrame:
    """panel's rows in each fold, with fold_id and part (train or test). folds has a row per month at most, so it is broadcast."""
    f = F.broadcast(folds.select("fold_id", "train_first", "train_cutoff", "test_first", "test_last"))
    inside = F.col(time).between(F.col("train_first"), F.col("test_last"))
    part = F.when(F.col(time) <= F.col("train_cutoff"), "train").when(F.col(time) >= F.col("test_first"), "test")
    return panel.join(f, inside).withColumn("part", part).select("fold_id", "part", *panel.columns)


def fold_counts(panel: DataFrame, folds: DataFrame, time: str = "ts") -> DataFrame:
    rows = fold_rows(panel.select(time), folds, time)
    return rows.groupBy("fold_id").agg(F.count_if(F.col("part") == "train").alias("train_n"), F.count_if(F.col("part") == "test").alias("test_n"))


def train_only(panel: DataFrame, start: object, cutoff: object, time: str = "ts") -> DataFrame:
    """panel, with an error for a row outside the bounds: a fit never drops what it should not have been given."""
    inside = F.col(time).between(F.lit(start), F.lit(cutoff))
    return panel.withColumn(time, F.when(inside, F.col(time)).otherwise(F.raise_error(F.lit("row outside TRAIN")).cast(panel.schema[time].dataType)))


def package_for_month(packages: DataFrame, month: str) -> DataFrame:
    """The package that serves a month: the latest one available for it or earlier."""
    rows = packages.filter(F.col("available_for_test_month") <= month)
    return rows.agg(F.max_by(F.struct(*packages.columns), "available_for_test_month").alias("p")).filter("p IS NOT NULL").select("p.*")
