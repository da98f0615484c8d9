"""Panels over the star-schema tables: one row per time, DOUBLE columns, NULL where evidence is missing.

Daily sums are rounded to the cents they are made of, so a panel's values don't depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}
FLAGS = ("A", "N", "R")
STATUSES = ("F", "O", "P")
EVENTS = ("click", "error", "purchase", "signup", "view")
DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(value: Column) -> Column:
    return F.round(F.sum(value), 2)


def _mean(value: Column) -> Column:
    """Sum over count of the non-null values; NULL without any."""
    return F.try_divide(_cents(value), F.count(value).cast("double"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, a sum of order prices per priority (NULL on days without one), total and n_orders."""
    price = F.col("o_totalprice")
    by_priority = [_cents(F.when(F.col("o_orderpriority") == p, price)).alias(name) for name, p in PRIORITIES.items()]
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ts"))
    return days.agg(*by_priority, _cents(price).alias("total"), F.count("*").cast("double").alias("n_orders"))


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, mean price, discount, tax and quantity of the day, and mean price per return flag."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("ts"))
    means = [_mean(F.col(f"l_{c}")).alias(name) for name, c in (("price", "extendedprice"), ("discount", "discount"), ("tax", "tax"), ("quantity", "quantity"))]
    by_flag = [_mean(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice"))).alias(f"price_{f.lower()}") for f in FLAGS]
    return days.agg(*means, *by_flag)


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (hour), mean value per event type (NULL where none happened)."""
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"))
    return hours.agg(*[_mean(F.when(F.col("event_type") == e, F.col("value"))).alias(e) for e in EVENTS])


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x01 to x64."""
    columns = [F.col("embedding")[k].cast("double").alias(f"x{k + 1:02d}") for k in range(DIMENSIONS)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *columns)


def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold_feature_stats schema, derived: a fold is a month, a feature a priority, and flags come from the month's cents."""
    orders = table(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = orders.groupBy(month.alias("fold_id"), F.col("o_orderpriority").alias("feature_name")).agg(
        F.round(F.sum("o_totalprice") * 100).cast("long").alias("c")
    )
    c = F.col("c")
    return (
        rows.withColumn("eligible", c % 10 != 0)
        .withColumn("quality_reason", F.when(~F.col("eligible"), "coverage_below_minimum"))
        .withColumn("direct_participation", F.col("eligible") & (c % 2 == 0))
        .withColumn("pc_participation", F.col("eligible") & (c % 3 == 0))
        .withColumn("pca_credit", F.when(F.col("pc_participation"), (c % 1000).cast("double") / 1000))
        .withColumn("representative", F.col("eligible") & (c % 5 < 3))
        .withColumn("sffs_participation", F.col("eligible") & (c % 7 < 5))
        .withColumn("final_selection", F.col("sffs_participation") & (c % 11 < 4))
        .withColumn("ablation_loss", F.when(F.col("final_selection"), ((c % 2001) - 1000).cast("double") / 1000))
    )


def prob_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, p (shares of the day's line prices by return flag), q (of its order prices by status); days where all shares exist."""

    def shares(name: str, day: str, key: str, values: tuple[str, ...], price: str) -> DataFrame:
        sums = [_cents(F.when(F.col(key) == v, F.col(price))).alias(f"s{k}") for k, v in enumerate(values)]
        days = table(spark, sf_dir, name).groupBy(F.col(day).cast("date").alias("ts")).agg(*sums)
        columns = [F.col(f"s{k}") for k in range(len(values))]
        total = sum(columns[1:], columns[0])
        return days.filter(total > 0).select("ts", F.array(*[x / total for x in columns]).alias("v"))

    p = shares("lineitem", "l_shipdate", "l_returnflag", FLAGS, "l_extendedprice").withColumnRenamed("v", "p")
    q = shares("orders", "o_orderdate", "o_orderstatus", STATUSES, "o_totalprice").withColumnRenamed("v", "q")
    return p.join(q, "ts")
