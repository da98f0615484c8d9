"""Diagnostics of probability series and of features against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

MIN_HARD, MIN_SOFT = 0.03, 0.05
BINS = 10


def uncertainty(rows: DataFrame, p: str = "p", keep: tuple[str, ...] = ("ts",)) -> DataFrame:
    v = F.col(p)
    c = C.confidence(v)
    return rows.select(*keep, c.alias("confidence"), C.entropy(v).alias("entropy"), (c < C.LOW_CONFIDENCE).alias("low_confidence"), C.dominant(v).alias("dominant"))


def occupancy(rows: DataFrame, p: str = "p") -> DataFrame:
    """(state, hard, soft): share of rows it dominates and its mean probability. A state that never dominates has hard 0."""
    each = rows.select(C.dominant(F.col(p)).alias("d"), F.posexplode(p).alias("state", "v"))
    return each.groupBy(F.col("state").cast("long").alias("state")).agg(F.avg((F.col("d") == F.col("state")).cast("double")).alias("hard"), F.avg("v").alias("soft"))


def occupancy_ok(rows: DataFrame, p: str = "p") -> bool:
    return occupancy(rows, p).filter((F.col("hard") < MIN_HARD) | (F.col("soft") < MIN_SOFT)).limit(1).count() == 0


def durations(rows: DataFrame, p: str = "p", time: str = "ts") -> DataFrame:
    """(run, state, length) of consecutive rows with one dominant state, runs from 1. One series is ordered as a whole; only time and state pass."""
    w = W.orderBy("t")
    states = rows.select(F.col(time).alias("t"), C.dominant(F.col(p)).cast("long").alias("state"))
    changed = (F.col("state") != F.lag("state").over(w)).cast("long")
    runs = states.withColumn("c", F.coalesce(changed, F.lit(1))).withColumn("run", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.groupBy("run", "state").agg(F.count("*").alias("length"))


def switch_rate(rows: DataFrame, p: str = "p", time: str = "ts") -> DataFrame:
    """(switches, days, per_year)."""
    w = W.orderBy("t")
    states = rows.select(F.col(time).alias("t"), C.dominant(F.col(p)).alias("state"))
    changed = (F.col("state") != F.lag("state").over(w)).cast("long")
    out = states.withColumn("c", F.coalesce(changed, F.lit(0))).agg(F.sum("c").alias("switches"), C.elapsed_days(F.min("t"), F.max("t")).alias("days"))
    return out.withColumn("per_year", F.try_divide(F.col("switches") * C.DAYS_PER_YEAR, F.col("days")))


def soft_nmi(rows: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """(nmi, shared): mutual information of two soft assignments over the square root of their entropies' product; NULL for a degenerate one.

    The joint distribution is the mean outer product: a few sums, combined in each task.
    """
    cells = rows.select(F.posexplode(p).alias("k", "a"), F.col(q)).select("k", "a", F.posexplode(q).alias("l", "b"))
    n = rows.agg(F.count("*").alias("n"))
    joint = cells.groupBy("k", "l").agg(F.sum(F.col("a") * F.col("b")).alias("m")).crossJoin(F.broadcast(n))  # n is one row
    joint = joint.withColumn("m", F.col("m") / F.col("n"))
    joint = joint.withColumn("r", F.sum("m").over(W.partitionBy("k"))).withColumn("c", F.sum("m").over(W.partitionBy("l")))
    rows_of, columns_of = F.count("*").over(W.partitionBy("k")), F.count("*").over(W.partitionBy("l"))
    log = lambda x: F.when(x > 0, F.ln(x)).otherwise(0.0)
    joint = joint.withColumn("nl", rows_of).withColumn("nk", columns_of)
    out = joint.agg(
        F.sum(F.when(F.col("m") > 0, F.col("m") * F.ln(F.col("m") / (F.col("r") * F.col("c")))).otherwise(0.0)).alias("mi"),
        F.sum(-F.col("r") * log(F.col("r")) / F.col("nl")).alias("hp"), F.sum(-F.col("c") * log(F.col("c")) / F.col("nk")).alias("hq"), F.max("n").alias("shared"),
    )
    return out.select(F.try_divide("mi", F.sqrt(F.col("hp") * F.col("hq"))).alias("nmi"), "shared")


def support(series: DataFrame, teacher: DataFrame, time: str = "ts") -> DataFrame:
    """(shared, total, coverage) of the teacher's times."""
    have = series.select(F.col(time).alias("t")).distinct().withColumn("have", F.lit(1))
    out = teacher.select(F.col(time).alias("t")).distinct().join(have, "t", "left").agg(F.count("have").alias("shared"), F.count("*").alias("total"))
    return out.withColumn("coverage", F.try_divide("shared", "total"))


def _scored(features: DataFrame, names: list[str], teacher: DataFrame, time: str, p: str) -> DataFrame:
    joined = features.select(time, *names).join(teacher.select(time, F.col(p).alias("p")), time)
    return joined.unpivot([time, "p"], names, "feature", "x").filter("x IS NOT NULL")


def information_ratio(features: DataFrame, names: list[str], teacher: DataFrame, time: str = "ts", p: str = "p") -> DataFrame:
    """(feature, ratio, support): mutual information of rank bins and states, over the states' entropy."""
    rows = _scored(features, names, teacher, time, p)
    by = W.partitionBy("feature")
    rank = F.rank().over(by.orderBy("x")) + (F.count("*").over(W.partitionBy("feature", "x")) - 1) / 2
    n = F.count("*").over(by)
    rows = rows.select("feature", "p", rank.alias("r"), n.alias("n"))
    rows = rows.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(BINS * (F.col("r") - 1) / F.col("n"))))
    cells = rows.select("feature", "n", "bin", F.posexplode("p").alias("k", "v")).groupBy("feature", "bin", "k").agg((F.sum("v") / F.max("n")).alias("m"), F.max("n").alias("n"))
    cells = cells.withColumn("b", F.sum("m").over(W.partitionBy("feature", "bin"))).withColumn("s", F.sum("m").over(W.partitionBy("feature", "k")))
    cells = cells.withColumn("bins", F.count("*").over(W.partitionBy("feature", "k")))
    mi = F.sum(F.when(F.col("m") > 0, F.col("m") * F.ln(F.col("m") / (F.col("b") * F.col("s")))).otherwise(0.0))
    h = F.sum(F.when(F.col("s") > 0, -F.col("s") * F.ln("s") / F.col("bins")).otherwise(0.0))
    return cells.groupBy("feature").agg(F.try_divide(mi, h).alias("ratio"), F.max("n").alias("support"))


def eta_squared(features: DataFrame, names: list[str], teacher: DataFrame, time: str = "ts", p: str = "p") -> DataFrame:
    """(feature, eta2): between-state share of a feature's variance under posterior weights."""
    rows = _scored(features, names, teacher, time, p).select("feature", "x", F.posexplode("p").alias("k", "w"))
    states = rows.groupBy("feature", "k").agg(F.sum("w").alias("w"), F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("mean"))
    totals = rows.filter("k = 0").groupBy("feature").agg(F.avg("x").alias("centre"), F.var_pop("x").alias("variance"), F.count("*").alias("n"))
    joined = states.join(totals, "feature")
    between = F.sum(F.col("w") * F.pow(F.col("mean") - F.col("centre"), 2)) / F.max("n")
    return joined.groupBy("feature").agg(F.try_divide(between, F.max("variance")).alias("eta2"))
