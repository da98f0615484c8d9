"""Set checks and tolerance comparison of result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(expected: DataFrame, found: DataFrame, keys: list[str], value: str, tolerance: float = 1e-10) -> DataFrame:
    """(*keys, problem) of keys that are missing, unexpected, repeated, or whose values differ by more than tolerance."""
    one = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"{name}_n"), F.max(value).alias(name))
    both = one(expected, "e").join(one(found, "f"), keys, "full")
    same = (F.col("e").isNull() & F.col("f").isNull()) | (F.abs(F.col("e") - F.col("f")) <= tolerance)
    problem = (
        F.when(F.col("f_n").isNull(), "missing").when(F.col("e_n").isNull(), "unexpected").when((F.col("e_n") > 1) | (F.col("f_n") > 1), "repeated").when(~F.coalesce(same, F.lit(False)), "differs")
    )
    return both.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")


def uncovered(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, counted: both sides hold the same rows if this is empty."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
