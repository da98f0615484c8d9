"""Causal filtering: one task per model, linear in its rows.

Incomplete rows are dropped before the recursion, so a gap adds no transition. A filter never starts anew in the middle:
it begins at the origin or continues from a stored terminal alpha.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..models.hmm import HMM, forward


def forward_filter(rows: DataFrame, models: dict[str, HMM], features: list[str], time: str = "ts", key: str | None = None, alphas: dict[str, list[float]] | None = None) -> DataFrame:
    """(model, time, p array<double>, ll_inc): every complete row's state probabilities given the rows up to it.

    rows belong to the model named by key, or to the only one. A series is one group by nature: its recursion is
    sequential. Many series, or many models, are many tasks.
    """
    name = next(iter(models)) if key is None else None
    shipped = rows.sparkSession.sparkContext.broadcast((models, alphas or {}))
    complete = rows.na.drop("any", subset=features).select((F.lit(name) if key is None else F.col(key)).alias("model"), F.col(time).alias("time"), *features)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known, start = shipped.value
        label = group["model"].iloc[0]
        group, model = group.sort_values("time", kind="stable"), known[label]
        alpha = start.get(label)
        p, inc = forward(model.log_emissions(group[features].to_numpy(float)), model.start, model.transition, None if alpha is None else np.array(alpha))
        return pd.DataFrame({"model": label, "time": group["time"].to_numpy(), "p": list(p), "ll_inc": inc})

    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("time", complete.schema["time"].dataType), T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("ll_inc", T.DoubleType())])
    return complete.groupBy("model").applyInPandas(run, schema)


def terminal_alpha(rows: DataFrame, model: HMM, features: list[str], time: str = "ts") -> tuple[object, list[float]] | None:
    """Last time and probabilities of a filter over rows."""
    last = forward_filter(rows, {"m": model}, features, time).agg(F.max_by(F.struct("time", "p"), "time").alias("x")).first()["x"]
    return None if last is None else (last["time"], list(last["p"]))


def predictions(filtered: DataFrame, states: int, prefix: str = "state_") -> DataFrame:
    """Shapes filtered rows: state ids, probabilities, dominant state, confidence and entropy, the same for every mode."""
    ids = F.array(*[F.lit(f"{prefix}{k:03d}") for k in range(states)])
    return filtered.select(
        "model", "time", ids.alias("state_ids"), F.col("p").alias("state_probabilities"), F.get(ids, C.dominant(F.col("p")).cast("int")).alias("dominant_state"),
        C.confidence(F.col("p")).alias("confidence"), C.entropy(F.col("p")).alias("entropy"), (C.confidence(F.col("p")) < C.LOW_CONFIDENCE).alias("low_confidence"),
    )


def latest(rows: DataFrame, model: HMM, features: list[str], as_of: object, time: str = "ts", trained_through: object = None, alpha: list[float] | None = None) -> DataFrame:
    """(as_of, time, p, warmup): state at the last complete row up to as_of.

    With a stored alpha only rows after trained_through are filtered; without rows after it, the stored alpha answers.
    """
    inside = rows.filter(F.col(time) <= F.lit(as_of))
    if alpha is not None:
        if as_of < trained_through:
            raise ValueError("as_of lies before the stored state; filter from the origin instead")
        inside = inside.filter(F.col(time) > F.lit(trained_through))
    found = forward_filter(inside, {"m": model}, features, time, alphas=None if alpha is None else {"m": alpha})
    kind = rows.schema[time].dataType
    out = found.agg(F.max("time").alias("time"), F.max_by("p", "time").alias("p"), F.count("*").alias("n"))
    stored = F.lit(None).cast("array<double>") if alpha is None else F.array(*[F.lit(float(a)) for a in alpha])
    out = out.select(F.lit(as_of).cast(kind).alias("as_of"), F.coalesce("time", F.lit(trained_through).cast(kind)).alias("time"), F.coalesce("p", stored).alias("p"), F.greatest(F.col("n") - 1, F.lit(0)).alias("warmup"))
    return out.filter("p IS NOT NULL")


def replay(rows: DataFrame, model: HMM, features: list[str], start: object, end: object, time: str = "ts") -> DataFrame:
    """Rows of [start, end] from a filter that begins at the origin; the rows before are the warm-up, which isn't returned."""
    found = forward_filter(rows.filter(F.col(time) <= F.lit(end)), {"m": model}, features, time)
    return found.filter(F.col("time") >= F.lit(start))


@dataclass(frozen=True)
class ReplayLimits:
    days: int = 3660
    rows: int = 10_000
    internal_rows: int = 15_000
    bytes: int = 25 << 20


class LimitExceeded(ValueError):
    pass


def check_replay(rows: DataFrame, start: object, end: object, states: int, limits: ReplayLimits = ReplayLimits(), time: str = "ts") -> dict:
    """Counts before a replay runs; raises where a limit is exceeded."""
    t = F.col(time)
    inside = (t >= F.lit(start)) & (t <= F.lit(end))
    c = rows.filter(t <= F.lit(end)).agg(F.count("*").alias("internal"), F.count_if(inside).alias("rows"), F.datediff(F.lit(end), F.lit(start)).alias("days")).first()
    size = c["rows"] * (220 + 48 * states)
    for what, value, most in (("days", c["days"], limits.days), ("rows", c["rows"], limits.rows), ("internal rows", c["internal"], limits.internal_rows), ("bytes", size, limits.bytes)):
        if value is not None and value > most:
            raise LimitExceeded(f"{what}: {value} > {most}")
    return {"rows": c["rows"], "internal_rows": c["internal"], "bytes": size}


def predictive_likelihood(rows: DataFrame, model: HMM, features: list[str], cutoff: object, time: str = "ts") -> DataFrame:
    """(train_n, test_n, ll, ll_per_row): TRAIN is filtered, TEST continues from its last state; only retained TEST rows count."""
    found = forward_filter(rows, {"m": model}, features, time)
    test = F.col("time") > F.lit(cutoff)
    out = found.agg(F.count_if(~test).alias("train_n"), F.count_if(test).alias("test_n"), F.sum(F.when(test, F.col("ll_inc"))).alias("ll"))
    return out.withColumn("ll_per_row", F.try_divide("ll", F.col("test_n").cast("double")))


def terminal_state(rows: DataFrame, model: HMM, features: list[str], time: str = "ts") -> DataFrame:
    """(p, ll) after the last row, in the JVM alone: the recursion as an aggregate over the sorted rows. For short series, no Python worker starts."""
    k = model.states
    mean, cov = model.moments()
    x = [F.col(f) for f in features]
    e = F.array(*[C.gaussian_log_density(x, list(map(float, mean[i])), cov[i].tolist()) for i in range(k)])
    rows = rows.na.drop("any", subset=features).select(F.struct(F.col(time).alias("t"), e.alias("e")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))

    def step(acc, r):
        prior = [F.when(acc["ll"].isNull(), F.lit(float(model.start[j]))).otherwise(sum((acc["p"][i] * float(model.transition[i, j]) for i in range(k)), F.lit(0.0))) for j in range(k)]
        top = F.array_max(r["e"])
        bound = F.struct(F.array(*[prior[j] * F.exp(r["e"][j] - top) for j in range(k)]).alias("w"), top.alias("top"))

        def shaped(z):
            total = sum((z["w"][j] for j in range(1, k)), z["w"][0])
            return F.struct(F.array(*[z["w"][j] / total for j in range(k)]).alias("p"), (F.coalesce(acc["ll"], F.lit(0.0)) + z["top"] + F.ln(total)).alias("ll"))

        return F.transform(F.array(bound), shaped)[0]

    zero = F.struct(F.array(*[F.lit(0.0)] * k).alias("p"), F.lit(None).cast("double").alias("ll"))
    return rows.select(F.aggregate("rs", zero, step).alias("s")).select("s.p", "s.ll")
