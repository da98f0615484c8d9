"""Many seeded fits as one table of tasks: folds, feature subsets, state counts, families and seeds share one job."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import adapters, hmm
from .selection import anchored_winner

SEEDS = (11, 23, 37, 53, 71, 89, 107, 131)
MIN_STARTS, MIN_START_RATE = 6, 0.75
#: A fold's matrix is broadcast; a larger one is refused.
MAX_MATRIX_BYTES = 512 << 20


@dataclass(frozen=True)
class Job:
    """One model to fit: rows of a matrix (train, then test), columns, state count and family."""

    job: str
    columns: tuple[int, ...]
    train: int
    test: int
    states: int
    family: str = hmm.GAUSSIAN


RESULT = "job string, seed long, ok boolean, reason string, ll double, test_ll double, test_n long, model string"


def run(spark: SparkSession, matrix: np.ndarray, jobs: list[Job], seeds: tuple[int, ...] = SEEDS, max_rounds: int | None = None, tolerance: float = hmm.TOLERANCE, factories: dict | None = None) -> DataFrame:
    """A row per job and seed. The matrix (a fold's decision data: times x candidate features) is broadcast once.

    factories are FACTORIES unless given, by family. TEST rows follow TRAIN rows and continue its filter. Incomplete rows are dropped on either side. A statistical failure is a row with
    its reason; anything unexpected ends the job.
    """
    if matrix.nbytes > MAX_MATRIX_BYTES:
        raise ValueError(f"a matrix of {matrix.nbytes >> 20} MB; {MAX_MATRIX_BYTES >> 20} are allowed")
    shipped = spark.sparkContext.broadcast((matrix, jobs, factories or adapters.FACTORIES))
    # Seeds of a job share a task, where their recursions run as one, as far as every core has a task.
    cores = spark.sparkContext.defaultParallelism
    together = max(1, min(len(seeds), len(jobs) * len(seeds) // cores))
    groups = [list(map(int, seeds[k : k + together])) for k in range(0, len(seeds), together)]
    listed = F.array(*[F.array(*[F.lit(s).cast("long") for s in g]) for g in groups])
    tasks = spark.range(len(jobs) * len(groups)).select(F.floor(F.col("id") / len(groups)).cast("int").alias("j"), F.element_at(listed, (F.col("id") % len(groups) + 1).cast("int")).alias("seeds"))
    tasks = tasks.repartition(max(1, min(len(jobs) * len(groups), 4 * cores)))

    def fitted(make, x: np.ndarray, job: Job, chosen: list[int]) -> list:
        if hasattr(make(), "fit_many"):
            return make().fit_many(x, job.states, chosen, max_rounds, tolerance)
        out = []
        for seed in chosen:
            model = make()
            try:
                model.fit(x, job.states, seed, max_rounds, tolerance)
                out.append(model)
            except (np.linalg.LinAlgError, FloatingPointError) as e:
                out.append(e)
        return out

    def some(j: int, chosen: list[int]) -> list[dict]:
        data, all_jobs, made = shipped.value
        job = all_jobs[j]
        blank = lambda seed, reason: {"job": job.job, "seed": int(seed), "ok": False, "reason": reason, "ll": None, "test_ll": None, "test_n": 0, "model": None}
        train, test = (part[np.isfinite(part).all(axis=1)] for part in (data[: job.train, job.columns], data[job.train : job.train + job.test, job.columns]))
        if len(train) < 10 * job.states:
            return [blank(s, "too_few_rows") for s in chosen]
        mean, scale = train.mean(axis=0), train.std(axis=0)
        if not np.isfinite(scale).all():  # of an overflow: scaled by it, the feature would be constant
            return [blank(s, "overflow") for s in chosen]
        if (scale <= 0).any():
            return [blank(s, "constant_feature") for s in chosen]
        x, y, out = (train - mean) / scale, (test - mean) / scale, []
        for seed, model in zip(chosen, fitted(made[job.family], x, job, chosen), strict=True):
            if isinstance(model, Exception):
                out.append(blank(seed, "numerical"))
                continue
            if not model.converged:
                out.append(blank(seed, "not_converged"))
                continue
            p, _ = model.causal_filter(x)
            row = blank(seed, None) | {"ok": True, "ll": model.log_likelihood}
            if len(y):
                _, inc = model.causal_filter(y, p[-1])
                row |= {"test_ll": float(inc.sum() - len(y) * np.log(scale).sum()), "test_n": len(y)}
            out.append(row | {"model": json.dumps(model.extract() | {"scaler": [mean.tolist(), scale.tolist()], "alpha": p[-1].tolist()})})
        return out

    def many(batches):
        for pdf in batches:
            rows = [r for j, chosen in zip(pdf["j"], pdf["seeds"], strict=True) for r in some(j, [int(s) for s in chosen])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"test_n": "int64"})

    return tasks.mapInPandas(many, RESULT)


def winners(results: DataFrame, starts: int = MIN_STARTS, rate: float = MIN_START_RATE) -> DataFrame:
    """Per job: valid_starts, start_rate, valid, and the winner (best likelihood within 1e-12, then the lowest seed)."""
    counts = results.groupBy("job").agg(F.count_if(F.col("ok")).alias("valid_starts"), (F.count_if(F.col("ok")) / F.count("*")).alias("start_rate"))
    best = anchored_winner(results.filter("ok"), by=("job",)).select("job", "seed", "ll", "test_ll", "test_n", "model")
    valid = (F.col("valid_starts") >= starts) & (F.col("start_rate") >= rate)
    return counts.join(best, "job", "left").withColumn("valid", valid)
