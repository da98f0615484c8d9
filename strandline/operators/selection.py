"""Scoring, ranking and searching feature subsets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

MIN_VALID_RATE, MIN_VALID = 0.80, 3
IMPROVEMENT = 1e-12
MAX_FEATURES = 10
STATE_COUNTS = (2, 3, 4, 5)


def subset_scores(evidence: DataFrame) -> DataFrame:
    """Scores candidates from a row per (candidate, fold_id): valid, target, baseline, calibration, stability, support.

    Invalid folds stay in the denominator. A candidate that fails a gate has a NULL total and its reasons.
    """
    valid = F.col("valid")
    score = F.when(valid, C.forecast_score(F.col("target"), F.col("baseline")))
    s = evidence.groupBy("candidate").agg(
        F.count("*").alias("planned"), F.count_if(valid).alias("valid_n"), F.avg(score).alias("forecast"), F.min(score).alias("worst"),
        F.avg(F.when(valid, F.col("calibration"))).alias("calibration"), F.avg(F.when(valid, F.col("stability"))).alias("stability"),
        F.avg(F.when(valid, F.col("support"))).alias("support"), F.max_by(valid, "fold_id").alias("latest_valid"),
    )
    s = s.withColumn("rate", F.col("valid_n") / F.col("planned"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("valid_n") == 0, "no_valid_fold"), F.when(F.col("rate") < MIN_VALID_RATE, "valid_rate"),
            F.when(F.col("valid_n") < MIN_VALID, "too_few_valid_folds"), F.when(~F.col("latest_valid"), "latest_fold_invalid"),
        )
    )
    s = s.withColumn("reasons", F.array_join(reasons, ",")).withColumn("eligible", F.col("reasons") == "")
    s = s.withColumn("robustness", C.robustness(F.col("rate"), F.col("worst"), F.col("support")))
    total = C.total_score(F.col("forecast"), F.col("calibration"), F.col("stability"), F.col("robustness"))
    return s.withColumn("total", F.when(F.col("eligible"), total)).select(
        "candidate", "planned", "valid_n", "rate", "forecast", "calibration", "stability", "robustness", "worst", "total", "eligible", "reasons"
    )


@dataclass(frozen=True)
class FoldScore:
    """What one inner fold says about a candidate; target None: the fold is invalid."""

    fold_id: str
    target: float | None
    calibration: float = 0.0
    stability: float = 0.0
    support: float = 0.0
    baseline: float = 0.0


#: TEST rows of full support.
FULL_SUPPORT = 42


def inner_fold_score(fold_id: str, test_ll: float, test_n: int, start_rate: float) -> FoldScore:
    """Parts of a valid inner fold: log-likelihood a row, its bounded size as calibration, the share of converged starts as stability, and support."""
    target = test_ll / max(1, test_n)
    return FoldScore(fold_id, target, (math.tanh(abs(target)) + 1) / 2, start_rate, min(1.0, test_n / FULL_SUPPORT))


def score_subset(folds: Sequence[FoldScore]) -> dict:
    """subset_scores() of one candidate, from its inner folds in order, on the driver: the search's decision data."""
    valid = [f for f in folds if f.target is not None]
    rate = len(valid) / len(folds) if folds else 0.0
    gates = ((not valid, "no_valid_fold"), (rate < MIN_VALID_RATE, "valid_rate"), (len(valid) < MIN_VALID, "too_few_valid_folds"), (not folds or folds[-1].target is None, "latest_fold_invalid"))
    reasons = ",".join(text for bad, text in gates if bad)
    out = {"planned": len(folds), "valid_n": len(valid), "rate": rate, "reasons": reasons, "eligible": not reasons, "total": None}
    if not valid:
        return out | dict.fromkeys(("forecast", "calibration", "stability", "robustness", "worst"))
    mean = lambda values: math.fsum(values) / len(valid)
    scores = [0.5 + 0.5 * math.tanh(f.target - f.baseline) for f in valid]
    parts = {"forecast": mean(scores), "worst": min(scores), "calibration": mean(f.calibration for f in valid), "stability": mean(f.stability for f in valid)}
    parts["robustness"] = 0.5 * rate + 0.25 * parts["worst"] + 0.25 * mean(f.support for f in valid)
    total = 0.5 * parts["forecast"] + 0.2 * parts["calibration"] + 0.2 * parts["stability"] + 0.1 * parts["robustness"]
    return out | parts | {"total": None if reasons else total}


def rank_subsets(scores: DataFrame, size: str | None = None) -> DataFrame:
    """Eligible candidates by total, forecast, worst fold, calibration, stability, robustness (all descending), size and name."""
    keys = [F.desc(c) for c in ("total", "forecast", "worst", "calibration", "stability", "robustness")]
    keys += [F.col(size)] if size else []
    rank = F.row_number().over(W.orderBy(*keys, "candidate")).cast("long")
    return scores.filter("eligible").select(rank.alias("rank"), "candidate", "total")


def fold_aggregation(evidence: DataFrame, value: str, by: str = "candidate", valid: str = "valid") -> DataFrame:
    v = F.when(F.col(valid), F.col(value))
    out = evidence.groupBy(by).agg(F.count("*").alias("planned"), F.count_if(F.col(valid)).alias("valid_n"), F.avg(v).alias("mean"), F.min(v).alias("worst"))
    return out.withColumn("rate", F.col("valid_n") / F.col("planned")).withColumn("production", (F.col("valid_n") >= MIN_VALID) & (F.col("rate") >= MIN_VALID_RATE))


def anchored_winner(starts: DataFrame, value: str = "ll", order: str = "seed", tolerance: float = 1e-12, by: tuple[str, ...] = ()) -> DataFrame:
    """Of the rows within tolerance of the best value, the one of smallest order: ties are against the best, never chained."""
    best = starts.groupBy(*by).agg(F.max(value).alias("__best")) if by else starts.agg(F.max(value).alias("__best"))
    near = starts.join(F.broadcast(best), list(by)) if by else starts.crossJoin(F.broadcast(best))
    near = near.filter(F.col(value) >= F.col("__best") - tolerance)
    chosen = F.min_by(F.struct(*starts.columns), order).alias("r")
    return (near.groupBy(*by).agg(chosen) if by else near.agg(chosen)).filter("r IS NOT NULL").select("r.*")


def _higher_first(metric: str):
    return lambda a, b: F.when(a[metric] > b[metric], -1).when(a[metric] < b[metric], 1).otherwise(0)


def _anchored(metric: str, tolerance: float):
    def step(acc: Column, x: Column) -> Column:
        fresh = acc["a"].isNull() | (x[metric] < acc["a"] - tolerance)
        g = F.when(fresh, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(F.when(fresh, x[metric]).otherwise(acc["a"]).alias("a"), g.alias("g"), F.concat(acc["n"], F.array(g)).alias("n"))

    return step


def anchored_ranking(rows: DataFrame, metrics: Sequence[tuple[str, float]], name: str = "candidate") -> DataFrame:
    """(rank, name): lexicographic by metrics (higher first), each with a tolerance against the best of its group.

    Within a group the best and all within tolerance of it form the first subgroup, the next best the second, and so on;
    subgroups are split by the next metric. Such anchors aren't an order by comparison, so each metric is one aggregation
    over a sorted list of the group's few candidates.
    """
    groups = rows.select(F.array().cast("array<int>").alias("path"), F.struct(*[F.col(m) for m, _ in metrics], F.col(name)).alias("c"))
    for metric, tolerance in metrics:
        listed = groups.groupBy("path").agg(F.array_sort(F.collect_list("c"), _higher_first(metric)).alias("cs"))
        # (anchor, number of the subgroup, numbers so far), over candidates from the best down.
        zero = F.struct(F.lit(None).cast("double").alias("a"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("n"))
        numbers = F.aggregate("cs", zero, _anchored(metric, tolerance))["n"]
        numbered = listed.select("path", F.explode(F.arrays_zip("cs", numbers.alias("n"))).alias("z"))
        groups = numbered.select(F.concat("path", F.array(F.col("z.n"))).alias("path"), F.col("z.cs").alias("c"))
    rank = F.row_number().over(W.orderBy("path", f"c.{name}")).cast("long")
    return groups.select(rank.alias("rank"), F.col(f"c.{name}").alias(name))


def prefix_selection(rows: DataFrame, by: str = "k", tolerance: float = 1e-12) -> DataFrame:
    """Per state count the prefix length of best NMI, then best support, then the smallest length."""
    w = W.partitionBy(by)
    near = rows.withColumn("b", F.max("nmi").over(w)).filter(F.col("nmi") >= F.col("b") - tolerance)
    near = near.withColumn("s", F.max("support").over(w)).filter(F.col("support") >= F.col("s") - tolerance)
    return near.groupBy(by).agg(F.min("length").alias("length"))


Evaluate = Callable[[list[tuple[str, ...]]], list[float | None]]


@dataclass
class Step:
    number: int
    action: str
    candidate: str
    selected: tuple[str, ...]
    score: float | None


@dataclass
class Search:
    selected: tuple[str, ...]
    score: float | None
    steps: list[Step] = field(default_factory=list)


def sffs(features: Iterable[str], evaluate: Evaluate, limit: int = MAX_FEATURES) -> Search:
    """Floating forward search. evaluate takes all candidates of a round at once, so a round is one Spark job.

    Starts with the best single feature; adds the best feature if it improves the score by more than IMPROVEMENT, then
    drops features as long as that improves it. A tuple is never evaluated twice; every evaluation is recorded. Of equal
    scores the smaller set, then the earlier names, win.
    """
    names = list(features)
    seen: dict[tuple[str, ...], float | None] = {}
    out = Search((), None)

    def ask(action: str, candidates: list[tuple[str, tuple[str, ...]]]) -> tuple[str, tuple[str, ...], float] | None:
        fresh = [c for c in candidates if c[1] not in seen]
        for (label, subset), score in zip(fresh, evaluate([s for _, s in fresh]) if fresh else [], strict=True):
            seen[subset] = score
            out.steps.append(Step(len(out.steps) + 1, action, label, subset, score))
        scored = [(label, s, seen[s]) for label, s in fresh if seen[s] is not None]
        return min(scored, key=lambda c: (-c[2], len(c[1]), c[1])) if scored else None

    canonical = lambda chosen: tuple(f for f in names if f in chosen)
    best = ask("singleton", [(f, (f,)) for f in names])
    while best and (out.score is None or best[2] > out.score + IMPROVEMENT):
        out.selected, out.score = best[1], best[2]
        while len(out.selected) > 2:
            back = ask("backward", [(f, canonical(set(out.selected) - {f})) for f in out.selected])
            if not back or back[2] <= out.score + IMPROVEMENT:
                break
            out.selected, out.score = back[1], back[2]
        if len(out.selected) >= limit:
            break
        best = ask("forward", [(f, canonical({*out.selected, f})) for f in names if f not in out.selected])
    return out


def k_slot_sffs(features: Sequence[str], evaluate: Callable[[int, list[tuple[str, ...]]], list[float | None]], state_counts: Sequence[int] = STATE_COUNTS, limit: int = MAX_FEATURES) -> dict[int, Search]:
    """An independent search per state count; the searches' jobs run side by side."""
    with ThreadPoolExecutor(len(state_counts)) as pool:
        return dict(zip(state_counts, pool.map(lambda k: sffs(features, lambda c: evaluate(k, c), limit), state_counts), strict=True))


def ablation(selected: Sequence[str], evaluate: Evaluate) -> list[tuple[str, float | None]]:
    """(feature, loss): the score with all features minus the score without it, signed. All fits are one batch."""
    if len(selected) < 2:
        raise ValueError("ablation needs two features")
    subsets = [tuple(selected), *[tuple(g for g in selected if g != f) for f in selected]]
    baseline, *reduced = evaluate(subsets)
    return [(f, None if baseline is None or r is None else baseline - r) for f, r in zip(selected, reduced, strict=True)]


def candidate_grid(spark, families: Sequence[str] = ("gaussian", "gmm", "student_t"), state_counts: Sequence[int] = STATE_COUNTS) -> DataFrame:
    """(candidate_id, family, k, mixtures): every family with every state count; both sides are literals."""
    f = spark.createDataFrame([(x, 2 if x == "gmm" else 1) for x in families], "family string, mixtures long")
    k = spark.createDataFrame([(x,) for x in state_counts], "k long")
    return f.crossJoin(F.broadcast(k)).select(F.concat("family", F.lit("_k"), F.col("k").cast("string")).alias("candidate_id"), "family", "k", "mixtures")
