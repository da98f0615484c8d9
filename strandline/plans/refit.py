"""The monthly walk-forward: quality, family reduction, PCA, global reduction, search, fit, test, evidence."""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import alignment, hmm
from ..operators import calendar, correlation, diagnostics, filtering, multistart, pca, quality, selection
from ..sources.profiles import Profile

PC = "family_pc_"


@dataclass(frozen=True)
class Settings:
    core: tuple[str, ...] = ()
    families: dict[str, tuple[str, ...]] = field(default_factory=dict)
    state_counts: tuple[int, ...] = selection.STATE_COUNTS
    model_families: tuple[str, ...] = hmm.FAMILIES
    seeds: tuple[int, ...] = multistart.SEEDS
    max_features: int = selection.MAX_FEATURES
    min_train: int = calendar.MIN_TRAIN
    inner_min_train: int = 504
    inner_folds: int | None = None  # the last so many; all unless given
    min_coverage: float = quality.MIN_COVERAGE
    max_rounds: int | None = None
    parallel: int = 4  # folds whose jobs run side by side
    profile: str = ""

    @property
    def profile_hash(self) -> str:
        return _hash({k: str(v) for k, v in vars(self).items() if k != "parallel"})


def from_profile(profile: Profile, columns: list[str], time: str = "ts", **more) -> Settings:
    """Settings of a profile for a panel: core features and each family's, longest family name first."""
    families: dict[str, list[str]] = {f: [] for f in profile.families}
    for c in columns:
        family = next((f for f in sorted(profile.families, key=lambda f: (-len(f), f)) if c.startswith(f + "_")), None)
        if c != time and c not in profile.core and family:
            families[family].append(c)
    kept = {f: tuple(cs) for f, cs in families.items() if cs}
    return Settings(
        core=tuple(profile.core), families=kept, state_counts=tuple(profile.state_counts), model_families=tuple(profile.model_families), seeds=tuple(profile.seeds),
        max_features=profile.max_features, min_train=profile.min_train, profile=profile.profile_id, **more,
    )


def _hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


@dataclass
class Reduction:
    """A fold's features and what became of them."""

    names: list[str] = field(default_factory=list)
    quality: list[dict] = field(default_factory=list)
    within: dict[str, correlation.Election] = field(default_factory=dict)
    across: correlation.Election | None = None
    fits: dict[str, pca.PCA] = field(default_factory=dict)


@dataclass
class FoldResult:
    fold_id: str
    valid: bool
    reason: str | None
    selected: tuple[str, ...] = ()
    states: int = 0
    family: str = ""
    test_ll: float | None = None
    test_n: int = 0
    model: dict | None = None
    scaler: dict = field(default_factory=dict)  # feature -> (mean, scale), over the components where it is one
    alpha: list = field(default_factory=list)  # the filter after TRAIN, which TEST continues
    losses: list = field(default_factory=list)
    steps: list = field(default_factory=list)  # of the chosen state count
    searches: dict = field(default_factory=dict)
    scores: dict = field(default_factory=dict)  # (states, subset) -> parts of its score
    starts: list = field(default_factory=list)
    package: str = ""
    fold: dict = field(default_factory=dict)
    reduction: Reduction = field(default_factory=Reduction)

    @property
    def fits(self) -> dict[str, pca.PCA]:
        """Of the families of which a component is selected."""
        return {n: p for n, p in self.reduction.fits.items() if any(f.startswith(f"{PC}{n}_") and f[len(f"{PC}{n}_") :].isdigit() for f in self.selected)}


def fold_package(fold: dict, features: tuple[str, ...], model: dict, fits: dict[str, pca.PCA] | None = None, source: str = "", profile: str = "") -> str:
    """Identity of what a fold would deploy: source, profile, features, projections and model. TEST takes no part in it."""
    body = {"train_first": str(fold["train_first"]), "train_cutoff": str(fold["train_cutoff"]), "test_month": fold["test_month"], "features": features, "model": model}
    return _hash(body | {"pca": {n: p.to_dict() for n, p in (fits or {}).items()}, "source": source, "profile": profile})


def result_hash(results: list[FoldResult]) -> str:
    """Of all folds in plan order, invalid ones with their reason."""
    return _hash([[r.fold_id, r.valid, r.reason, r.package, list(r.selected)] for r in results])


def reduce(train: DataFrame, settings: Settings, time: str = "ts", strict: bool = False) -> Reduction:
    """Candidate columns of a fold: eligible core features and family components, without global near-copies. strict: a family without components stops it."""
    out = Reduction()
    wanted = [*settings.core, *[f for fs in settings.families.values() for f in fs]]
    out.quality = [r.asDict() for r in quality.feature_quality(train, wanted, settings.min_coverage).collect()]
    ok = {r["feature"]: r["coverage"] for r in out.quality if r["eligible"]}
    if len(ok) < quality.MIN_FEATURES:
        raise pca.StatisticallyInvalid(f"{len(ok)} eligible features, {quality.MIN_FEATURES} needed")
    families = {name: [f for f in fs if f in ok] for name, fs in settings.families.items()}
    families = {name: fs for name, fs in families.items() if fs}
    if families:
        out.within = correlation.prune(train, families, correlation.FAMILY, lambda f: (-ok[f], f), time)
        found = pca.fit_families(train, {n: sorted(e.representatives) for n, e in out.within.items()}, strict=strict)
        out.fits = {n: p for n, p in found.items() if isinstance(p, pca.PCA)}
    columns = [f for f in settings.core if f in ok]
    components = [f"{PC}{name}_{k + 1}" for name, p in out.fits.items() for k in range(len(p.components))]
    names = [*columns, *components]
    if not names:
        raise pca.StatisticallyInvalid("no candidate features")
    wide = with_components(train, out.fits, [time, *columns])
    order = {f: k for k, f in enumerate(names)}
    out.across = correlation.prune(wide, {"all": names}, correlation.GLOBAL, lambda f: (f in components, order[f], f), time)["all"]
    out.names = [f for f in names if f in out.across.representatives]
    return out


def with_components(panel: DataFrame, fits: dict[str, pca.PCA], keep: list[str]) -> DataFrame:
    return panel.select(*keep, *[c for name, p in fits.items() for c in p.columns(f"{PC}{name}")])


def model_rows(panel: DataFrame, features: list[str] | tuple[str, ...], fits: dict[str, pca.PCA], time: str = "ts") -> DataFrame:
    """time and exactly the model's features, components computed."""
    made = {f"{PC}{n}_{k + 1}" for n, p in fits.items() for k in range(len(p.components))}
    return with_components(panel, fits, [time, *[f for f in features if f not in made]]).select(time, *features)


class InnerEvaluator:
    """Scores feature subsets on monthly folds inside TRAIN; all fits of all subsets asked at once are one job."""

    def __init__(self, spark: SparkSession, matrix: np.ndarray, names: list[str], inner: list[dict], settings: Settings) -> None:
        self.spark, self.matrix, self.inner, self.settings = spark, matrix, inner, settings
        self.place = {f: k for k, f in enumerate(names)}
        self.scores: dict[tuple[int, tuple[str, ...]], dict] = {}

    def __call__(self, states: int, subsets: list[tuple[str, ...]]) -> list[float | None]:
        label = lambda s, k: "|".join(s) + f"@{k}"
        jobs = [multistart.Job(label(s, k), tuple(self.place[f] for f in s), f["train_n"], f["test_n"], states) for s in subsets for k, f in enumerate(self.inner)]
        best = {r["job"]: r for r in multistart.winners(multistart.run(self.spark, self.matrix, jobs, self.settings.seeds, self.settings.max_rounds)).collect()} if jobs else {}
        for s in subsets:
            folds = []
            for k, f in enumerate(self.inner):
                r = best[label(s, k)]
                good = r["valid"] and r["test_n"]
                folds.append(selection.inner_fold_score(f["fold_id"], r["test_ll"], r["test_n"], r["start_rate"]) if good else selection.FoldScore(f["fold_id"], None))
            self.scores[states, s] = selection.score_subset(folds)
        return [self.scores[states, s]["total"] for s in subsets]


def run_fold(spark: SparkSession, panel: DataFrame, fold: dict, settings: Settings, time: str = "ts", source: str = "") -> FoldResult:
    """One fold. Selection and fits see TRAIN only; the search is scored on months inside TRAIN."""
    out = FoldResult(fold["fold_id"], False, None, fold=fold)
    train = panel.filter(F.col(time).between(F.lit(fold["train_first"]), F.lit(fold["train_cutoff"]))).persist()
    try:
        try:
            out.reduction = reduce(train, settings, time)
        except pca.StatisticallyInvalid as e:
            out.reason = str(e)
            return out
        names = out.reduction.names
        inside = panel.filter(F.col(time).between(F.lit(fold["train_first"]), F.lit(fold["test_last"])))
        # A fold's decision data: a row per time and a column per surviving candidate, after all reductions above.
        rows = model_rows(inside, names, out.reduction.fits, time).orderBy(time).collect()
        matrix = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float).reshape(len(rows), len(names))
        n = sum(r[0] <= fold["train_cutoff"] for r in rows)
        inner = [r.asDict() for r in calendar.plan_folds(train.select(time), settings.inner_min_train, time=time).orderBy("fold_id").collect()]
        evaluate = InnerEvaluator(spark, matrix, names, inner[-settings.inner_folds :] if settings.inner_folds else inner, settings)
        out.searches = selection.k_slot_sffs(names, evaluate, settings.state_counts, settings.max_features)
        usable = [(k, s) for k, s in out.searches.items() if s.score is not None]
        if not usable:
            out.scores, out.reason = evaluate.scores, "no valid feature set"
            return out
        states, best = min(usable, key=lambda x: (-x[1].score, x[0]))
        out.steps = best.steps
        if len(best.selected) >= 2:
            out.losses = selection.ablation(best.selected, lambda subsets: evaluate(states, subsets))
        out.scores = evaluate.scores
        jobs = [multistart.Job(f, tuple(evaluate.place[x] for x in best.selected), n, len(rows) - n, states, f) for f in settings.model_families]
        every = multistart.winners(multistart.run(spark, matrix, jobs, settings.seeds, settings.max_rounds)).collect()
        out.starts = [{k: r[k] for k in ("job", "valid_starts", "start_rate", "valid", "seed", "ll", "test_ll", "test_n")} for r in every]
        found = [r for r in every if r["valid"]]
        if not found:
            out.reason = "no family converged often enough"
            return out
        top = min(found, key=lambda r: (-r["ll"], r["job"]))
        kept = json.loads(top["model"])
        model = hmm.HMM.from_dict(kept)
        if reason := hmm.covariance_reason(model):
            out.reason = reason
            return out
        order = alignment.first_order(model)
        out.model = model.permuted(order).to_dict()
        out.alpha = [kept["alpha"][k] for k in order]
        out.scaler = {f: (float(m), float(s)) for f, m, s in zip(best.selected, *kept["scaler"], strict=True)}
        out.valid, out.selected, out.states, out.family = True, best.selected, states, top["job"]
        out.test_ll, out.test_n = top["test_ll"], top["test_n"]
        out.package = fold_package(fold, best.selected, out.model, out.fits, source, settings.profile_hash)
        return out
    finally:
        train.unpersist()


def single_normal(x: np.ndarray, train: int, test: int) -> float:
    """Mean log-density of the later rows under one normal of the earlier: what a regime model has to beat."""
    a, b = (p[np.isfinite(p).all(axis=1)] for p in (x[:train], x[train : train + test]))
    cov = np.cov(a.T, bias=True).reshape(x.shape[1], -1) + hmm.MIN_COVARIANCE * np.diag(a.var(axis=0))
    return float(hmm.gaussian_log_density(b, a.mean(axis=0), cov).mean())


def run_monthly(spark: SparkSession, panel: DataFrame, settings: Settings, cutoff: object = None, last: int | None = None, time: str = "ts", source: str = "", store=None, tracking=None) -> list[FoldResult]:
    """All folds (or the last few), in plan order; an invalid fold stays in the list with its reason.

    Folds run side by side (settings.parallel), so that one's reductions use the cores that another's search leaves. With
    a store each fold's evidence is one commit; with tracking each fold is a run with its diagnostics.
    """
    from . import evidence_rows

    folds = [r.asDict() for r in calendar.plan_folds(panel, settings.min_train, cutoff, time=time).orderBy("fold_id").collect()]
    with ThreadPoolExecutor(max(1, settings.parallel)) as pool:
        results = list(pool.map(lambda f: run_fold(spark, panel, f, settings, time, source), folds[-last:] if last else folds))
    for r in results:
        run = tracking.log("monthly", r.fold_id, evidence_rows.parameters(r, settings), evidence_rows.metrics(r), evidence_rows.documents(r)) if tracking is not None else None
        if store is not None:
            store.commit_fold(evidence_rows.bundle(r, settings, source, run))
    return results


def oos_rows(panel: DataFrame, results: list[FoldResult], name: str, time: str = "ts") -> DataFrame | None:
    """Predictions of every valid fold's TEST month by that fold's own model, whose filter continues from TRAIN's end. None without a valid fold."""
    text = lambda v: F.lit(v)
    out = None
    for r in (r for r in results if r.valid):
        test = panel.filter(F.col(time).between(F.lit(r.fold["test_first"]), F.lit(r.fold["test_last"])))
        z = [((F.col(f) - m) / s).alias(f) for f, (m, s) in r.scaler.items()]
        rows = model_rows(test, r.selected, r.fits, time).select(time, *z)
        model = hmm.HMM.from_dict(r.model)
        found = filtering.predictions(filtering.forward_filter(rows, {r.fold_id: model}, list(r.selected), time, alphas={r.fold_id: r.alpha}), r.states)
        found = found.select(
            text(name).alias("profile_id"), text("1").alias("schema_version"), text("oos").alias("prediction_mode"), F.col("time").cast("timestamp").alias("timestamp"), "state_ids", "state_probabilities",
            "dominant_state", "confidence", "entropy", text(f"{r.family}_k{r.states}").alias("candidate_id"), text(r.fold_id).alias("fold_id"), text(r.package).alias("evaluation_plan_hash"),
            text(_hash(list(r.selected))).alias("feature_selection_definition_hash"), text(_hash([r.package, list(r.selected)])).alias("feature_selection_execution_hash"),
        )
        out = found if out is None else out.unionByName(found)
    return out


MIN_REFIT_ROWS = 504


class Rejected(pca.StatisticallyInvalid):
    """A gate that leaves nothing to deploy: its reason, and in known what the refit had found by then."""

    def __init__(self, reason: str, known: dict) -> None:
        super().__init__(reason)
        self.known = known


def final_refit(spark: SparkSession, panel: DataFrame, features: list[str], states: int, family: str = hmm.GAUSSIAN, cutoff: object = None, seeds: tuple[int, ...] = multistart.SEEDS, min_rows: int = MIN_REFIT_ROWS, time: str = "ts", fits: dict[str, pca.PCA] | None = None) -> dict:
    """The model to deploy, on all complete rows up to the cutoff: multistart, gates on covariances and occupancy, states in canonical order.

    features may be components of fits, the selection's projections, which stay as they are; the scaler is fitted over components.
    A row without a time has no place in the series and isn't complete; an infinite value leaves nothing to fit.
    A gate that fails raises Rejected; hard and soft are the states' shares of the rows, in the model's order or, of a rejected one, the fit's.
    """
    inside = panel if cutoff is None else panel.filter(F.col(time) <= F.lit(cutoff))
    rows = model_rows(inside, features, fits or {}, time).na.drop("any", subset=[time, *features]).orderBy(time).collect()
    known = {"features": list(features), "rows": len(rows), "trained_through": rows[-1][0] if rows else None}
    if len(rows) < min_rows:
        raise Rejected(f"{len(rows)} rows, {min_rows} needed", known)
    matrix = np.array([list(r[1:]) for r in rows], float)
    if odd := int((~np.isfinite(matrix).all(axis=1)).sum()):
        raise Rejected(f"{odd} rows are not finite", known)
    job = multistart.Job("final", tuple(range(len(features))), len(rows), 0, states, family)
    top = multistart.winners(multistart.run(spark, matrix, [job], seeds)).first()
    if not top["valid"]:
        raise Rejected("too few starts converged", known)
    found = json.loads(top["model"])
    model = hmm.HMM.from_dict(found)
    if reason := hmm.covariance_reason(model):
        raise Rejected(reason, known)
    mean, scale = (np.array(v) for v in found["scaler"])
    p, _ = hmm.forward(model.log_emissions((matrix - mean) / scale), model.start, model.transition)
    hard, soft = np.bincount(p.argmax(axis=1), minlength=states) / len(p), p.mean(axis=0)
    shares = {"hard": hard.tolist(), "soft": soft.tolist()}
    if hard.min() < diagnostics.MIN_HARD or soft.min() < diagnostics.MIN_SOFT:
        raise Rejected("a state is hardly occupied", known | shares)
    try:
        order = alignment.first_order(model)
    except alignment.AmbiguousAlignment as e:
        raise Rejected(str(e), known | shares) from e
    return known | {
        "model": model.permuted(order), "scaler": {f: (float(m), float(s)) for f, m, s in zip(features, mean, scale, strict=True)}, "alpha": p[-1][order].tolist(),
        "hard": hard[order].tolist(), "soft": soft[order].tolist(), "pca": {n: f.to_dict() for n, f in (fits or {}).items()},
    }
