"""What a fold leaves behind: the rows of its six evidence tables, and its diagnostics as JSON documents."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np

from ..models import hmm
from .refit import PC, FoldResult, Settings, _hash


def _feature_rows(r: FoldResult, settings: Settings) -> list[dict]:
    reduced = r.reduction
    losses = dict(r.losses)
    tried = {f for (_, subset) in r.scores for f in subset}
    direct = {f for e in reduced.within.values() for f in e.representatives}
    out = []
    for q in sorted(reduced.quality, key=lambda q: q["feature"]):
        f = q["feature"]
        family = next((n for n, fs in settings.families.items() if f in fs), None)
        fit = reduced.fits.get(family)
        part = fit is not None and f in fit.features
        # A source feature's credit: the losses of its family's selected components, shared by squared loadings.
        credit = sum(abs(losses[name]) * w * w for k, g, w, _, _ in (fit.loadings() if part else []) if g == f and losses.get(name := f"{PC}{family}_{k}") is not None)
        kept = f in direct if family else reduced.across is not None and f in reduced.across.representatives
        out.append({
            "feature_name": f, "eligible": q["eligible"], "quality_reason": q["reason"], "direct_participation": f in reduced.names, "pc_participation": part, "pca_credit": float(credit) if part else None,
            "representative": q["eligible"] and kept, "sffs_participation": f in tried, "final_selection": f in r.selected, "ablation_loss": losses.get(f),
        })
    return out


def bundle(r: FoldResult, settings: Settings, source: str, run_id: str | None = None) -> dict[str, list[dict]]:
    """Rows by table. Whatever isn't known of an invalid fold is absent, but the fold itself never is."""
    scope = {"fold_id": r.fold_id, "profile_hash": settings.profile_hash, "source_build_id": source}
    reduced = r.reduction
    wanted = [*[(f, "core", None) for f in settings.core], *[(f, "transformation", n) for n, fs in settings.families.items() for f in fs]]
    seen = dt.datetime.fromisoformat(str(r.fold["train_first"])) if r.fold else None
    registry = [
        {"feature_identity": _hash([source, f]), "source_dataset": settings.profile, "source_build_id": source, "source_catalog_hash": _hash([w[0] for w in wanted]), "feature_name": f, "role": role, "family": family,
         "transformation_name": None if family is None else f[len(family) + 1 :].rsplit("_", 1)[0], "transformation_parameters_json": "{}", "first_seen_utc": None, "lifecycle_status": "active"}
        for f, role, family in wanted
    ]
    del seen
    loadings = [
        scope | {"family": n, "pc_ordinal": k, "source_feature": f, "loading": w, "squared_loading": s, "explained_variance": e} for n, p in reduced.fits.items() for k, f, w, s, e in p.loadings()
    ]
    mapping = {}
    for election in [*reduced.within.values(), *([reduced.across] if reduced.across else [])]:
        for f in election.representatives:
            mapping[f] = scope | {"candidate": f, "chosen_representative": f, "retained": True, "reason": "representative"}
        for f, lead in election.removed.items():
            e = election.edges[f, lead]
            parts = {f"subwindow_{k}_abs_correlation": e[f"corr_{k}"] for k in (1, 2, 3)} | {f"subwindow_{k}_support_count": e[f"support_{k}"] for k in (1, 2, 3)}
            mapping[f] = scope | {"candidate": f, "chosen_representative": lead, "full_abs_correlation": e["full_corr"], "full_support_count": e["full_support"], "retained": False, "reason": "redundant"} | parts
    steps = []
    for k, search in r.searches.items():
        for s in search.steps:
            score = r.scores.get((k, s.selected), {})
            steps.append(scope | {
                "state_count": k, "step_number": s.number, "action": s.action, "candidate": s.candidate, "selected_tuple_hash": _hash(list(s.selected)), "forecast_score": score.get("forecast"),
                "calibration_score": score.get("calibration"), "stability_score": score.get("stability"), "robustness_score": score.get("robustness"), "total_score": score.get("total"),
                "eligible": bool(score.get("eligible")), "rejection_reason": score.get("reasons") or None,
            })
    models = [
        scope | {"state_count": r.states, "model_family": x["job"], "selected_tuple_hash": _hash(list(r.selected)), "valid": r.valid and x["job"] == r.family, "diagnostics_json": json.dumps(x, sort_keys=True), "tracking_run_id": run_id}
        for x in r.starts
    ] or [scope | {"state_count": 0, "model_family": "", "selected_tuple_hash": _hash([]), "valid": False, "diagnostics_json": json.dumps({"reason": r.reason}), "tracking_run_id": run_id}]
    return {
        "feature_registry": registry, "fold_feature_stats": [scope | f for f in _feature_rows(r, settings)], "pca_loadings": loadings, "correlation_mapping": [mapping[f] for f in sorted(mapping)],
        "sffs_steps": steps, "fold_model_stats": models,
    }


def parameters(r: FoldResult, settings: Settings) -> dict:
    return {"profile_hash": settings.profile_hash, "states": r.states, "family": r.family, "selected": "|".join(r.selected), "valid": r.valid, "reason": r.reason or "", "package": r.package}


def metrics(r: FoldResult) -> dict:
    out = {"test_n": float(r.test_n), "evaluated": float(len(r.scores))}
    if r.valid:
        out |= {"test_ll": r.test_ll, "test_ll_per_row": r.test_ll / max(1, r.test_n)}
    return out


def documents(r: FoldResult) -> dict[str, dict]:
    """Five documents of a fold: plan, selection, starts, model and forecast."""
    model = hmm.HMM.from_dict(r.model) if r.model else None
    stay = np.diag(model.transition).tolist() if model else []
    return {
        "plan.json": {k: str(v) for k, v in r.fold.items()} | {"valid": r.valid, "reason": r.reason},
        "selection.json": {"candidates": r.reduction.names, "selected": list(r.selected), "ablation": [list(x) for x in r.losses], "steps": len(r.steps)},
        "starts.json": {"families": r.starts},
        "model.json": {"family": r.family, "states": r.states, "stay": stay, "expected_duration": [1 / (1 - s) if s < 1 else None for s in stay], "covariances": hmm.covariance_reason(model) if model else None},
        "forecast.json": {"test_n": r.test_n, "test_ll": r.test_ll, "terminal": r.alpha},
    }
