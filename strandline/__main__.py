"""python -m strandline evaluate|refit|cycle|publish-oos|register|publish-package|promote|rollback|status: the operations over a Parquet panel and a registry folder."""

from __future__ import annotations

import argparse
import json
import pickle
import sys
from pathlib import Path

from .operators.evidence import EvidenceStore
from .plans import cycle, refit
from .session import session
from .sources import features as sources
from .sources.profiles import load_profile
from .sources.registry import Registry, locked, package
from .sources.tracking import Tracking

WITH_PANEL = ("evaluate", "refit", "cycle", "publish-oos", "register")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline")
    sub = p.add_subparsers(dest="action", required=True)
    for name in (*WITH_PANEL, "publish-package", "promote", "rollback", "status"):
        s = sub.add_parser(name)
        s.add_argument("--profile", required=True, help="the model's name")
        s.add_argument("--registry", required=True)
        if name in WITH_PANEL:
            s.add_argument("--panel", required=True)
            s.add_argument("--profile-file", help="a profile as JSON: core, families, state counts, model families, seeds")
            s.add_argument("--features", help="comma-separated, without a profile file")
            s.add_argument("--states", type=int, help="one state count instead of the profile's")
            s.add_argument("--last", type=int, help="only the last folds")
            s.add_argument("--evidence", help="folder of the evidence tables")
            s.add_argument("--tracking", help="folder of the tracking tables")
        if name in ("cycle", "publish-oos"):
            s.add_argument("--builds", required=True)
        if name == "publish-package":
            s.add_argument("--package", required=True)
        if name == "promote":
            s.add_argument("--version", type=int, required=True)
            s.add_argument("--expected", type=int)
        if name in ("promote", "rollback"):
            s.add_argument("--actor", required=True)
    return p


def _settings(a: argparse.Namespace, panel) -> refit.Settings:
    more = {} if a.states is None else {"state_counts": (a.states,)}
    if a.profile_file:
        s = refit.from_profile(load_profile(a.profile_file), panel.columns)
        return refit.Settings(**(vars(s) | more))
    if not a.features:
        raise SystemExit("--profile-file or --features is needed")
    return refit.Settings(core=tuple(a.features.split(",")), profile=a.profile, **more)


def save_state(path: Path, state: dict) -> None:
    """A driver-side file that is replaced whole."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_bytes(pickle.dumps(state))
    part.replace(path)


def load_state(path: Path) -> dict:
    if not path.exists():
        raise SystemExit("evaluate first")
    return pickle.loads(path.read_bytes())  # written by save_state, in the registry's own folder


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    registry = Registry(a.registry)
    if a.action == "status":
        print(json.dumps({"versions": registry.versions(a.profile), "champion": registry.resolve(a.profile, "champion")}))
        return 0
    if a.action == "promote":
        registry.move_alias(a.profile, "champion", a.expected, a.version, a.actor)
        return 0
    if a.action == "publish-package":
        print(json.dumps({"version": registry.publish(a.profile, a.package)}))
        return 0
    if a.action == "rollback":
        print(json.dumps({"champion": registry.rollback(a.profile, "champion", a.actor)}))
        return 0
    try:
        with locked(Path(a.registry) / ".cycle"):  # a second run at the same time is a no-op
            return _with_panel(a, registry)
    except TimeoutError:
        print("another cycle runs", file=sys.stderr)
        return 0


def _with_panel(a: argparse.Namespace, registry: Registry) -> int:
    spark = session()
    panel = spark.read.parquet(a.panel)
    settings, kept = _settings(a, panel), Path(a.registry) / "evaluations" / f"{a.profile}.pickle"
    store = EvidenceStore(spark, a.evidence) if a.evidence else None
    tracking = Tracking(spark, a.tracking) if a.tracking else None
    source = sources.lineage(panel, a.profile, "current").first()["data_sha256"]
    if a.action == "evaluate":
        results = refit.run_monthly(spark, panel, settings, last=a.last, source=source, store=store, tracking=tracking)
        save_state(kept, {"results": results, "source": source})
        for r in results:
            print(json.dumps({"fold": r.fold_id, "valid": r.valid, "reason": r.reason, "selected": r.selected, "test_ll": r.test_ll, "package": r.package}))
    elif a.action == "cycle":
        o = cycle.run_cycle(spark, panel, settings, registry, a.profile, a.builds, last_folds=a.last, store=store, tracking=tracking)
        print(json.dumps({"changed": o.changed, "version": o.version, "build": o.build, "valid_folds": o.valid_folds}))
    elif a.action in ("publish-oos", "register"):
        state = load_state(kept)
        if state["source"] != source:
            raise SystemExit("the panel isn't the one that was evaluated")
        valid = [r for r in state["results"] if r.valid]
        if not valid:
            raise SystemExit("no fold is valid")
        if a.action == "publish-oos":
            print(json.dumps({"build": cycle.publish_oos(spark, panel, state["results"], a.builds, a.profile, source)}))
        else:
            print(json.dumps({"version": cycle.deploy(spark, panel, valid[-1], settings, registry, a.profile, source, refit.MIN_REFIT_ROWS, tracking=tracking)}))
    else:
        r = refit.final_refit(spark, panel, list(settings.core), settings.state_counts[0])
        pack = package(r["model"], r["features"], r["scaler"], r["trained_through"].isoformat(), r["alpha"], {"data_sha256": source, "rows": r["rows"]})
        print(json.dumps({"version": registry.register(a.profile, pack), "package_hash": pack["package_hash"]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
