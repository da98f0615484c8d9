"""The model cycle, tracking, profiles, requests, clusters, audits and files."""

import datetime as dt
import json
import pickle

import numpy as np
import pyarrow as pa
import pytest

from strandline.models import adapters, hmm
from strandline.operators import audit, clustering, evidence, filtering, selection
from strandline.plans import cycle, evidence_rows, refit
from strandline.plans.service import Engine
from strandline.sources import files, predictions, profiles, tracking
from strandline.sources.registry import Registry


def panel(spark, n=200, last=1.0):
    """a and b tell the state; n1 is noise."""
    rng = np.random.default_rng(4)
    state, rows = 0, []
    for i in range(n):
        state = state if rng.random() < 0.95 else 1 - state
        m = 2.0 * (1 - 2 * state)
        rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rng.normal(m, 0.5)), float(rng.normal(-m, 0.5)), float(rng.normal())))
    rows[-1] = (rows[-1][0], last, *rows[-1][2:])
    return spark.createDataFrame(rows, "ts date, a double, b double, n1 double")


SMALL = {"seeds": (11, 23, 37, 53, 71, 89), "max_features": 2, "min_train": 90, "inner_min_train": 31, "state_counts": (2,), "model_families": ("gaussian",)}


def test_cycle_publishes_once_per_source(spark, tmp_path):
    registry, builds = Registry(str(tmp_path / "r")), f"file://{tmp_path}/b"
    settings = refit.Settings(core=("a", "b", "n1"), **SMALL)
    p = panel(spark)
    first = cycle.run_cycle(spark, p, settings, registry, "m", builds, last_folds=1, min_rows=100)
    assert first.changed and first.version == 1 and first.valid_folds == 1
    manifest, rows = predictions.read(spark, builds, "m", first.build)
    assert manifest["row_count"] == rows.count() == 30  # June, the last closed month, and nothing of TRAIN
    assert {(r["fold_id"], r["timestamp"].month) for r in rows.collect()} == {("fold_002", 6)}
    assert all(len(r["feature_selection_definition_hash"]) == 64 == len(r["feature_selection_execution_hash"]) for r in rows.collect())
    again = cycle.run_cycle(spark, p, settings, registry, "m", builds, last_folds=1, min_rows=100)
    assert again == cycle.Outcome(False, 1)
    other = cycle.run_cycle(spark, panel(spark, last=2.5), settings, registry, "m", builds, last_folds=1, min_rows=100)
    assert other.changed and other.version == 2


def test_oos_rows_know_nothing_of_later_months(spark):
    settings = refit.Settings(core=("a", "b", "n1"), **SMALL)
    p = panel(spark)
    changed = p.filter("ts < '2020-06-01'").union(p.filter("ts >= '2020-06-01'").selectExpr("ts", "a + 3", "b - 1", "n1"))
    rows = []
    for q in (p, changed):
        results = refit.run_monthly(spark, q, settings, last=2)
        assert [r.valid for r in results] == [True, True]
        found = refit.oos_rows(q, results, "m").orderBy("timestamp").collect()
        rows.append([(r["fold_id"], r["timestamp"], tuple(r["state_probabilities"])) for r in found])
        # A fold's TEST continues the filter of its TRAIN.
        r = results[0]
        whole = refit.model_rows(q.filter("ts <= '2020-05-31'"), r.selected, r.fits).selectExpr("ts", *[f"({f} - {m!r}D) / {s!r}D AS {f}" for f, (m, s) in r.scaler.items()])
        straight = {x["time"]: x["p"] for x in filtering.forward_filter(whole, {"m": hmm.HMM.from_dict(r.model)}, list(r.selected)).collect()}
        for fold, at, prob in rows[-1]:
            if fold == r.fold_id:
                np.testing.assert_allclose(prob, straight[at.date()], atol=1e-9)
    may = [[x for x in part if x[1].month == 5] for part in rows]
    june = [[x for x in part if x[1].month == 6] for part in rows]
    assert len(may[0]) == 31 and len(june[0]) == 30 and may[0] == may[1] and june[0] != june[1]


def test_the_deployed_model_is_the_selected_one(spark, tmp_path):
    """Of a noisy core feature and a family that tells the state, components are selected, deployed and served."""
    settings = refit.Settings(core=("n1",), families={"sig": ("sig_1", "sig_2")}, **SMALL)
    p = panel(spark).withColumnsRenamed({"a": "sig_1", "b": "sig_2"})
    store, log = evidence.EvidenceStore(spark, f"file://{tmp_path}/e"), tracking.Tracking(spark, f"file://{tmp_path}/t")
    registry = Registry(str(tmp_path / "r"))
    results = refit.run_monthly(spark, p, settings, last=1, source="s", store=store, tracking=log)
    r = results[0]
    assert r.valid and any(f.startswith("family_pc_sig_") for f in r.selected)
    version = cycle.deploy(spark, p, r, settings, registry, "m", "s", 100)
    pack = registry.load("m", version)
    assert tuple(pack["features"]) == r.selected and set(pack["pca"]) == {"sig"} and pack["lineage"]["evaluation"] == r.package
    registry.move_alias("m", "champion", None, version, "test")
    now = Engine(registry, p).latest("m", dt.date(2020, 7, 1))
    assert abs(sum(now["p"]) - 1) < 1e-12

    assert store.tables() == sorted(evidence.TABLES)
    stats = {x["feature_name"]: x for x in store.read("fold_feature_stats").collect()}
    assert set(stats) == {"n1", "sig_1", "sig_2"} and stats["sig_1"]["pc_participation"] and not stats["n1"]["pc_participation"]
    steps = store.ordered("sffs_steps").collect()
    assert {x["action"] for x in steps} >= {"singleton"} and any(x["eligible"] and x["total_score"] is not None for x in steps)
    assert store.read("fold_model_stats").filter("valid").first()["tracking_run_id"] == log.read("runs").first()["run_id"]
    assert {x["name"] for x in log.read("artifacts").collect()} == {"plan.json", "selection.json", "starts.json", "model.json", "forecast.json"}
    bundle = evidence_rows.bundle(r, settings, "s", log.read("runs").first()["run_id"])
    assert store.commit_fold(bundle) is False
    other = bundle | {"sffs_steps": bundle["sffs_steps"][:-1]}
    with pytest.raises(evidence.Conflict):
        store.commit_fold(other)
    with pytest.raises(evidence.Conflict):
        store.commit_fold({t: [x | {"fold_id": "fold_999"} if t != "feature_registry" else x | {"role": "other"} for x in rows] for t, rows in bundle.items()})
    assert store.read("sffs_steps").count() == len(steps)  # nothing of a refused bundle is read
    changed = store.read("fold_feature_stats").filter("feature_name = 'n1'").selectExpr(*[c if c != "ablation_loss" else "CAST(-0.5 AS DOUBLE) AS ablation_loss" for c in store.read("fold_feature_stats").columns])
    assert store.upsert("fold_feature_stats", changed)
    after = {x["feature_name"]: x["ablation_loss"] for x in store.read("fold_feature_stats").collect()}
    assert after["n1"] == -0.5 and len(after) == 3


def test_two_eligible_features_are_too_few(spark):
    r = refit.run_monthly(spark, panel(spark).drop("n1"), refit.Settings(core=("a", "b"), **SMALL), last=1)[0]
    assert not r.valid and r.reason == "2 eligible features, 3 needed"
    assert evidence_rows.bundle(r, refit.Settings(core=("a", "b"), **SMALL), "s")["fold_model_stats"][0]["valid"] is False


def test_scores_of_the_search_equal_the_relational_ones(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for c in range(12):
        folds = []
        for k in range(rng.integers(1, 9)):
            valid = rng.random() < 0.85
            f = selection.inner_fold_score(f"fold_{k:03d}", float(rng.normal(-40, 30)), int(rng.integers(5, 60)), float(rng.random())) if valid else selection.FoldScore(f"fold_{k:03d}", None)
            folds.append(f)
            rows.append((f"c{c}", f.fold_id, valid, f.target, f.baseline, f.calibration, f.stability, f.support))
        expected[f"c{c}"] = selection.score_subset(folds)
    schema = "candidate string, fold_id string, valid boolean, target double, baseline double, calibration double, stability double, support double"
    for r in selection.subset_scores(spark.createDataFrame(rows, schema)).collect():
        e = expected[r["candidate"]]
        for c in ("planned", "valid_n", "reasons", "eligible"):
            assert r[c] == e[c]
        for c in ("rate", "forecast", "calibration", "stability", "robustness", "worst", "total"):
            assert r[c] == (None if e[c] is None else pytest.approx(e[c], abs=1e-12))


def test_adapters_share_one_interface():
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(-3, 1, (60, 2)), rng.normal(3, 1, (60, 2))])
    for family in hmm.FAMILIES:
        a, b = (adapters.adapter(family) for _ in range(2))
        a.fit(x, 2, 11)
        b.reconstruct(a.extract())
        np.testing.assert_allclose(a.causal_filter(x)[0], b.causal_filter(x)[0])
        assert pickle.loads(pickle.dumps(adapters.FACTORIES[family]))().family == family
    with pytest.raises(ValueError):
        adapters.adapter("nothing")
    with pytest.raises(ValueError):
        adapters.adapter(hmm.GAUSSIAN).reconstruct({"family": hmm.MIXTURE})


def test_settings_come_from_a_profile():
    p = profiles.Profile("p", ("a",), ("mom", "mom_fast"), max_features=7)
    s = refit.from_profile(p, ["ts", "a", "mom_1", "mom_fast_2", "other"], inner_folds=3)
    assert s.families == {"mom": ("mom_1",), "mom_fast": ("mom_fast_2",)} and (s.max_features, s.state_counts, s.model_families, s.inner_folds) == (7, (2, 3, 4, 5), hmm.FAMILIES, 3)
    assert s.profile_hash != refit.from_profile(p, ["ts", "a", "mom_1"]).profile_hash


def test_tracking_appends(spark, tmp_path):
    t = tracking.Tracking(spark, f"file://{tmp_path}/t")
    run = t.log("e", "n", {"k": 2}, {"ll": [-3.0, -2.0], "n": 5})
    t.log("e", "n2", {"k": 3}, {})
    assert t.read("runs").count() == 2
    assert sorted((r["key"], r["step"], r["value"]) for r in t.read("metrics").filter(f"run_id = '{run}'").collect()) == [("ll", 0, -3.0), ("ll", 1, -2.0), ("n", 0, 5.0)]
    tracking.write_report(t.read("params"), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").count() == 2
    assert tracking.canonical_json({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'
    with pytest.raises(ValueError):
        tracking.canonical_json(float("nan"))


def test_profiles_and_requests_are_strict(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"profile_id": "p", "core": ["a"], "families": []}))
    assert profiles.load_profile(str(path)).core == ("a",)
    for bad in ({"profile_id": "p", "core": []}, {"profile_id": "p", "core": [], "families": [], "what": 1}, {"profile_id": " ", "core": [], "families": []}, []):
        with pytest.raises(profiles.InvalidInput):
            profiles.strict(profiles.Profile, bad)
    assert profiles.parse_invocation('{"operation": "latest", "as_of": "2020-01-01T00:00:00Z"}').as_of
    for bad in ("nope", '{"operation": "latest"}', '{"operation": "x"}', '{"operation": "replay", "start": "2020-01-02T00:00:00Z", "end": "2020-01-01T00:00:00Z"}', '{"operation": "replay", "start": "2020-01-02", "end": "2020-01-03"}'):
        with pytest.raises(profiles.InvalidInput):
            profiles.parse_invocation(bad)
    assert (profiles.status_of(profiles.InvalidInput()), profiles.status_of(KeyError()), profiles.status_of(RuntimeError())) == (400, 404, 500)


def test_clusters():
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])
    d = np.abs(x[:, None] - x)
    merges = clustering.average_linkage(d)
    assert [m[:2] for m in merges] == [(0, 1), (3, 4), (0, 2), (3, 5), (0, 3)] and merges[2][2] == pytest.approx(0.15)
    found = clustering.best_cut(d)
    assert found.labels == (0, 0, 0, 1, 1, 2) and found.medoids == (1, 3, 5)
    assert clustering.silhouette(d, np.array([0, 0, 0, 1, 1, 2])) == pytest.approx(found.silhouette)
    assert clustering.winners(found.labels, list("abcdef"), {"a": 1.0, "b": 2.0, "c": 2.0, "d": None, "e": 0.1}) == {0: "b", 1: "e"}


def test_audit_names_every_problem(spark):
    e = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, None)], "k long, v double")
    f = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.1), (4, 4.0), (4, 4.0), (5, None), (6, 6.0)], "k long, v double")
    assert {r["k"]: r["problem"] for r in audit.compare(e, f, ["k"], "v").collect()} == {2: "differs", 3: "missing", 4: "repeated", 6: "unexpected"}
    assert audit.uncovered(e, e).count() == 0


def test_other_files(spark, tmp_path):
    table = pa.table({"ts": pa.array([dt.datetime(2020, 1, 1)], pa.timestamp("us", "UTC")), "a": [1.5]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    assert files.arrow_ipc(spark, str(tmp_path / "x.arrow")).first()["a"] == 1.5
    (tmp_path / "x.csv").write_text("ts,a\n2020-01-01T00:00:00Z,1.5\n2020-01-02T00:00:00Z,\n")
    assert [r["a"] for r in files.text_panel(spark, str(tmp_path / "x.csv"), ["a"]).orderBy("ts").collect()] == [1.5, None]
