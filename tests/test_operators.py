"""Boundaries, leakage and idempotence of the operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import blocks, calendar, correlation, evidence, pca, quality, roles, selection
from strandline.sources import features, predictions
from strandline.sources.registry import AliasChanged, Registry, package


def days(n, start=dt.date(2018, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def panel(spark, columns, n=90, start=dt.date(2018, 1, 1)):
    names = list(columns)
    rows = [(d, *[None if columns[c][i] is None else float(columns[c][i]) for c in names]) for i, d in enumerate(days(n, start))]
    return spark.createDataFrame(rows, "ts date, " + ", ".join(f"{c} double" for c in names))


def test_folds_need_a_closed_following_month(spark):
    p = panel(spark, {"a": range(100)}, 100)  # ends on 10 April
    found = [(r["train_month"], r["test_month"], r["train_n"], r["test_n"]) for r in calendar.plan_folds(p, 31).orderBy("fold_id").collect()]
    assert found == [("2018-01", "2018-02", 31, 28), ("2018-02", "2018-03", 59, 31)]
    assert calendar.plan_folds(p, 1000).count() == 0
    assert calendar.plan_folds(p.filter("ts NOT BETWEEN '2018-02-01' AND '2018-02-28'"), 31).count() == 0


def test_folds_at_the_last_day_and_over_new_year(spark):
    p = panel(spark, {"a": range(62)}, 62, dt.date(2019, 12, 1))  # ends on 31 January
    assert [(r["train_month"], r["test_month"]) for r in calendar.plan_folds(p, 31).collect()] == [("2019-12", "2020-01")]
    assert calendar.plan_folds(p.filter("ts < '2020-01-31'"), 31).count() == 0


def test_later_rows_do_not_change_train(spark):
    p = panel(spark, {"a": range(100)}, 100)
    fold = calendar.plan_folds(p, 31).orderBy("fold_id").first()
    mutated = p.withColumn("a", F.when(F.col("ts") > fold["train_cutoff"], 1e9).otherwise(F.col("a")))
    train = lambda x: quality.train_scaler(calendar.fold_rows(x, calendar.plan_folds(x, 31)).filter("part = 'train' AND fold_id = 'fold_000'").select("fold_id", "a"), ["a"]).collect()
    assert train(p) == train(mutated)


def test_train_bounds_fail_closed(spark):
    p = panel(spark, {"a": range(10)}, 10)
    with pytest.raises(Exception, match="outside TRAIN"):
        calendar.train_only(p, dt.date(2018, 1, 1), dt.date(2018, 1, 5)).collect()


def test_quality_boundaries_and_nan(spark):
    n = 100
    p = panel(spark, {"ok": range(n), "at": [None] * 10 + list(range(90)), "below": [None] * 11 + list(range(89)), "flat": [1] * n, "none": [None] * n}, n)
    got = {r["feature"]: r["reason"] for r in quality.feature_quality(p, ["ok", "at", "below", "flat", "none"]).collect()}
    assert got == {"ok": None, "at": None, "below": quality.LOW_COVERAGE, "flat": quality.LOW_VARIANCE, "none": quality.LOW_COVERAGE}
    with pytest.raises(Exception, match="not finite"):
        quality.feature_quality(p.withColumn("ok", F.lit(float("nan"))), ["ok"]).collect()


def test_correlation_is_pairwise_complete_and_survives_constants(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=90)
    b = a + rng.normal(size=90)
    gaps = [None if i % 7 == 0 else v for i, v in enumerate(b)]
    p = panel(spark, {"a": a, "b": gaps, "flat": [2.0] * 90})
    got = {(r["left"], r["right"]): (r["abs_corr"], r["support"]) for r in correlation.pair_correlations(p, {"x": ["a", "b", "flat"]}).collect()}
    keep = [i for i in range(90) if i % 7]
    assert got["a", "b"][0] == pytest.approx(abs(np.corrcoef(a[keep], b[keep])[0, 1])) and got["a", "b"][1] == len(keep)
    assert got["a", "flat"] == (None, 90)


def test_thirds_put_the_remainder_first(spark):
    got = [r["n"] for r in correlation.thirds(panel(spark, {"a": range(11)}, 11)).groupBy("third").agg(F.count("*").alias("n")).orderBy("third").collect()]
    assert got == [4, 4, 3]


@pytest.mark.parametrize(("limits", "edges"), [(correlation.Thresholds(0.99, 0.9, 30, 10), 1), (correlation.Thresholds(0.99, 0.9, 31, 10), 0), (correlation.Thresholds(0.99, 0.9, 30, 11), 0)])
def test_support_minima(spark, limits, edges):
    a = np.random.default_rng(2).normal(size=30)
    assert correlation.stable_edges(panel(spark, {"a": a, "b": -a}, 30), {"f": ["a", "b"]}, limits).count() == edges


def test_a_constant_third_is_no_edge(spark):
    a = np.concatenate([np.zeros(30), np.random.default_rng(3).normal(size=60)])
    p = panel(spark, {"a": a, "b": a})
    assert correlation.stable_edges(p, {"f": ["a", "b"]}, correlation.FAMILY).count() == 0


def test_election_removes_direct_partners_only():
    e = correlation.elect_leaders([("a", "b", 0.99), ("b", "c", 0.99), ("c", "d", 0.999)], {f: (f,) for f in "abcde"})
    assert set(e.representatives) == {"a", "c", "e"} or set(e.representatives) == {"c", "a", "e"}
    assert e.removed == {"b": "c", "d": "c"}


def test_roles_fail_closed(spark):
    profile = roles.RoleProfile(("core_a",), ("mom", "mom_long"))
    names = spark.createDataFrame([("core_a",), ("mom_long_5",), ("mom_5",), ("family_pc_mom_1",), ("what",)], "name string")
    got = {r["name"]: (r["role"], r["family"]) for r in roles.classify(names, profile).collect()}
    assert got == {"core_a": ("core", None), "mom_long_5": ("transformation", "mom_long"), "mom_5": ("transformation", "mom"), "family_pc_mom_1": ("generated", None), "what": (None, None)}
    with pytest.raises(ValueError, match="what"):
        roles.require(roles.classify(names, profile), profile)


def test_sources_reject_what_they_do_not_know(spark):
    source = features.PanelSource(panel(spark, {"a": [1, None, 3], "b": [1, 2, 3]}, 3))
    with pytest.raises(features.ContractError):
        source.read(features.Request(("zzz",)))
    with pytest.raises(features.ContractError):
        features.Request(("a", "a"))
    assert source.read(features.Request(("a",), mode=features.RESOLVED_MODEL)).count() == 2
    assert source.skipped(features.Request(("a",))).first().asDict() == {"total": 3, "retained": 2, "skipped": 1}
    with pytest.raises(features.ContractError):
        features.catalog(spark.createDataFrame([(dt.date(2020, 1, 1), 1)], "ts date, a int"))
    twice = panel(spark, {"a": [1]}, 1).union(panel(spark, {"a": [2]}, 1))
    assert features.violations(twice).first()[0] == 1


def test_lineage_does_not_depend_on_partitions(spark):
    p = panel(spark, {"a": range(50)}, 50)
    assert features.lineage(p, "d", "b").first() == features.lineage(p.repartition(7), "d", "b").first()


def stats(spark, loss=0.5, fold="2020-01"):
    row = (fold, "p", "b", "f", True, None, True, False, None, True, True, True, loss)
    return spark.createDataFrame([row], evidence.TABLES["fold_feature_stats"])


def test_commits_are_idempotent_and_refuse_conflicts(spark, tmp_path):
    store = evidence.EvidenceStore(spark, f"file://{tmp_path}/evidence")
    assert store.read("fold_feature_stats").count() == 0
    assert store.commit("fold_feature_stats", stats(spark))
    assert not store.commit("fold_feature_stats", stats(spark))
    with pytest.raises(evidence.Conflict):
        store.commit("fold_feature_stats", stats(spark, 0.6))
    assert store.commit("fold_feature_stats", stats(spark).union(stats(spark, 0.1, "2020-02")))
    assert store.read("fold_feature_stats").count() == 2 and store.tables() == ["fold_feature_stats"]
    g = evidence.global_stats(store.read("fold_feature_stats")).first()
    assert (g["folds"], g["selected_folds"], g["median_loss"], g["folds_since_selection"]) == (2, 2, 0.3, 0)


def test_builds_are_written_once_and_checked(spark, tmp_path):
    root = f"file://{tmp_path}/builds"
    ts = dt.datetime(2020, 1, 1)
    row = ("p", "1", "oos", ts, ["state_0", "state_1"], [0.25, 0.75], "state_1", 0.75, 0.5, "c", "f", "h", "d", "e")
    good = spark.createDataFrame([row], predictions.SCHEMA)
    predictions.publish(good, root, "p", "b1")
    with pytest.raises(Exception, match="exists"):
        predictions.publish(good, root, "p", "b1")
    _, rows = predictions.read(spark, root, "p", "b1")
    assert predictions.oos_slice(rows, ts, ts).count() == 1
    good.write.mode("append").parquet(f"{root}/p/b1/predictions")
    with pytest.raises(predictions.CorruptBuild):
        predictions.read(spark, root, "p", "b1")
    bad = spark.createDataFrame([(*row[:5], [0.25, 0.7], *row[6:])], predictions.SCHEMA)
    with pytest.raises(predictions.CorruptBuild):
        predictions.oos_slice(bad, dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 2))


def test_registry_is_idempotent_and_swaps_only_what_was_seen(tmp_path):
    from strandline.plans.model_queries import FIXED

    r = Registry(str(tmp_path))
    pack = package(FIXED, ["a", "b"], {"a": (0.1, 1.0), "b": (0.0, 2.0)}, "2020-01-01", [0.5, 0.5], {})
    assert r.register("m", pack) == r.register("m", pack) == 1
    assert r.load("m", 1) == pack
    r.move_alias("m", "champion", None, 1, "me")
    with pytest.raises(AliasChanged):
        r.move_alias("m", "champion", None, 1, "me")
    with pytest.raises(KeyError):
        r.move_alias("m", "champion", 1, 7, "me")
    assert r.resolve("m", "champion") == 1 and len(r.audit()) == 1


def test_search_keeps_what_helps_and_never_asks_twice():
    worth = {"a": 0.3, "b": 0.25, "c": 0.2, "d": 0.0}
    asked = []

    def evaluate(subsets):
        asked.extend(subsets)
        return [sum(worth[f] for f in s) - (0.4 if {"a", "b"} <= set(s) and "c" in s else 0) for s in subsets]

    found = selection.sffs("abcd", evaluate)
    assert found.selected == ("a", "b") and found.score == pytest.approx(0.55)
    assert len(asked) == len(set(asked)) == len(found.steps)
    assert selection.ablation(("a", "b"), evaluate) == [("a", pytest.approx(0.3)), ("b", pytest.approx(0.25))]
    with pytest.raises(ValueError):
        selection.ablation(("a",), evaluate)


def test_anchored_ties_do_not_chain(spark):
    rows = spark.createDataFrame([("x", 1.0, 1.0), ("y", 0.95, 2.0), ("z", 0.9, 3.0)], "candidate string, m double, n double")
    got = [r["candidate"] for r in selection.anchored_ranking(rows, [("m", 0.06), ("n", 0.0)]).orderBy("rank").collect()]
    assert got == ["y", "x", "z"]  # z is within 0.06 of y, but not of the best
    starts = spark.createDataFrame([(53, 1.0), (11, 1.0 - 5e-13), (3, 0.9)], "seed long, ll double")
    assert selection.anchored_winner(starts).first()["seed"] == 11


def plain_corr(x, y):
    both = np.isfinite(x) & np.isfinite(y)
    x, y = x[both], y[both]
    if len(x) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None, len(x)
    return abs(float(np.corrcoef(x, y)[0, 1])), len(x)


@pytest.mark.parametrize(("tile", "small"), [(3, 0), (512, 0), (4, 1 << 20)])
def test_correlations_by_tiles_equal_plain_ones(spark, monkeypatch, tile, small):
    monkeypatch.setattr(correlation, "TILE", tile)
    monkeypatch.setattr(blocks, "SMALL_BYTES", small)
    monkeypatch.setattr(blocks, "CHUNK_BYTES", 8 * 9 * 20)  # blocks of 20 rows
    rng = np.random.default_rng(31)
    x = rng.normal(size=(91, 9)) * [1, 1, 1e-3, 1e6, 1, 1, 1, 1, 1] + [0, 5, 1e4, 0, 0, 0, 0, 0, 0]
    x[:, 4] = 7.25  # constant
    x[rng.random((91, 9)) < 0.15] = np.nan
    x[:, 0] = rng.normal(size=91)  # complete
    x[:, 1] = x[:, 0] * 2 + 1e-4 * rng.normal(size=91)
    x[:, 8] = np.nan
    x[5, 8] = 1.0
    names = [f"f{k}" for k in range(9)]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "ts long, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r["left"], r["right"]): r for r in correlation.pair_correlations(df, {"f": names}).collect()}
    for i in range(9):
        for j in range(i + 1, 9):
            corr, n = plain_corr(x[:, i], x[:, j])
            assert ((names[i], names[j]) in got) == (n > 0)
            if n:
                r = got[names[i], names[j]]
                assert r["support"] == n and (r["abs_corr"] is None if corr is None else r["abs_corr"] == pytest.approx(corr, abs=1e-9))
    part = np.repeat([1, 2, 3], [31, 30, 30])
    thirds = {(r["left"], r["right"], r["third"]): r["abs_corr"] for r in correlation.third_correlations(df, {"f": names}).collect()}
    assert thirds[("f0", "f2", 2)] == pytest.approx(plain_corr(x[part == 2, 0], x[part == 2, 2])[0], abs=1e-9)
    edges = correlation.stable_edges(df, {"one": names[:4], "two": ["f1", "f0"]}, correlation.GLOBAL).collect()
    assert {(r["family"], r["left"], r["right"]) for r in edges} == {("one", "f0", "f1"), ("two", "f1", "f0")}


def test_ten_thousand_features(spark):
    """As wide as the acceptance test of the engine's contract: near-copies in 10,000 columns, from 5e7 pairs."""
    rng = np.random.default_rng(32)
    d, n = 10_000, 36
    x = rng.normal(size=(n, d))
    x[:, 9_000] = x[:, 17] * 3
    x[:, 600] = -x[:, 599]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "ts long, v array<double>")
    names = [f"f{k:05d}" for k in range(d)]
    wide = rows.selectExpr("ts", *[f"v[{k}] AS {c}" for k, c in enumerate(names)])
    edges = correlation.stable_edges(wide, {"all": names}, correlation.Thresholds(0.995, 0.99)).collect()
    assert {(r["left"], r["right"]) for r in edges} == {("f00017", "f09000"), ("f00599", "f00600")}


def test_elections_equal_the_plain_greedy():
    rng = random.Random(33)
    for _ in range(60):
        names = [f"n{k}" for k in range(rng.randint(2, 14))]
        edges = [(a, b, round(rng.uniform(0.95, 1), 2)) for k, a in enumerate(names) for b in names[k + 1 :] if rng.random() < 0.3]
        near = {f: {} for f in names}
        for a, b, c in edges:
            near[a][b] = near[b][a] = c
        left, leaders, removed = set(names), [], {}
        while left:
            partners = {f: [c for g, c in near[f].items() if g in left] for f in left}
            best = min(left, key=lambda f: (-len(partners[f]), -float(np.median(partners[f])) if partners[f] else 0.0, f))
            leaders.append(best)
            for g in near[best]:
                if g in left:
                    removed[g] = best
            left -= {best, *near[best]}
        got = correlation.elect_leaders(edges, {f: (f,) for f in names})
        assert (got.representatives, got.removed) == (tuple(leaders), removed)


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_families_are_projected_in_one_pass(spark, monkeypatch, small):
    monkeypatch.setattr(blocks, "SMALL_BYTES", small)
    rng = np.random.default_rng(34)
    x = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) + 1e5
    x[rng.random((120, 6)) < 0.05] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) + (3.0,) for r in x], ", ".join(f"f{k} double" for k in range(7))).repartition(4)
    found = pca.fit_families(df, {"a": ["f0", "f1", "f2"], "b": ["f3", "f4", "f5"], "flat": ["f0", "f6"]})
    for name, at in (("a", [0, 1, 2]), ("b", [3, 4, 5])):
        own = x[:, at][np.isfinite(x[:, at]).all(axis=1)]
        z = (own - own.mean(axis=0)) / own.std(axis=0)
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        np.testing.assert_allclose(np.abs(found[name].components), np.abs(vt), atol=1e-6)
        np.testing.assert_allclose(found[name].explained, s**2 / (s**2).sum(), atol=1e-9)
    assert isinstance(found["flat"], pca.StatisticallyInvalid)
    assert pca.PCA.from_dict(found["a"].to_dict()) == found["a"]
    with pytest.raises(pca.StatisticallyInvalid):
        pca.fit_families(df, {"flat": ["f0", "f6"]}, strict=True)


def test_spearman_of_a_broadcast_panel_equals_windows(spark, monkeypatch):
    rng = np.random.default_rng(35)
    x = np.round(rng.normal(size=(80, 5)), 1)  # ties
    x[rng.random((80, 5)) < 0.1] = np.nan
    x[:, 0], x[:, 1] = np.round(rng.normal(size=80), 1), np.round(rng.normal(size=80), 1)  # complete
    x[:, 4] = 2.0
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"f{k} double" for k in range(5)))
    families = {"one": ["f0", "f1", "f2"], "two": ["f3", "f4"]}
    found = []
    for small in (1 << 20, 0):
        monkeypatch.setattr(blocks, "SMALL_BYTES", small)
        found.append({(r["left"], r["right"]): (r["distance"], r["support"]) for r in correlation.spearman_distance(df, families).collect()})
    assert set(found[0]) == {("f0", "f1"), ("f0", "f2"), ("f1", "f2"), ("f3", "f4")} == set(found[1])
    for k, (distance, n) in found[0].items():
        assert n == found[1][k][1] and (distance is None) == (found[1][k][0] is None) and (distance is None or distance == pytest.approx(found[1][k][0], abs=1e-12))
