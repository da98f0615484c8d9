"""Walk-forward, service, stream and command line, end to end on small panels."""

import datetime as dt
import json
import os
import time as clock

import numpy as np
import pytest
from pyspark.sql.functions import udf

from strandline.models import hmm
from strandline.operators import filtering
from strandline.plans import refit
from strandline.plans.service import Busy, DeadlineExceeded, Engine
from strandline.sources import profiles
from strandline.sources.registry import Registry, package
from strandline.streaming.causal import filter_stream


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    state, rows = 0, []
    for i in range(200):
        state = state if rng.random() < 0.95 else 1 - state
        m = 2.0 * (1 - 2 * state)
        a, b = rng.normal(m, 0.6), rng.normal(-m, 0.6)
        rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=i), float(a), float(b), float(a + 1e-6 * rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "ts date, a double, b double, mom_1 double, mom_2 double").cache()


def test_a_fold_is_selected_fitted_and_tested(spark, panel):
    s = refit.Settings(core=("a", "b"), families={"mom": ("mom_1", "mom_2")}, seeds=(11, 23, 37, 53, 71, 89), max_features=2, min_train=90, inner_min_train=31, state_counts=(2,), model_families=(hmm.GAUSSIAN,))
    results = refit.run_monthly(spark, panel, s, last=1)
    assert [r.fold_id for r in results] == ["fold_002"]
    r = results[0]
    assert r.valid and 0 < len(r.selected) <= 2 and r.test_n > 25 and len(r.package) == 64
    later = panel.filter("ts < '2020-06-01'").union(panel.filter("ts >= '2020-06-01'").selectExpr("ts", "a + 5", "b", "mom_1", "mom_2"))
    again = refit.run_monthly(spark, later, s, last=1)[0]
    assert (again.package, again.selected) == (r.package, r.selected) and again.test_ll != r.test_ll  # TEST changes no identity


def test_too_little_data_is_an_invalid_fold_with_a_reason(spark, panel):
    r = refit.run_monthly(spark, panel.selectExpr("ts", "cast(1 as double) a"), refit.Settings(core=("a",), min_train=90), last=1)[0]
    assert not r.valid and r.reason


def test_service_answers_from_the_registry(spark, panel, tmp_path):
    r = refit.final_refit(spark, panel, ["a", "b"], 2, min_rows=100, cutoff=dt.date(2020, 6, 1))
    registry = Registry(str(tmp_path))
    pack = package(r["model"], r["features"], r["scaler"], r["trained_through"].isoformat(), r["alpha"], {})
    registry.move_alias("m", "champion", None, registry.register("m", pack), "test")
    engine = Engine(registry, panel)
    now = engine.latest("m", dt.date(2020, 7, 1))
    assert now["time"] == dt.date(2020, 7, 1) and now["freshness"] == "fresh" and abs(sum(now["p"]) - 1) < 1e-12
    past = engine.latest("m", dt.date(2020, 3, 1))
    assert past["time"] == dt.date(2020, 3, 1) and past["warmup"] == 60
    rows = engine.replay("m", dt.date(2020, 6, 20), dt.date(2020, 7, 1)).orderBy("time").collect()
    assert len(rows) == 12
    np.testing.assert_allclose(rows[-1]["state_probabilities"], now["p"], atol=1e-9)
    with pytest.raises(filtering.LimitExceeded):
        Engine(registry, panel, limits=filtering.ReplayLimits(rows=3)).replay("m", dt.date(2020, 6, 1), dt.date(2020, 7, 1))
    with engine._admitted(), pytest.raises(Busy):
        engine.replay("m", dt.date(2020, 6, 1), dt.date(2020, 6, 2))
    assert engine.health(["m", "x"]) == {"ready": False, "versions": {"m": 1, "x": None}}


def test_a_replay_is_admitted_until_its_rows_are_here_and_has_a_deadline(spark, panel, tmp_path):
    r = refit.final_refit(spark, panel, ["a", "b"], 2, min_rows=100)
    registry = Registry(str(tmp_path))
    registry.move_alias("m", "champion", None, registry.register("m", package(r["model"], r["features"], r["scaler"], r["trained_through"].isoformat(), r["alpha"], {})), "test")
    slow = udf(lambda x: (clock.sleep(0.05), x)[1], "double")
    engine = Engine(registry, panel.coalesce(1).withColumn("a", slow("a")), deadline_s=2)
    with pytest.raises(DeadlineExceeded):
        engine.replay("m", dt.date(2020, 1, 1), dt.date(2020, 7, 1))
    assert profiles.status_of(DeadlineExceeded()) == 504 and engine._admission.acquire(blocking=False)


def test_packages_in_use_stay(spark, panel, tmp_path):
    r = refit.final_refit(spark, panel, ["a", "b"], 2, min_rows=100)
    registry = Registry(str(tmp_path))
    for k in range(4):
        v = registry.register("m", package(r["model"], r["features"], r["scaler"], r["trained_through"].isoformat(), r["alpha"], {"k": k}))
        registry.move_alias("m", f"a{k}", None, v, "test")
    engine = Engine(registry, panel)
    with engine._leased("m", "a0"):
        for k in (1, 2, 3):
            engine._pack("m", f"a{k}")
        assert ("m", 1) in engine._packs and len(engine._packs) <= engine.VERSIONS + 1
    engine._pack("m", "a1")
    assert len(engine._packs) <= engine.VERSIONS


def test_rollback_and_a_lock_left_by_a_crash(tmp_path):
    registry = Registry(str(tmp_path))
    m = hmm.HMM(hmm.GAUSSIAN, np.array([1.0]), np.ones((1, 1)), np.zeros((1, 1)), np.ones((1, 1, 1)), log_likelihood=0.0)
    one, two = (registry.register("m", package(m, ["x"], {"x": (0.0, 1.0)}, "2020-01-01", [1.0], {"k": k})) for k in (1, 2))
    registry.move_alias("m", "champion", None, one, "a")
    with pytest.raises(KeyError):
        registry.rollback("m", "champion", "a")
    registry.move_alias("m", "champion", one, two, "a")
    assert registry.rollback("m", "champion", "b") == one == registry.resolve("m", "champion")
    (tmp_path / ".lock").touch()
    with pytest.raises(TimeoutError), registry._locked(0.05):
        pass
    os.utime(tmp_path / ".lock", (0, 0))
    with registry._locked(0.05):
        assert (tmp_path / ".lock").exists()
    assert not (tmp_path / ".lock").exists()


def test_stream_equals_batch_and_rejects_late_rows(spark, tmp_path):
    m = hmm.HMM(hmm.GAUSSIAN, np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[-1.0], [1.0]]), np.ones((2, 1, 1)))
    values = [0.5, -1.0, None, 2.0, 0.1, 1.5]
    t = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    schema = "series string, ts timestamp, x double"
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, part in enumerate(([0, 1, 2], [3, 4], [1, 5])):
        spark.createDataFrame([("s", t[i], values[i]) for i in part], schema).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
        q = filter_stream(stream, m, ["x"], "series").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(out).orderBy("time").collect()
    late = [r for r in rows if r["rejected"]]
    assert [r["time"] for r in late] == [t[1]]
    batch = spark.createDataFrame([("s", a, b) for a, b in zip(t, values)], schema)
    expected = filtering.forward_filter(batch, {"m": m}, ["x"]).orderBy("time").collect()
    got = [r for r in rows if not r["rejected"]]
    assert [r["time"] for r in got] == [r["time"] for r in expected]
    np.testing.assert_allclose([r["p"] for r in got], [r["p"] for r in expected], atol=1e-12)


def test_command_line(spark, panel, tmp_path, capsys):
    from strandline.__main__ import main

    Registry(str(tmp_path))
    assert main(["status", "--profile", "m", "--registry", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out) == {"versions": [], "champion": None}


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


def test_a_package_file_is_published_if_it_has_its_hash(tmp_path, capsys):
    from strandline.__main__ import main

    one, two = Registry(str(tmp_path / "one")), Registry(str(tmp_path / "two"))
    m = hmm.HMM(hmm.GAUSSIAN, np.array([1.0]), np.ones((1, 1)), np.zeros((1, 1)), np.ones((1, 1, 1)), log_likelihood=0.0)
    one.register("m", package(m, ["x"], {"x": (0.1, 1.0)}, "2020-01-01", [1.0], {}))
    file = tmp_path / "one" / "models" / "m" / "1.json"
    assert main(["publish-package", "--profile", "m", "--registry", str(tmp_path / "two"), "--package", str(file)]) == 0
    assert json.loads(capsys.readouterr().out) == {"version": 1} and two.load("m", 1) == one.load("m", 1)
    file.write_text(file.read_text().replace("2020-01-01", "2020-01-02"))
    with pytest.raises(ValueError):
        two.publish("m", file)
    assert main(["promote", "--profile", "m", "--registry", str(tmp_path / "two"), "--version", "1", "--actor", "a"]) == 0
