"""Every regime query against its DuckDB SQL; every one without SQL gives rows of a stable schema."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import multistart
from strandline.plans import catalogue, refit
from strandline.plans.oracle_panels import LINEITEM_DAILY
from strandline.sources import panels
from tests.oracle import DATA, agree, connect

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    agree(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", ["q_leader_election", "q_alignment", "q_family_pca_fit", "q_publish_oos", "q_lineage", "q_hmm_fit_gaussian", "q_sffs"])
def test_query_gives_rows(spark, name):
    df = catalogue.queries()[name](spark, str(DATA / SF))
    assert df.count() > 0
    assert df.schema == catalogue.queries()[name](spark, str(DATA / SF)).schema


def test_the_audit_compares_every_order(spark):
    keys = [r[0] for r in spark.read.parquet(str(DATA / SF / "orders.parquet")).select("o_orderkey").collect()]
    named = {"0": "unexpected", "1": "missing", "2": "differs", "3": "repeated"}
    digits = {k: hashlib.md5(str(k).encode()).hexdigest()[0] for k in keys}
    got = {r["k"]: r["problem"] for r in catalogue.queries()["q_result_audit"](spark, str(DATA / SF)).collect()}
    assert got == {k: named[d] for k, d in digits.items() if d in named} and max(got) > 600


def _stub(spark, calls, ok=8):
    """multistart.run that fits nothing: ok of the seeds succeed, larger sets score higher, and every call is noted."""

    def run(_, matrix, jobs, seeds=multistart.SEEDS, *rest):
        calls.append((jobs, tuple(seeds)))
        rows = [(j.job, s, i < ok, None, 1.0 * len(j.columns), 1e3 * len(j.columns), j.test, "{}") for j in jobs for i, s in enumerate(seeds)]
        return spark.createDataFrame(rows, multistart.RESULT)

    return run


def test_searches_use_every_seed_set_size_and_state_count(spark, monkeypatch):
    sf, q = str(DATA / SF), catalogue.queries()
    for name, counts in {"q_sffs": {2}, "q_k_sffs": {2, 3, 4, 5}, "q_ablation": {2}}.items():
        calls = []
        monkeypatch.setattr(multistart, "run", _stub(spark, calls))
        found = q[name](spark, sf)
        assert {seeds for _, seeds in calls} == {multistart.SEEDS} and {j.states for jobs, _ in calls for j in jobs} == counts
        assert {k: {c for jobs, _ in calls for j in jobs if j.states == k for c in j.columns} for k in counts} == {k: {0, 1, 2} for k in counts}
        assert max(len(j.columns) for jobs, _ in calls for j in jobs) == 3
        value = "loss" if name == "q_ablation" else "score"
        assert all(r[value] is not None for r in found.collect())
        monkeypatch.setattr(multistart, "run", _stub(spark, [], ok=5))
        assert all(r[value] is None for r in q[name](spark, sf).collect())


def test_final_refit_has_regimes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(refit, "final_refit", lambda *a, **k: seen.append(a) or {"features": [], "rows": 0, "trained_through": "", "alpha": []})
    catalogue.queries()["q_final_refit"](spark, str(DATA / SF))
    assert seen[0][3] >= 2


def _lineitem(spark, folder, days):
    """A lineitem table of one line a day, of the given prices and quantities."""
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k), p, q, 0.05, 0.02, "N") for k, (p, q) in enumerate(days)]
    schema = "l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def test_a_refit_that_a_gate_rejects_is_a_row_with_its_reason(spark, tmp_path):
    q, rng = catalogue.queries()["q_final_refit"], np.random.default_rng(5)
    noise = rng.normal(size=(600, 2))
    noise[::100] *= 60  # six days far from the others: a state of 1 % of the days at most
    sf = _lineitem(spark, tmp_path / "odd", (noise + 1000).tolist())
    (r,) = q(spark, sf).collect()
    assert (r["features"], r["rows"], r["trained_through"]) == ('["price", "quantity"]', 600, "2021-08-22")
    assert r["alpha"] is None and r["reason"] == "a state is hardly occupied" and 0 < min(r["hard"]) <= 0.01 and abs(sum(r["soft"]) - 1) < 1e-9
    with pytest.raises(refit.Rejected, match="hardly occupied"):  # to deploy it stays an error
        refit.final_refit(spark, panels.lineitem_daily(spark, sf), ["price", "quantity"], 2)
    (r,) = q(spark, _lineitem(spark, tmp_path / "short", noise[:100].tolist())).collect()
    assert (r["rows"], r["trained_through"], r["alpha"], r["reason"]) == (100, "2020-04-09", None, "100 rows, 504 needed")
    (r,) = q(spark, _lineitem(spark, tmp_path / "none", [])).collect()
    assert (r["rows"], r["trained_through"], r["alpha"], r["reason"]) == (0, None, None, "0 rows, 504 needed")
    states = np.repeat([0, 1, 0, 1], 150)[:, None]
    (r,) = q(spark, _lineitem(spark, tmp_path / "two", (rng.normal(size=(600, 2)) + 6 * states).tolist())).collect()
    assert r["reason"] is None and r["alpha"][1] > 0.99 and r["hard"] == [0.5, 0.5]


def test_a_refit_reads_every_day_and_keeps_its_gates(spark):
    """At a size whose fit is rejected. Days and last day are DuckDB's."""
    days, last = connect("sf0.01").execute(f"WITH {LINEITEM_DAILY} SELECT count(*), max(ts)::VARCHAR FROM lineitem_daily WHERE price IS NOT NULL AND quantity IS NOT NULL").fetchone()
    (r,) = catalogue.queries()["q_final_refit"](spark, str(DATA / "sf0.01")).collect()
    assert (r["rows"], r["trained_through"]) == (days, last) and len(r["hard"]) == len(r["soft"]) == 2
    kept = min(r["hard"]) >= 0.03 and min(r["soft"]) >= 0.05
    assert (r["alpha"] is not None) == (r["reason"] is None) == kept
    assert abs(sum(r["hard"]) - 1) < 1e-9 and abs(sum(r["soft"]) - 1) < 1e-9


def test_a_refit_of_odd_values_and_days_is_no_error(spark, tmp_path):
    q, rng = catalogue.queries()["q_final_refit"], np.random.default_rng(5)
    days = (rng.normal(size=(600, 2)) + 6 * np.repeat([0, 1, 0, 1], 150)[:, None]).tolist()
    odd = lambda v: [[v, days[100][1]] if k == 100 else d for k, d in enumerate(days)]
    for name, value, reason in (("infinite", float("inf"), "1 rows are not finite"), ("overflow", 1.7e308, "too few starts converged")):
        (r,) = q(spark, _lineitem(spark, tmp_path / name, odd(value))).collect()
        assert (r["rows"], r["trained_through"], r["alpha"], r["reason"]) == (600, "2021-08-22", None, reason)
    sf = _lineitem(spark, tmp_path / "missing", odd(None))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    undated = lines.withColumn("l_shipdate", F.when(F.col("l_shipdate") < "2021-08-22", F.col("l_shipdate")))
    undated.write.parquet(str(tmp_path / "undated" / "lineitem.parquet"))
    (r,) = q(spark, str(tmp_path / "undated")).collect()  # a line of no day is of no row, as is a day of no price
    assert (r["rows"], r["trained_through"], r["reason"]) == (598, "2021-08-21", None)
    assert min(r["hard"]) > 0.49 and r["alpha"][1] > 0.99
