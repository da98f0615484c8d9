"""Models, filters and PCA against plain numpy, hand-computed values and each other."""

import datetime as dt

import numpy as np
import pytest

from strandline.models import alignment, hmm
from strandline.operators import filtering, multistart, pca


def two_regimes(n=400, seed=3):
    rng = np.random.default_rng(seed)
    states, x = [0], []
    for _ in range(n):
        states.append(states[-1] if rng.random() < 0.97 else 1 - states[-1])
        x.append(rng.normal([-2, 1] if states[-1] == 0 else [2, -1], 0.7))
    return np.array(x), np.array(states[1:])


def test_equal_emissions_leave_the_chain():
    p, _ = hmm.forward(np.zeros((2, 2)), np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.2, 0.8]]))
    np.testing.assert_allclose(p, [[0.7, 0.3], [0.69, 0.31]], atol=1e-15)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_blocks_equal_the_plain_recursion(n):
    rng = np.random.default_rng(n)
    e, a, start = rng.normal(0, 20, (n, 3)), rng.dirichlet([1, 1, 1], 3), np.array([0.2, 0.5, 0.3])
    p, inc = hmm.forward(e, start, a)
    gamma, xi, ll = hmm.expectation(e, start, a)
    prior, alphas = start, []
    for t in range(n):
        w = prior * np.exp(e[t] - e[t].max())
        np.testing.assert_allclose(p[t], w / w.sum(), atol=1e-12)
        assert inc[t] == pytest.approx(e[t].max() + np.log(w.sum()))
        alphas.append(w / w.sum())
        prior = alphas[-1] @ a
    beta, smooth, counts = np.ones(3), [None] * n, np.zeros((3, 3))
    for t in range(n - 1, -1, -1):
        g = alphas[t] * beta
        smooth[t] = g / g.sum()
        if t:
            w = np.exp(e[t] - e[t].max()) * beta
            j = alphas[t - 1][:, None] * a * w
            counts += j / j.sum()
            beta = a @ w / (a @ w).sum()
    np.testing.assert_allclose(gamma, smooth, atol=1e-10)
    np.testing.assert_allclose(xi, counts, atol=1e-8)
    assert ll == pytest.approx(inc.sum())


def test_continuing_equals_one_run_and_differs_from_a_restart():
    x, _ = two_regimes(60)
    m = hmm.fit(x, 2)
    e = m.log_emissions(x)
    whole, inc = hmm.forward(e, m.start, m.transition)
    first, _ = hmm.forward(e[:30], m.start, m.transition)
    rest, inc_rest = hmm.forward(e[30:], m.start, m.transition, first[-1])
    np.testing.assert_allclose(rest, whole[30:], atol=1e-14)
    np.testing.assert_allclose(inc_rest, inc[30:], atol=1e-12)


def test_filter_is_causal():
    x, _ = two_regimes(80)
    m = hmm.fit(x, 2)
    changed = x.copy()
    changed[50:] += 9
    a, _ = hmm.forward(m.log_emissions(x), m.start, m.transition)
    b, _ = hmm.forward(m.log_emissions(changed), m.start, m.transition)
    np.testing.assert_array_equal(a[:50], b[:50])


@pytest.mark.parametrize("family", hmm.FAMILIES)
def test_fit_recovers_separated_regimes(family):
    x, states = two_regimes()
    m = hmm.fit(x, 2, family, seed=11)
    assert m.converged and hmm.covariance_reason(m) is None
    p, inc = hmm.forward(m.log_emissions(x), m.start, m.transition)
    found = p.argmax(axis=1)
    assert max((found == states).mean(), (found != states).mean()) > 0.97
    assert abs(inc.sum() - m.log_likelihood) < 1e-6 * abs(inc.sum())
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(m.history, m.history[1:]))


def test_log_likelihood_equals_the_sum_over_paths():
    x, _ = two_regimes(6)
    m = hmm.HMM(hmm.GAUSSIAN, np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[-1.0, 0], [1, 0]]), np.repeat(np.eye(2)[None], 2, axis=0))
    e = np.exp(m.log_emissions(x))
    total = 0.0
    for path in range(2**6):
        s = [(path >> k) & 1 for k in range(6)]
        v = m.start[s[0]] * e[0, s[0]]
        for t in range(1, 6):
            v *= m.transition[s[t - 1], s[t]] * e[t, s[t]]
        total += v
    _, inc = hmm.forward(m.log_emissions(x), m.start, m.transition)
    assert inc.sum() == pytest.approx(np.log(total), abs=1e-10)


def test_digamma_and_nu():
    assert hmm.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert hmm.digamma(0.5) == pytest.approx(-1.9635100260214235, abs=1e-10)
    assert hmm.NU_LOW <= hmm.update_nu(np.ones(50), np.ones(50), 10.0, 2) <= hmm.NU_HIGH


def test_alignment_finds_the_permutation_and_refuses_ambiguity():
    x, _ = two_regimes()
    m = hmm.fit(x, 2)
    assert alignment.to_reference(m.permuted([1, 0]), alignment.signatures(m)) == [1, 0]
    same = hmm.HMM(hmm.GAUSSIAN, m.start, m.transition, np.zeros((2, 2)), np.repeat(np.eye(2)[None], 2, axis=0))
    with pytest.raises(alignment.AmbiguousAlignment):
        alignment.to_reference(same, alignment.signatures(m))
    with pytest.raises(alignment.AmbiguousAlignment):
        alignment.first_order(same)


def test_coordinates_change_and_return():
    mean, cov = np.array([0.3, -1.0]), np.array([[1.0, 0.2], [0.2, 0.5]])
    a, b = (np.array([1.0, 2]), np.array([2.0, 3])), (np.array([0.0, 1]), np.array([1.0, 5]))
    m, c = alignment.in_coordinates(*alignment.in_coordinates(mean, cov, a, b), b, a)
    np.testing.assert_allclose(m, mean)
    np.testing.assert_allclose(c, cov)


def panel(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 2))
    x = np.column_stack([z[:, 0], 0.6 * z[:, 0] + 0.8 * z[:, 1], z[:, 1] * 3 + 1])
    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "ts date, a double, b double, c double"), x


def test_pca_equals_svd_and_drops_rank(spark):
    df, x = panel(spark)
    p = pca.fit(df, ["a", "b", "c"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert len(p.components) == 2  # b is a combination of a and c
    np.testing.assert_allclose(np.abs(np.array(p.components)), np.abs(v[:2]), atol=1e-8)
    np.testing.assert_allclose(p.explained, (s**2 / (s**2).sum())[:2], atol=1e-10)
    for c in p.components:
        assert max(c, key=abs) > 0
    got = np.array([r[1:] for r in pca.transform(df, p, "pc", ["ts"]).orderBy("ts").collect()])
    np.testing.assert_allclose(got, z @ np.array(p.components).T, atol=1e-8)


def test_pca_ignores_rows_outside_its_panel(spark):
    df, _ = panel(spark)
    early = df.filter("ts < '2020-02-10'")
    changed = early.union(df.filter("ts >= '2020-02-10'").selectExpr("ts", "a + 100", "b", "c"))
    assert pca.fit(changed.filter("ts < '2020-02-10'"), ["a", "c"]) == pca.fit(early, ["a", "c"])


def test_terminal_state_in_the_jvm_equals_the_task(spark):
    df, _ = panel(spark)
    m = hmm.HMM(hmm.GAUSSIAN, np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[-0.5, 0], [0.5, 1]]), np.repeat(np.eye(2)[None], 2, axis=0))
    a = filtering.terminal_state(df, m, ["a", "c"]).first()
    full = filtering.forward_filter(df, {"m": m}, ["a", "c"]).orderBy("time").collect()
    np.testing.assert_allclose(a["p"], full[-1]["p"], atol=1e-12)
    assert a["ll"] == pytest.approx(sum(r["ll_inc"] for r in full))


def test_latest_continues_from_a_stored_state(spark):
    df, _ = panel(spark)
    m = hmm.HMM(hmm.GAUSSIAN, np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[-0.5, 0], [0.5, 1]]), np.repeat(np.eye(2)[None], 2, axis=0))
    cut, end = dt.date(2020, 2, 1), dt.date(2020, 2, 20)
    through, alpha = filtering.terminal_alpha(df.filter(df.ts <= cut), m, ["a", "c"])
    stored = filtering.latest(df, m, ["a", "c"], end, trained_through=through, alpha=alpha).first()
    origin = filtering.latest(df, m, ["a", "c"], end).first()
    np.testing.assert_allclose(stored["p"], origin["p"], atol=1e-12)
    assert stored["time"] == origin["time"] == end
    none_after = filtering.latest(df.filter(df.ts <= cut), m, ["a", "c"], end, trained_through=through, alpha=alpha).first()
    assert none_after["time"] == through and none_after["p"] == alpha


def test_replay_limits(spark):
    df, _ = panel(spark)
    with pytest.raises(filtering.LimitExceeded):
        filtering.check_replay(df, dt.date(2020, 1, 1), dt.date(2020, 2, 1), 2, filtering.ReplayLimits(rows=10))
    assert filtering.check_replay(df, dt.date(2020, 1, 5), dt.date(2020, 1, 9), 2)["rows"] == 5


def test_multistart_gives_the_same_rows_for_any_partitioning(spark):
    x, _ = two_regimes(120)
    jobs = [multistart.Job("j", (0, 1), 100, 20, 2), multistart.Job("bad", (0,), 5, 0, 2)]
    a = sorted(map(tuple, multistart.run(spark, x, jobs, (11, 23)).select("job", "seed", "ok", "reason", "ll").collect()), key=str)
    b = sorted(map(tuple, multistart.run(spark, x, jobs, (11, 23)).repartition(1).select("job", "seed", "ok", "reason", "ll").collect()), key=str)
    assert a == b
    assert {r[3] for r in a if r[0] == "bad"} == {"too_few_rows"}
    w = {r["job"]: r for r in multistart.winners(multistart.run(spark, x, jobs, (11, 23)), 1, 0.5).collect()}
    assert w["j"]["valid"] and not w["bad"]["valid"]


@pytest.mark.parametrize("family", hmm.FAMILIES)
def test_seeds_fitted_together_equal_seeds_fitted_alone(family):
    rng = np.random.default_rng(41)
    state = np.cumsum(rng.random(300) < 0.05) % 2
    x = rng.normal(size=(300, 2)) + 3.0 * state[:, None]
    seeds = [11, 23, 37, 53]
    for seed, found in zip(seeds, hmm.fit_many(x, 2, family, seeds, 60), strict=True):
        alone = hmm.fit(x, 2, family, seed, 60)
        assert (found.converged, len(found.history)) == (alone.converged, len(alone.history))
        np.testing.assert_allclose(found.history, alone.history, rtol=1e-12)
        np.testing.assert_allclose(found.means, alone.means, atol=1e-9)


def test_one_failing_seed_leaves_the_others(monkeypatch):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(-4, 1, (80, 1)), rng.normal(4, 1, (80, 1))])
    plain = hmm._started

    def started(x, states, family, seed):
        m = plain(x, states, family, seed)
        if seed == 2:
            m.start, m.transition = np.array([1.0, 0.0]), np.array([[0.0, 1.0], [0.0, 0.0]])  # no path explains three rows
        return m

    monkeypatch.setattr(hmm, "_started", started)
    one, two, three = hmm.fit_many(x, 2, hmm.GAUSSIAN, [1, 2, 3])
    assert isinstance(two, FloatingPointError) and one.converged and three.converged


def test_smoothing_equals_the_plain_recursion():
    rng = np.random.default_rng(43)
    for n, k in ((1, 2), (2, 3), (7, 2), (50, 4)):
        log_e, start, a = rng.normal(size=(n, k)), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
        e = np.exp(log_e)
        alpha, beta = np.zeros((n, k)), np.ones((n, k))
        alpha[0] = start * e[0]
        for i in range(1, n):
            alpha[i] = alpha[i - 1] @ a * e[i]
        for i in range(n - 2, -1, -1):
            beta[i] = a @ (e[i + 1] * beta[i + 1])
        total = alpha[-1].sum()
        xi = sum((alpha[i][:, None] * a * (e[i + 1] * beta[i + 1])[None] / total for i in range(n - 1)), np.zeros((k, k)))
        gamma, counts, ll = hmm.expectation(log_e, start, a)
        np.testing.assert_allclose(gamma, alpha * beta / total, atol=1e-12)
        np.testing.assert_allclose(counts, xi, atol=1e-12)
        assert ll == pytest.approx(np.log(total))
