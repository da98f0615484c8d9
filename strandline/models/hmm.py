"""Hidden Markov models with Gaussian, two-component mixture and Student-t emissions.

Baum-Welch in the log domain (Rabiner 1989); the Student-t M-step is an ECM step (Peel and McLachlan 2000). A fit whose
log-likelihood falls by more than rounding, or that doesn't settle in its rounds, is not converged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

GAUSSIAN, MIXTURE, STUDENT_T = "gaussian", "gmm", "student_t"
FAMILIES = (GAUSSIAN, MIXTURE, STUDENT_T)
MIN_COVARIANCE, TOLERANCE, MAX_ROUNDS = 1e-6, 1e-4, 1000
NU_START, NU_LOW, NU_HIGH, NU_ROUNDS = 10.0, 2.05, 200.0, 200


@dataclass
class HMM:
    family: str
    start: np.ndarray
    transition: np.ndarray
    means: np.ndarray  # states x d; mixtures: states x components x d
    covariances: np.ndarray  # states x d x d; mixtures: states x components x d x d
    weights: np.ndarray | None = None
    nu: np.ndarray | None = None
    log_likelihood: float = float("nan")
    converged: bool = False
    history: list[float] = field(default_factory=list)

    @property
    def states(self) -> int:
        return len(self.start)

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        if self.family == MIXTURE:
            parts = component_log_densities(x, self)
            top = parts.max(axis=2, keepdims=True)
            return top[:, :, 0] + np.log(np.exp(parts - top).sum(axis=2))
        if self.family == STUDENT_T:
            return np.stack([student_t_log_density(x, m, c, v) for m, c, v in zip(self.means, self.covariances, self.nu, strict=True)], axis=1)
        return np.stack([gaussian_log_density(x, m, c) for m, c in zip(self.means, self.covariances, strict=True)], axis=1)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of each state, matched to the mixture where there is one."""
        if self.family != MIXTURE:
            return self.means, self.covariances
        mean = np.einsum("km,kmd->kd", self.weights, self.means)
        off = self.means - mean[:, None]
        return mean, np.einsum("km,kmde->kde", self.weights, self.covariances + off[..., None] * off[..., None, :])

    def permuted(self, order: list[int]) -> HMM:
        pick = lambda a: None if a is None else a[order]
        return HMM(self.family, self.start[order], self.transition[np.ix_(order, order)], self.means[order], self.covariances[order], pick(self.weights), pick(self.nu), self.log_likelihood, self.converged, self.history)

    def to_dict(self) -> dict:
        listed = lambda a: None if a is None else np.asarray(a).tolist()
        return {"family": self.family, "start": listed(self.start), "transition": listed(self.transition), "means": listed(self.means), "covariances": listed(self.covariances), "weights": listed(self.weights), "nu": listed(self.nu), "log_likelihood": self.log_likelihood, "converged": self.converged}

    @staticmethod
    def from_dict(d: dict) -> HMM:
        a = lambda v: None if v is None else np.array(v, float)
        return HMM(d["family"], a(d["start"]), a(d["transition"]), a(d["means"]), a(d["covariances"]), a(d["weights"]), a(d["nu"]), d["log_likelihood"], d["converged"])


def _form(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, float]:
    chol = np.linalg.cholesky(cov)
    z = (x - mean) @ np.linalg.inv(chol).T
    return np.einsum("nd,nd->n", z, z), 2 * float(np.log(np.diag(chol)).sum())


def gaussian_log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    q, logdet = _form(x, mean, cov)
    return -0.5 * (q + logdet + x.shape[1] * math.log(2 * math.pi))


def student_t_log_density(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, nu: float) -> np.ndarray:
    q, logdet = _form(x, mean, scale)
    d = x.shape[1]
    return math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - 0.5 * (logdet + d * math.log(nu * math.pi)) - (nu + d) / 2 * np.log1p(q / nu)


def component_log_densities(x: np.ndarray, m: HMM) -> np.ndarray:
    out = np.empty((len(x), *m.weights.shape))
    for k in range(m.states):
        for c in range(m.weights.shape[1]):
            out[:, k, c] = math.log(max(m.weights[k, c], 1e-300)) + gaussian_log_density(x, m.means[k, c], m.covariances[k, c])
    return out


def _steps(e: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition-and-emission matrices of rows 1 to n - 1 of each model (models x rows x K x K), and the same in blocks of equal length, the last filled
    up with identities, with models and blocks last (length x K x K x models x blocks), so that a step over all of them runs along memory."""
    models, n, k = e.shape
    n -= 1
    length = max(1, math.isqrt(max(n, 1)))
    blocks = max(1, -(-n // length))
    m = np.empty((models, blocks * length, k, k))
    m[:, :n] = transition[:, None] * e[:, 1:, None, :]
    m[:, n:] = np.eye(k)
    return m[:, :n], np.ascontiguousarray(m.reshape(models, blocks, length, k, k).transpose(2, 3, 4, 0, 1))


def _normalised(v: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    total = v.sum(axis=axes, keepdims=True)
    if not (total > 0).all():
        raise FloatingPointError("no state explains a row")
    return v / total


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products over the first two axes."""
    out = a[:, 0, None] * b[0, None]
    for k in range(1, len(b)):
        out += a[:, k, None] * b[k, None]
    return out


def _alphas(first: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """Filtered probabilities of n rows (models x n x K). The recursion runs along all blocks of all models at once, then over the blocks: about 2 sqrt(n) steps."""
    length, k, _, models, blocks = m.shape
    products = np.empty_like(m)
    products[0] = _normalised(m[0], (0, 1))
    for j in range(1, length):
        products[j] = _normalised(_product(products[j - 1], m[j]), (0, 1))
    entry = np.empty((k, models, blocks))
    entry[:, :, 0] = first.T
    last = np.ascontiguousarray(products[-1].transpose(3, 0, 1, 2))
    for b in range(1, blocks):
        entry[:, :, b] = _normalised((entry[:, None, :, b - 1] * last[b - 1]).sum(axis=0), (0,))
    rest = sum(entry[i] * products[:, i] for i in range(k))
    rest = _normalised(rest, (1,)).transpose(2, 3, 0, 1).reshape(models, -1, k)
    return np.concatenate([first[:, None], rest[:, : n - 1]], axis=1)


def _betas(m: np.ndarray, n: int) -> np.ndarray:
    """What the rows after each row say about its state, up to a factor for each row."""
    length, k, _, models, blocks = m.shape
    products = np.empty_like(m)
    products[-1] = _normalised(m[-1], (0, 1))
    for j in range(length - 2, -1, -1):
        products[j] = _normalised(_product(m[j], products[j + 1]), (0, 1))
    after = np.empty((k, models, blocks))
    after[:, :, -1] = 1
    whole = np.ascontiguousarray(products[0].transpose(3, 0, 1, 2))
    for b in range(blocks - 2, -1, -1):
        after[:, :, b] = _normalised((whole[b + 1] * after[None, :, :, b + 1]).sum(axis=1), (0,))
    rest = sum(after[i] * products[:, :, i] for i in range(k))
    rest = _normalised(rest, (1,)).transpose(2, 3, 0, 1).reshape(models, -1, k)
    return np.concatenate([rest[:, : n - 1], np.ones((models, 1, k))], axis=1)


def forward(log_e: np.ndarray, start: np.ndarray, transition: np.ndarray, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Causal filter: probabilities of each row given the rows up to it, and each row's log-likelihood increment.

    The first row's prior is start or, when alpha continues an earlier filter, alpha times the transition matrix.
    """
    n = len(log_e)
    if not n:
        return np.empty_like(log_e), np.empty(0)
    top = log_e.max(axis=1)
    e = np.exp(log_e - top[:, None])
    prior = start if alpha is None else alpha @ transition
    out = _alphas(_normalised(prior * e[0], (0,))[None], _steps(e[None], transition[None])[1], n)[0]
    expected = np.vstack([prior[None], out[:-1] @ transition])
    return out, top + np.log((expected * e).sum(axis=1))


def expectations(log_e: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several models of one number of states over one series (models x n x K): smoothed state probabilities, summed transition counts, log-likelihoods."""
    models, n, k = log_e.shape
    top = log_e.max(axis=2)
    e = np.exp(log_e - top[:, :, None])
    rows, m = _steps(e, transition)
    alpha, beta = _alphas(_normalised(start * e[:, 0], (1,)), m, n), _betas(m, n)
    expected = np.concatenate([start[:, None], alpha[:, :-1] @ transition], axis=1)
    ll = (top + np.log((expected * e).sum(axis=2))).sum(axis=1)
    joint = alpha[:, :-1, :, None] * rows * beta[:, 1:, None, :]
    xi = _normalised(joint, (2, 3)).sum(axis=1) if n > 1 else np.zeros((models, k, k))
    return _normalised(alpha * beta, (2,)), xi, ll


def expectation(log_e: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """expectations() of one model (n x K)."""
    gamma, xi, ll = expectations(log_e[None], start[None], transition[None])
    return gamma[0], xi[0], float(ll[0])


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows far from each other, chosen with probability of their squared distance."""
    chosen = [x[rng.integers(len(x))]]
    while len(chosen) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(chosen)


def _weighted(x: np.ndarray, w: np.ndarray, u: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and covariance; u are extra weights of the scatter (Student-t)."""
    v = w if u is None else w * u
    mean = v @ x / max(v.sum(), 1e-12)
    z = x - mean
    return mean, (z * v[:, None]).T @ z / max(w.sum(), 1e-12) + MIN_COVARIANCE * np.eye(x.shape[1])


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def update_nu(weights: np.ndarray, u: np.ndarray, nu: float, d: int) -> float:
    """Root of the degrees-of-freedom equation, by bisection between NU_LOW and NU_HIGH."""
    constant = 1 + float(weights @ (np.log(u) - u)) / max(weights.sum(), 1e-12) + digamma((nu + d) / 2) - math.log((nu + d) / 2)
    f = lambda v: math.log(v / 2) - digamma(v / 2) + constant
    low, high = NU_LOW, NU_HIGH
    if f(low) <= 0:
        return low
    if f(high) >= 0:
        return high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) > 0 else (low, middle)
    return (low + high) / 2


def _started(x: np.ndarray, states: int, family: str, seed: int) -> HMM:
    n, d = x.shape
    rng = np.random.default_rng(seed)
    base = np.cov(x.T, bias=True).reshape(d, d) + MIN_COVARIANCE * np.eye(d)
    model = HMM(family, np.full(states, 1 / states), np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1)), _spread(x, states, rng), np.repeat(base[None], states, axis=0))
    if states == 1:
        model.transition = np.ones((1, 1))
    if family == MIXTURE:
        model.weights = np.full((states, 2), 0.5)
        model.means = np.stack([model.means + 0.25 * np.sqrt(np.diag(base)), model.means - 0.25 * np.sqrt(np.diag(base))], axis=1)
        model.covariances = np.repeat(model.covariances[:, None], 2, axis=1)
    if family == STUDENT_T:
        model.nu = np.full(states, NU_START)
    return model


def _settled(model: HMM, ll: float, tolerance: float) -> bool:
    """Takes in a round's log-likelihood; true if the fit ends, converged or not."""
    if model.history:
        gain, slack = ll - model.history[-1], 1e-8 * max(1.0, abs(ll))
        fell = gain < -slack - (1e-6 * abs(ll) if model.family == STUDENT_T else 0)
        if fell or gain < tolerance * (max(1.0, abs(ll)) if model.family == STUDENT_T else 1.0):
            model.history.append(ll)
            model.log_likelihood, model.converged = ll, not fell
            return True
    model.history.append(ll)
    return False


def _maximised(model: HMM, x: np.ndarray, log_e: np.ndarray, gamma: np.ndarray, xi: np.ndarray) -> None:
    states, d = model.states, x.shape[1]
    model.start = gamma[0] / gamma[0].sum()
    model.transition = (xi + 1e-12) / (xi + 1e-12).sum(axis=1, keepdims=True)
    if model.family == MIXTURE:
        parts = component_log_densities(x, model)
        share = np.exp(parts - log_e[:, :, None]) * gamma[:, :, None]
        model.weights = share.sum(axis=0) / np.maximum(share.sum(axis=(0, 2))[:, None], 1e-12)
        for k in range(states):
            for c in range(2):
                model.means[k, c], model.covariances[k, c] = _weighted(x, share[:, k, c])
    elif model.family == STUDENT_T:
        for k in range(states):
            q, _ = _form(x, model.means[k], model.covariances[k])
            u = (model.nu[k] + d) / (model.nu[k] + q)
            model.means[k], model.covariances[k] = _weighted(x, gamma[:, k], u)
            model.nu[k] = update_nu(gamma[:, k], u, float(model.nu[k]), d)
    else:
        for k in range(states):
            model.means[k], model.covariances[k] = _weighted(x, gamma[:, k])


def fit_many(x: np.ndarray, states: int, family: str, seeds: list[int], max_rounds: int | None = None, tolerance: float = TOLERANCE) -> list[HMM | Exception]:
    """A model for each seed, or the numerical failure that ended its fit. The recursions of all seeds that haven't settled run as one."""
    n, d = x.shape
    if n < 2 * states or not np.isfinite(x).all():
        raise ValueError("too few rows, or a value is not finite")
    out: list[HMM | Exception] = [_started(x, states, family, s) for s in seeds]
    going = list(range(len(seeds)))
    failures = (np.linalg.LinAlgError, FloatingPointError)

    def attempt(k: int, f) -> object:
        try:
            return f()
        except failures as e:
            out[k] = e
            return None

    for _ in range(max_rounds or (NU_ROUNDS if family == STUDENT_T else MAX_ROUNDS)):
        log_e = {k: e for k in going if (e := attempt(k, lambda k=k: out[k].log_emissions(x))) is not None}
        going = list(log_e)
        if not going:
            break
        try:
            found = expectations(np.stack([log_e[k] for k in going]), np.stack([out[k].start for k in going]), np.stack([out[k].transition for k in going]))
            each = dict(zip(going, zip(*found, strict=True), strict=True))
        except FloatingPointError:  # of one of them: each by itself
            each = {k: r for k in going if (r := attempt(k, lambda k=k: expectation(log_e[k], out[k].start, out[k].transition))) is not None}
        going = [k for k, (_, _, ll) in each.items() if not _settled(out[k], float(ll), tolerance)]
        going = [k for k in going if attempt(k, lambda k=k: (_maximised(out[k], x, log_e[k], *each[k][:2]), True))]
    for k in going:
        out[k].log_likelihood = out[k].history[-1]
    return out


def fit(x: np.ndarray, states: int, family: str = GAUSSIAN, seed: int = 11, max_rounds: int | None = None, tolerance: float = TOLERANCE) -> HMM:
    found = fit_many(x, states, family, [seed], max_rounds, tolerance)[0]
    if isinstance(found, Exception):
        raise found
    return found


def covariance_reason(model: HMM) -> str | None:
    """Why a model's covariances are not acceptable: not finite, not symmetric, a variance too small, or not positive definite."""
    _, covs = model.moments()
    for c in covs:
        if not np.isfinite(c).all():
            return "not_finite"
        if np.abs(c - c.T).max() > 1e-10:
            return "not_symmetric"
        if np.diag(c).min() < 1e-12:
            return "variance_too_small"
        try:
            np.linalg.cholesky(c)
        except np.linalg.LinAlgError:
            return "not_positive_definite"
    return None
