"""State identity across fits."""

from __future__ import annotations

from itertools import permutations

import numpy as np

from .hmm import HMM

AMBIGUITY = 1e-10


class AmbiguousAlignment(ValueError):
    """Two permutations fit equally well."""


def signature(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Mean, log standard deviations, and correlations above the diagonal."""
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    return np.concatenate([mean, np.log(sd), corr[np.triu_indices(len(mean), 1)]])


def in_coordinates(mean: np.ndarray, cov: np.ndarray, own: tuple[np.ndarray, np.ndarray], target: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An emission of one scaler's coordinates in another's. Scalers are (mean, scale)."""
    ratio = own[1] / target[1]
    return (mean * own[1] + own[0] - target[0]) / target[1], cov * np.outer(ratio, ratio)


def signatures(model: HMM) -> list[np.ndarray]:
    return [signature(m, c) for m, c in zip(*model.moments(), strict=True)]


def first_order(model: HMM) -> list[int]:
    """States by signature rounded to ten decimals; equal signatures are ambiguous."""
    keys = [tuple(np.round(s, 10) + 0.0) for s in signatures(model)]
    if len(set(keys)) < len(keys):
        raise AmbiguousAlignment("two states have one signature")
    return sorted(range(len(keys)), key=lambda k: keys[k])


def rms(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(np.mean((a - b) ** 2)))


def to_reference(model: HMM, reference: list[np.ndarray]) -> list[int]:
    """The permutation of least total RMS distance to the reference's signatures. There are at most 120 (5 states)."""
    own = signatures(model)
    distance = np.array([[rms(a, b) for b in reference] for a in own])
    ranked = sorted((sum(distance[p[k], k] for k in range(len(own))), p) for p in permutations(range(len(own))))
    if len(ranked) > 1 and ranked[1][0] - ranked[0][0] <= AMBIGUITY:
        raise AmbiguousAlignment("two permutations are equally near")
    return list(ranked[0][1])
