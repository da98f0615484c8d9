"""Feature clusters: average linkage over a distance matrix, the cut of best silhouette, medoids and winners.

The matrix is a fold's decision data (features x features, after pruning), so this runs on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TOLERANCE = 1e-12


@dataclass(frozen=True)
class Clusters:
    labels: tuple[int, ...]
    silhouette: float
    medoids: tuple[int, ...]


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (smaller id, larger id, height); a merged cluster takes the smaller id. Of equal distances the smallest ids merge."""
    n = len(distance)
    d, size, alive = distance.astype(float).copy(), np.ones(n), list(range(n))
    out = []
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)].copy()
        sub[np.tril_indices(len(alive))] = np.inf
        i, j = np.unravel_index(int(np.argmin(np.round(sub, 12))), sub.shape)
        a, b = alive[i], alive[j]
        out.append((a, b, float(d[a, b])))
        for c in alive:
            d[a, c] = d[c, a] = (size[a] * d[a, c] + size[b] * d[b, c]) / (size[a] + size[b])
        size[a] += size[b]
        alive.remove(b)
    return out


def cut(n: int, merges: list[tuple[int, int, float]], clusters: int) -> np.ndarray:
    label = np.arange(n)
    for a, b, _ in merges[: n - clusters]:
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]


def silhouette(distance: np.ndarray, label: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b); a singleton counts 0."""
    values = []
    for i, own in enumerate(label):
        same = label == own
        same[i] = False
        if not same.any():
            values.append(0.0)
            continue
        a = distance[i, same].mean()
        b = min(distance[i, label == c].mean() for c in set(label) - {own})
        values.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(values))


def medoids(distance: np.ndarray, label: np.ndarray) -> tuple[int, ...]:
    """Of each cluster the member of least total distance, the first of equal ones."""
    out = []
    for c in range(label.max() + 1):
        members = np.flatnonzero(label == c)
        totals = np.round(distance[np.ix_(members, members)].sum(axis=1), 12)
        out.append(int(members[int(np.argmin(totals))]))
    return tuple(out)


def best_cut(distance: np.ndarray, low: int = 2, high: int | None = None) -> Clusters:
    """The number of clusters of best silhouette, the smallest of those within tolerance of it."""
    n, merges = len(distance), average_linkage(distance)
    options = [(silhouette(distance, lab := cut(n, merges, m)), m, lab) for m in range(low, min(high or n - 1, n - 1) + 1)]
    top = max(o[0] for o in options)
    score, _, label = next(o for o in options if o[0] >= top - TOLERANCE)
    return Clusters(tuple(map(int, label)), score, medoids(distance, label))


def winners(label: tuple[int, ...], names: list[str], scores: dict[str, float | None]) -> dict[int, str]:
    """Each cluster's member of best score, the first name of equal ones; a cluster without a scored member has none."""
    out: dict[int, str] = {}
    for name, c in sorted(zip(names, label, strict=True)):
        if scores.get(name) is not None and (c not in out or scores[name] > scores[out[c]] + TOLERANCE):
            out[c] = name
    return out
