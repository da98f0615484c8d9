"""Family PCA: sums in Spark, eigenvectors on the driver, projection as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

MAX_COMPONENTS = 8
RANK_TOLERANCE = 1e-12
ROUNDING = 1e-13


class StatisticallyInvalid(ValueError):
    """The data admit no fit; the caller may go on without it."""


@dataclass(frozen=True)
class PCA:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    def columns(self, prefix: str) -> list[Column]:
        """Component values on complete rows, NULL on others."""
        z = [(F.col(f) - m) / s for f, m, s in zip(self.features, self.mean, self.scale, strict=True)]
        return [sum((z[i] * w[i] for i in range(1, len(z))), z[0] * w[0]).alias(f"{prefix}_{k + 1}") for k, w in enumerate(self.components)]

    def to_dict(self) -> dict:
        return {"features": list(self.features), "mean": list(self.mean), "scale": list(self.scale), "components": [list(c) for c in self.components], "explained": list(self.explained)}

    @staticmethod
    def from_dict(d: dict) -> PCA:
        return PCA(tuple(d["features"]), tuple(d["mean"]), tuple(d["scale"]), tuple(tuple(c) for c in d["components"]), tuple(d["explained"]))

    def loadings(self) -> list[tuple[int, str, float, float, float]]:
        """(ordinal, feature, loading, squared loading, explained variance)."""
        return [(k + 1, f, w, w * w, self.explained[k]) for k, c in enumerate(self.components) for f, w in zip(self.features, c, strict=True)]


def moments(panel: DataFrame, families: dict[str, list[str]]) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Of each family: count, means and centred cross products of its complete rows, all in one pass of matrix products in the tasks."""
    names = list(families)
    features = list(dict.fromkeys(f for fs in families.values() for f in fs))
    at = {f: k for k, f in enumerate(features)}
    places = [np.array([at[f] for f in families[n]]) for n in names]

    def partial(labels: np.ndarray, x: np.ndarray, wanted: Iterable[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        for tile in wanted:
            own = x[:, places[tile]]
            own = own[np.isfinite(own).all(axis=1)]
            yield tile, 0, np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])

    def final(tile: int, parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        yield tile, sum(s for _, s in parts).tobytes()

    sums, shift = blocks.summed(blocks.packed(panel, features), F.lit(0), len(features), len(names), partial, final, ["tile", "sums"], [pa.int32(), pa.binary()], "tile int, sums binary")
    rows = sums.collect()
    out = {n: (0, np.zeros(len(fs)), np.zeros((len(fs), len(fs)))) for n, fs in families.items()}
    for r in rows:
        s, d = np.frombuffer(r["sums"]), len(places[r["tile"]])
        n = int(s[0])
        if n:
            mean, raw = s[1 : 1 + d] / n, s[1 + d :].reshape(d, d)
            cross = raw - n * np.outer(mean, mean)
            constant = np.diag(cross) <= ROUNDING * np.diag(raw)  # zero but for rounding
            cross[constant] = cross[:, constant] = 0.0
            out[names[r["tile"]]] = n, mean + shift[places[r["tile"]]], cross
    return out


def signed(components: np.ndarray, names: tuple[str, ...] | None = None) -> np.ndarray:
    """Each component turned so that its entry of largest size is positive; of equal ones the first by name, or by position."""
    order = np.argsort(names, kind="stable") if names else np.arange(components.shape[1])
    out = components.copy()
    for k, row in enumerate(components):
        size = np.round(np.abs(row[order]), 12)
        out[k] = row if row[order[int(np.argmax(size))]] >= 0 else -row
    return out


def fit(panel: DataFrame, features: list[str], variance: float | None = None, count: int | None = None) -> PCA:
    """Principal components of standardised features (population variance) over complete rows.

    Keeps min(rank, MAX_COMPONENTS) components, or count of them, or as few as explain the given share of variance.
    """
    found = fit_families(panel, {"": features}, variance, count)[""]
    if isinstance(found, StatisticallyInvalid):
        raise found
    return found


def fit_families(panel: DataFrame, families: dict[str, list[str]], variance: float | None = None, count: int | None = None, strict: bool = False) -> dict[str, PCA | StatisticallyInvalid]:
    """fit() of every family, from one pass over the panel. A family that admits no fit has the reason in its place, or, if strict, stops the query."""
    out: dict[str, PCA | StatisticallyInvalid] = {}
    for name, sums in moments(panel, families).items():
        try:
            out[name] = _fitted(families[name], *sums, variance, count)
        except StatisticallyInvalid as e:
            if strict:
                raise StatisticallyInvalid(f"{name}: {e}") from e
            out[name] = e
    return out


def _fitted(features: list[str], n: int, mean: np.ndarray, cross: np.ndarray, variance: float | None, count: int | None) -> PCA:
    if n < 2:
        raise StatisticallyInvalid(f"{n} complete rows")
    scale = np.sqrt(np.diag(cross) / n)
    if (scale <= 0).any():
        raise StatisticallyInvalid("a feature is constant")
    values, vectors = np.linalg.eigh(cross / n / np.outer(scale, scale))
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1].T
    singular = np.sqrt(values * n)
    # Roots of eigenvalues carry the root of the rounding error, so the rank test is on eigenvalues.
    rank = int((values > values[0] * max(n, len(features)) * max(RANK_TOLERANCE, np.finfo(float).eps)).sum()) if singular[0] > 0 else 0
    share = values / values.sum()
    if count is not None:
        keep = count
    elif variance is not None:
        keep = int(np.searchsorted(np.cumsum(share), variance - 1e-12)) + 1
    else:
        keep = min(rank, MAX_COMPONENTS)
    if not 0 < keep <= rank:
        raise StatisticallyInvalid(f"{keep} components of rank {rank}")
    components = signed(vectors[:keep], tuple(features))
    return PCA(tuple(features), tuple(map(float, mean)), tuple(map(float, scale)), tuple(tuple(map(float, c)) for c in components), tuple(map(float, share[:keep])))


def transform(panel: DataFrame, pca: PCA, prefix: str, keep: list[str]) -> DataFrame:
    return panel.select(*keep, *pca.columns(prefix))
