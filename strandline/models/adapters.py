"""Model families behind one interface, so that a fit doesn't know which it runs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np

from . import hmm


class Adapter(Protocol):
    """A family's estimator. A fit that the data don't admit raises LinAlgError or FloatingPointError, or isn't converged."""

    def fit(self, x: np.ndarray, states: int, seed: int, max_rounds: int | None = None, tolerance: float = hmm.TOLERANCE) -> None: ...

    def extract(self) -> dict: ...

    def reconstruct(self, artifact: dict) -> None: ...

    def causal_filter(self, x: np.ndarray, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]: ...


class HMMAdapter:
    def __init__(self, family: str, model: hmm.HMM | None = None) -> None:
        self.family, self.model = family, model

    def fit_many(self, x: np.ndarray, states: int, seeds: list[int], max_rounds: int | None = None, tolerance: float = hmm.TOLERANCE) -> list[HMMAdapter | Exception]:
        """An adapter for each seed, or its failure. A family without this method is fitted seed by seed."""
        found = hmm.fit_many(x, states, self.family, seeds, max_rounds, tolerance)
        return [m if isinstance(m, Exception) else HMMAdapter(self.family, m) for m in found]

    def fit(self, x: np.ndarray, states: int, seed: int, max_rounds: int | None = None, tolerance: float = hmm.TOLERANCE) -> None:
        self.model = hmm.fit(x, states, self.family, seed, max_rounds, tolerance)

    @property
    def converged(self) -> bool:
        return self.model is not None and self.model.converged

    @property
    def log_likelihood(self) -> float:
        return self.model.log_likelihood

    def extract(self) -> dict:
        return self.model.to_dict()

    def reconstruct(self, artifact: dict) -> None:
        if artifact["family"] != self.family:
            raise ValueError(f"a model of the family {artifact['family']}, not {self.family}")
        self.model = hmm.HMM.from_dict(artifact)

    def causal_filter(self, x: np.ndarray, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and log-likelihood increments of rows, from the start or continuing from alpha."""
        return hmm.forward(self.model.log_emissions(x), self.model.start, self.model.transition, alpha)


class Family:
    """A factory that a task can unpickle: it carries the family's name only."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __call__(self) -> HMMAdapter:
        return HMMAdapter(self.name)


FACTORIES: dict[str, Callable[[], Adapter]] = {name: Family(name) for name in hmm.FAMILIES}


def adapter(family: str) -> Adapter:
    if family not in FACTORIES:
        raise ValueError(f"unknown model family {family}")
    return FACTORIES[family]()
