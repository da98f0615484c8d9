"""Latest, replay, OOS and health queries over registered models, as a Python API."""

from __future__ import annotations

import threading
import time as clock
import uuid
from collections import OrderedDict
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FRESHNESS
from ..models.hmm import HMM
from ..operators import filtering
from ..operators.pca import PCA
from ..sources import predictions
from ..sources.registry import Registry
from .refit import model_rows


class Busy(RuntimeError):
    """Another replay runs."""


class Stale(RuntimeError):
    """The default model's data are too old to answer."""


class DeadlineExceeded(TimeoutError):
    """The replay took longer than it may; its jobs are cancelled."""


def scaled_rows(panel: DataFrame, pack: dict, time: str = "ts") -> DataFrame:
    """The model's features, two stages: components of the package's projections, then its scaler."""
    rows = model_rows(panel, pack["features"], {n: PCA.from_dict(p) for n, p in pack.get("pca", {}).items()}, time)
    return rows.select(time, *[((F.col(f) - m) / s).alias(f) for f, (m, s) in pack["scaler"].items()])


class Engine:
    """Resolves a model by alias (remembered for ttl_s, VERSIONS packages held) and answers over a panel."""

    VERSIONS = 2

    def __init__(self, registry: Registry, panel: DataFrame, time: str = "ts", ttl_s: float = 30, limits: filtering.ReplayLimits = filtering.ReplayLimits(), deadline_s: float = 60) -> None:
        self.registry, self.panel, self.time, self.ttl_s, self.limits, self.deadline_s = registry, panel, time, ttl_s, limits, deadline_s
        self._held: dict = {}  # (name, version) -> requests that use it: such a package isn't evicted
        self._aliases: dict = {}
        self._packs: OrderedDict = OrderedDict()
        self._admission = threading.Semaphore(1)

    def _pack(self, name: str, alias: str) -> dict:
        at, version = self._aliases.get((name, alias), (-1e9, None))
        if clock.monotonic() - at > self.ttl_s:
            version = self.registry.resolve(name, alias)
            self._aliases[name, alias] = clock.monotonic(), version
        if version is None:
            raise KeyError(f"{name}@{alias}")
        if (name, version) not in self._packs:
            self._packs[name, version] = self.registry.load(name, version)
            for old in [k for k in self._packs if not self._held.get(k) and k != (name, version)][: max(0, len(self._packs) - self.VERSIONS)]:
                del self._packs[old]
        self._packs.move_to_end((name, version))
        return self._packs[name, version] | {"version": version}

    @contextmanager
    def _leased(self, name: str, alias: str):
        pack = self._pack(name, alias)
        key = name, pack["version"]
        self._held[key] = self._held.get(key, 0) + 1
        try:
            yield pack
        finally:
            self._held[key] -= 1

    def latest(self, name: str, as_of: object, alias: str = "champion", refuse_stale: bool = False) -> dict:
        pack = self._pack(name, alias)
        through = type(as_of).fromisoformat(pack["trained_through"])
        model, stored = HMM.from_dict(pack["model"]), as_of >= through
        found = filtering.latest(scaled_rows(self.panel, pack, self.time), model, pack["features"], as_of, self.time, through if stored else None, pack["alpha"] if stored else None).first()
        if found is None:
            raise ValueError("no complete row up to as_of")
        days = (as_of - found["time"]).days
        state = "failed" if days > FRESHNESS["data_fail"] else "degraded" if days > FRESHNESS["data_warn"] else "fresh"
        if refuse_stale and state == "failed":
            raise Stale(f"{days} days")
        p = np.array(found["p"])
        return {"version": pack["version"], "as_of": as_of, "time": found["time"], "p": p.tolist(), "dominant_state": f"state_{int(p.argmax())}", "confidence": float(p.max()), "entropy": float(-(p[p > 0] * np.log(p[p > 0])).sum()), "warmup": found["warmup"], "staleness_days": days, "freshness": state}

    @contextmanager
    def _admitted(self):
        if not self._admission.acquire(blocking=False):
            raise Busy
        try:
            yield
        finally:
            self._admission.release()

    def replay(self, name: str, start: object, end: object, alias: str = "champion") -> DataFrame:
        """One replay at a time, admitted until its rows (bounded by the limits) are here; after deadline_s its jobs are cancelled."""
        spark = self.panel.sparkSession
        with self._admitted(), self._leased(name, alias) as pack:
            model = HMM.from_dict(pack["model"])
            rows = scaled_rows(self.panel, pack, self.time)
            group, late = f"replay-{uuid.uuid4().hex}", threading.Event()
            spark.addTag(group)
            timer = threading.Timer(self.deadline_s, lambda: (late.set(), spark.interruptTag(group)))
            timer.start()
            try:
                filtering.check_replay(rows, start, end, model.states, self.limits, self.time)
                found = filtering.predictions(filtering.replay(rows, model, pack["features"], start, end, self.time), model.states)
                kept = found.collect()
            except Exception as e:
                if late.is_set():
                    raise DeadlineExceeded(f"more than {self.deadline_s} s") from e
                raise
            finally:
                timer.cancel()
                spark.removeTag(group)
            if late.is_set():
                raise DeadlineExceeded(f"more than {self.deadline_s} s")
            return spark.createDataFrame(kept, found.schema)

    def oos_slice(self, root: str, profile: str, build: str, start: object, end: object) -> tuple[dict, DataFrame]:
        manifest, rows = predictions.read(self.panel.sparkSession, root, profile, build)
        return manifest, predictions.oos_slice(rows, start, end)

    def health(self, names: list[str], alias: str = "champion") -> dict:
        found = {n: self.registry.resolve(n, alias) for n in names}
        return {"ready": all(v is not None for v in found.values()), "versions": found}
