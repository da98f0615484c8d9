"""Profiles and requests: mappings read strictly, so that a misspelt key is an error and not a default."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import re
from pathlib import Path
from typing import Any

_UTC = re.compile(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z$")


class InvalidInput(ValueError):
    """What the caller sent can't be understood."""


@dataclasses.dataclass(frozen=True)
class Profile:
    profile_id: str
    core: tuple[str, ...]
    families: tuple[str, ...]
    min_train: int = 1260
    zone: str = "Europe/Berlin"
    state_counts: tuple[int, ...] = (2, 3, 4, 5)
    model_families: tuple[str, ...] = ("gaussian", "gmm", "student_t")
    seeds: tuple[int, ...] = (11, 23, 37, 53, 71, 89, 107, 131)
    max_features: int = 10

    def __post_init__(self) -> None:
        if not self.profile_id.strip() or self.min_train < 2 or self.max_features < 2 or not self.state_counts or min(self.state_counts) < 1:
            raise InvalidInput("a profile needs a name, min_train and max_features of 2 at least, and state counts")


def strict(kind: type, data: Any) -> Any:
    """kind from a mapping that has all its required fields and no others; lists become tuples."""
    if not isinstance(data, dict):
        raise InvalidInput(f"{kind.__name__}: a mapping is needed")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    unknown = sorted(set(data) - set(fields))
    missing = sorted(n for n, f in fields.items() if n not in data and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING)
    if unknown or missing:
        raise InvalidInput(f"{kind.__name__}: unknown {unknown}, missing {missing}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def load_profile(path: str) -> Profile:
    """From JSON, or YAML where a YAML reader is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise InvalidInput("no YAML reader is installed; write the profile as JSON") from e
        return strict(Profile, yaml.safe_load(text))
    return strict(Profile, json.loads(text))


def parse_utc(text: str) -> dt.datetime:
    if not isinstance(text, str) or not _UTC.match(text):
        raise InvalidInput("times are RFC 3339 in UTC, with Z")
    return dt.datetime.fromisoformat(text)


@dataclasses.dataclass(frozen=True)
class Invocation:
    operation: str
    as_of: str | None = None
    start: str | None = None
    end: str | None = None
    model_version: int | None = None

    def __post_init__(self) -> None:
        times = {"latest": ("as_of",), "replay": ("start", "end")}.get(self.operation)
        if times is None:
            raise InvalidInput(f"unknown operation {self.operation}")
        for name in ("as_of", "start", "end"):
            if (getattr(self, name) is not None) != (name in times):
                raise InvalidInput(f"{self.operation} takes {', '.join(times)}")
        if self.operation == "replay" and parse_utc(self.start) > parse_utc(self.end):
            raise InvalidInput("start is after end")


def parse_invocation(body: str) -> Invocation:
    try:
        data = json.loads(body)
    except ValueError as e:
        raise InvalidInput("not JSON") from e
    return strict(Invocation, data)


#: Kinds of failure by the status a caller of a service over this API would send.
STATUS = {"InvalidInput": 400, "ContractError": 422, "KeyError": 404, "LimitExceeded": 413, "Busy": 503, "Stale": 503, "TimeoutError": 504, "CorruptBuild": 500}


def status_of(error: Exception) -> int:
    return next((STATUS[t.__name__] for t in type(error).__mro__ if t.__name__ in STATUS), 500)
