"""Model packages and their registry: small JSON documents, changed on the driver under a lock."""

from __future__ import annotations

import hashlib
import json
import os
import time
from contextlib import contextmanager
from pathlib import Path

from ..models.hmm import HMM

SCHEMA_VERSION = 2
#: A write under the registry's lock takes milliseconds; a cycle, hours.
STALE_LOCK_S, STALE_CYCLE_S = 60.0, 24 * 3600.0


class AliasChanged(RuntimeError):
    """Another writer moved the alias first."""


def _hex(value):
    """Floats as hexadecimal text, exactly."""
    if isinstance(value, float):
        return {"x": value.hex()}
    if isinstance(value, list):
        return [_hex(v) for v in value]
    if isinstance(value, dict):
        return {k: _hex(v) for k, v in value.items()}
    return value


def _unhex(value):
    if isinstance(value, dict):
        return float.fromhex(value["x"]) if set(value) == {"x"} and isinstance(value["x"], str) else {k: _unhex(v) for k, v in value.items()}
    return [_unhex(v) for v in value] if isinstance(value, list) else value


def package(model: HMM, features: list[str], scaler: dict[str, tuple[float, float]], trained_through: str, alpha: list[float], lineage: dict, pca: dict | None = None) -> dict:
    """pca: the projections behind features that are components, by family."""
    body = {"schema": SCHEMA_VERSION, "pca": pca or {}, "model": model.to_dict(), "features": features, "scaler": {k: list(map(float, v)) for k, v in scaler.items()}, "trained_through": trained_through, "alpha": list(map(float, alpha)), "lineage": lineage}
    text = json.dumps(_hex(body), sort_keys=True, separators=(",", ":"))
    return body | {"package_hash": hashlib.sha256(text.encode()).hexdigest()}


def read_package(path: Path) -> dict:
    """A package file, if its content has its hash."""
    pack = _unhex(json.loads(path.read_text()))
    body = {k: v for k, v in pack.items() if k != "package_hash"}
    if hashlib.sha256(json.dumps(_hex(body), sort_keys=True, separators=(",", ":")).encode()).hexdigest() != pack.get("package_hash"):
        raise ValueError("a package doesn't have its hash")
    return pack


@contextmanager
def locked(lock: Path, wait_s: float = 0.0, stale_s: float = STALE_CYCLE_S):
    """A file that one process holds. One that a crash left is taken over once it is stale_s old, since its holder renews nothing for so long."""
    until = time.monotonic() + wait_s
    while True:
        try:
            handle = os.open(lock, os.O_CREAT | os.O_EXCL)
            break
        except FileExistsError:
            try:
                if time.time() - lock.stat().st_mtime > stale_s:
                    os.replace(lock, lock.with_suffix(f".stale-{os.getpid()}"))  # of two that see it, one moves it
                    continue
            except FileNotFoundError:
                continue
            if time.monotonic() >= until:
                raise TimeoutError(f"{lock.name} is held by another process") from None
            time.sleep(0.02)
    try:
        yield
    finally:
        os.close(handle)
        lock.unlink(missing_ok=True)


class Registry:
    """models/<name>/<version>.json, aliases.json and an append-only audit below one folder."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    @contextmanager
    def _locked(self, wait_s: float = 10):
        with locked(self.root / ".lock", wait_s, STALE_LOCK_S):
            yield

    def _put(self, path: Path, data) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_text(json.dumps(data, sort_keys=True))
        os.replace(part, path)

    def _aliases(self) -> dict:
        path = self.root / "aliases.json"
        return json.loads(path.read_text()) if path.exists() else {}

    def versions(self, name: str) -> list[int]:
        return sorted(int(p.stem) for p in (self.root / "models" / name).glob("*.json"))

    def register(self, name: str, pack: dict) -> int:
        """A new version, or the old one's number if this content is registered already."""
        with self._locked():
            for v in self.versions(name):
                if json.loads((self.root / "models" / name / f"{v}.json").read_text())["package_hash"] == pack["package_hash"]:
                    return v
            version = (self.versions(name) or [0])[-1] + 1
            self._put(self.root / "models" / name / f"{version}.json", _hex(pack))
            return version

    def load(self, name: str, version: int) -> dict:
        return read_package(self.root / "models" / name / f"{version}.json")

    def publish(self, name: str, path: str | Path) -> int:
        """Registers a package file that another registry, or a build, has written; its hash is checked first."""
        return self.register(name, read_package(Path(path)))

    def resolve(self, name: str, alias: str) -> int | None:
        return self._aliases().get(f"{name}@{alias}")

    def move_alias(self, name: str, alias: str, expected: int | None, version: int, actor: str) -> None:
        """Compare and swap, with an audit entry."""
        with self._locked():
            aliases = self._aliases()
            if aliases.get(f"{name}@{alias}") != expected:
                raise AliasChanged(f"{name}@{alias} is {aliases.get(f'{name}@{alias}')}, not {expected}")
            if version not in self.versions(name):
                raise KeyError(f"{name} has no version {version}")
            self._put(self.root / "aliases.json", aliases | {f"{name}@{alias}": version})
            with (self.root / "audit.jsonl").open("a") as f:
                f.write(json.dumps({"name": name, "alias": alias, "from": expected, "to": version, "actor": actor, "at": time.time()}) + "\n")

    def rollback(self, name: str, alias: str, actor: str) -> int:
        """Moves the alias back to where it was before its last move."""
        moves = [a for a in self.audit() if (a["name"], a["alias"]) == (name, alias)]
        if not moves or moves[-1]["from"] is None:
            raise KeyError(f"{name}@{alias} has no earlier version")
        self.move_alias(name, alias, moves[-1]["to"], moves[-1]["from"], actor)
        return moves[-1]["from"]

    def audit(self) -> list[dict]:
        path = self.root / "audit.jsonl"
        return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []
