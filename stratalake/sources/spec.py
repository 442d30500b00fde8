"""Stored ELT specifications: reading, and reuse by fingerprint of what they were made for."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from stratalake.plans.gate import PARTS
from stratalake.sources.intake import InputError, read_json


def read_spec(path: str | Path) -> dict:
    """The five parts of a specification file (JSON, fenced or not)."""
    data = read_json(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise InputError(f"{path} must hold an object")
    if gone := [p for p in PARTS if p not in data]:
        raise InputError(f"{path} lacks {', '.join(gone)}")
    return data


def fingerprint(*parts) -> str:
    """SHA-256 over the JSON of what a specification depends on, in whatever order keys were given."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def cached(folder: str | Path, key: str, make: Callable[[], dict]) -> tuple[dict, bool]:
    """(specification, whether it was there) for a fingerprint; ``make`` is asked only if it wasn't."""
    path = Path(folder) / f"spec-{key}.json"
    if path.exists():
        return read_spec(path), True
    data = make()
    path.parent.mkdir(parents=True, exist_ok=True)
    fresh = path.with_suffix(".tmp")
    fresh.write_text(json.dumps(data, indent=2, sort_keys=True), encoding="utf-8")
    fresh.replace(path)
    return data, False


def forget(folder: str | Path, key: str) -> None:
    """Drop a stored specification, as after the gate refused it."""
    (Path(folder) / f"spec-{key}.json").unlink(missing_ok=True)
