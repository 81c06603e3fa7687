"""Driver-side checks and small documents: requests, settings, schemas, fingerprints of files."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
from pathlib import Path
from urllib.parse import urlsplit

from brindle.operators.labeling import fingerprint


def request_faults(url: str, counts: dict[str, float], delay: float = 0.0) -> list[str]:
    """Faults of a run's parameters: an HTTP(S) address with a host, counts of at least 1, a finite delay from 0."""
    parsed = urlsplit(url)
    faults = [] if parsed.scheme in ("http", "https") and parsed.hostname else ["address"]
    faults += [name for name, value in counts.items() if value < 1]
    return faults + ([] if math.isfinite(delay) and delay >= 0 else ["delay"])


def selection_faults(dataset: str, run: str, reason: str, limit: int, rate: float) -> list[str]:
    faults = [name for name, value in (("dataset", dataset), ("selection_run", run), ("reason", reason)) if not value.strip()]
    return faults + (["limit"] if limit < 1 else []) + ([] if 0 < rate <= 1 else ["sample_rate"])


def setting(flag: str | None, environment: dict[str, str], name: str, owner: bool, default: str | None) -> str | None:
    """A flag wins, then the environment (only for the provider that it belongs to), then the default."""
    return flag or (environment.get(name) if owner else None) or default


def without_references(schema: dict) -> dict:
    """A JSON schema with each local `$ref` replaced by what it names; schemas without recursion only."""
    named = schema.get("$defs", {})

    def walk(node):
        if isinstance(node, list):
            return [walk(x) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            return walk(named[node["$ref"].rsplit("/", 1)[-1]] | {k: v for k, v in node.items() if k != "$ref"})
        return {k: walk(v) for k, v in node.items() if k != "$defs"}

    return walk(schema)


def release_id(mapping: str, policy: str, features: list[tuple[str, str, str]]) -> str:
    """Identity of a release: mapping, geometry policy, and (dataset, id, fingerprint) of its features; time is left out."""
    return fingerprint({"mapping": mapping, "geometry_policy": policy, "features": sorted(features)})


def files_fingerprint(folder: str, settings: dict, block: int = 1 << 20) -> str:
    """Identity of a model: its settings, and names and bytes of its files."""
    total = hashlib.sha256(fingerprint(settings).encode())
    for path in sorted(p for p in Path(folder).rglob("*") if p.is_file()):
        total.update(str(path.relative_to(folder)).encode())
        with path.open("rb") as f:
            while part := f.read(block):
                total.update(part)
    return total.hexdigest()


def drift(expected: dict, found: dict) -> list[str]:
    """Keys (file digests, split memberships) whose recorded and present values differ."""
    return sorted(k for k in expected.keys() | found.keys() if expected.get(k) != found.get(k))


def instant(text: str, required: bool = True) -> float | None:
    """Seconds since 1970 of an ISO time with a zone (`Z` or an offset); a naive time is refused, or null if not required."""
    parsed = dt.datetime.fromisoformat(text)
    if parsed.tzinfo is None:
        if required:
            raise ValueError(f"{text} has no time zone")
        return None
    return parsed.timestamp()
