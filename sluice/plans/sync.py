"""Keeping a device's or mirror's artifacts up to date: what to fetch, verify and apply."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

HOUR_MS = 3_600_000
#: A full update at most once a week unless forced.
FULL_EVERY_MS = 7 * 24 * HOUR_MS


@dataclass
class Local:
    """What is installed: version, whether it was installed to its end, when, and the chunks by file."""

    version: str | None = None
    complete: bool = False
    at_ms: int | None = None
    chunks: dict[str, str] = field(default_factory=dict)
    model_version: str | None = None


def sync_state(local: Local, published: dict, now_ms: int, force: bool = False) -> str:
    """up-to-date, throttled or update.  An update that did not come to its end is taken up again whatever its age."""
    if local.version == published["version"] and local.complete:
        return "up-to-date"
    if force or local.at_ms is None or not local.complete or now_ms - local.at_ms >= FULL_EVERY_MS:
        return "update"
    return "throttled"


class Mismatch(ValueError):
    """A body that is not what its description says."""


def verified(body: bytes, sha256: str, size: int | None = None) -> bytes:
    if (size is not None and len(body) != size) or hashlib.sha256(body).hexdigest() != sha256:
        raise Mismatch(f"{len(body)} bytes")
    return body


def chunk_update(local: Local, published: list[dict], get: Callable[[str], bytes]) -> tuple[dict[str, bytes], list[str]]:
    """(bodies to install, files to remove).  All changed chunks are fetched and verified before anything is applied."""
    changed = {c["file"]: verified(get(c["file"]), c["sha256"]) for c in published if local.chunks.get(c["file"]) != c["sha256"]}
    return changed, sorted(set(local.chunks) - {c["file"] for c in published})


def apply_chunks(local: Local, published: list[dict], get: Callable[[str], bytes], install: Callable[[str, bytes], None], remove: Callable[[str], None]) -> Local:
    """`local` after the update; on a mismatch nothing was installed."""
    bodies, stale = chunk_update(local, published, get)
    for file, body in bodies.items():
        install(file, body)
    for file in stale:
        remove(file)
    return Local(local.version, local.complete, local.at_ms, {c["file"]: c["sha256"] for c in published}, local.model_version)


def model_update(local: Local, published: dict | None, get: Callable[[str], bytes]) -> dict[str, bytes] | None:
    """Bodies of a model of another version, or None.  Trees that do not verify are left out: the text model works alone."""
    if not published or published["version"] == local.model_version:
        return None
    out = {"weights": verified(get(published["file"]), published["sha256"], published.get("size"))}
    trees = published.get("trees")
    if trees:
        try:
            out["trees"] = verified(get(trees["file"]), trees["sha256"], trees.get("size"))
        except Mismatch:
            pass
    return out


def current_no_pin(synced: list[str], bundled: list[str], extra: list[str]) -> list[str]:
    """Hosts that are never pinned: the synced list, or the bundled one if that is empty, and a policy's own."""
    return sorted(set(synced or bundled) | set(extra))
