"""Canonical JSON and BLAKE2b identities."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path


def canonical_json(value: object) -> str:
    """Sorted keys, ASCII, no blanks; paths as text; anything else unknown is a TypeError."""
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"), default=_plain)


def _plain(value: object):
    if isinstance(value, Path):
        return str(value)
    raise TypeError(f"no canonical form for {type(value).__name__}")


def digest(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=16).hexdigest()


def hash_obj(value: object) -> str:
    return digest(canonical_json(value).encode())


def hash_file(path: str | Path, block: int = 1 << 20) -> str:
    h = hashlib.blake2b(digest_size=16)
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def hash_flow_ids(ids: Iterable[int]) -> str:
    return hash_obj(sorted(int(i) for i in ids))


def manifest_hash(parts: dict[str, object]) -> str:
    """Hash of the map of the parts' own hashes, so that a changed part can be named."""
    return hash_obj({name: hash_obj(part) for name, part in parts.items()})


def short_hash(value: object, n: int = 8) -> str:
    """First digits of a value's hash; a text is hashed as its UTF-8 bytes."""
    return (digest(value.encode()) if isinstance(value, str) else hash_obj(value))[:n]


def seed_of(dataset_hash: str, sample_seed: int, mode: str) -> int:
    """64-bit seed of a sample from what makes it reproducible."""
    return int(hash_obj({"dataset_hash": dataset_hash, "sample_seed": sample_seed, "mode": mode})[:16], 16)


def run_id(moment: datetime, mode: str, ablation: str, providers: Iterable[str], dataset_hash: str, suffix: str | None = None) -> str:
    """Name of a run; names order by time. The suffix keeps runs of one second apart."""
    stamp = moment.astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")
    return "_".join([stamp, mode, ablation, "+".join(sorted(providers)), dataset_hash[:8], suffix or uuid.uuid4().hex[:6]])


def prompts_hash(scaffold: str, common: str, personas: dict[str, str]) -> str:
    """Hash of the prompt texts that every ablation shares."""
    return hash_obj({"system_scaffold": scaffold, "playbook_common": common, "personas": personas})


def playbooks_hash(playbooks: dict[str, str], ablation: str = "main") -> str:
    """Hash of the playbooks in use: none under playbooks_off."""
    return hash_obj({"playbooks": playbooks if ablation != "playbooks_off" else {}})
