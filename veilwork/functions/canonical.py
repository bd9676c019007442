"""Canonical JSON and hashes of records: keys sorted at every level, no blanks, UTF-8 as it is."""

from __future__ import annotations

import hashlib
import json

#: Key names that no record may hold, and the hash before the first record.
FORBIDDEN = frozenset({"__proto__", "constructor", "prototype"})
GENESIS = "0" * 64


def canonical(value) -> str:
    """Raises ValueError for NaN, infinities and forbidden keys."""
    queue = [value]
    while queue:
        v = queue.pop()
        if isinstance(v, dict):
            if bad := FORBIDDEN.intersection(v):
                raise ValueError(f"key {min(bad)!r} is not allowed")
            queue += v.values()
        elif isinstance(v, list | tuple):
            queue += v
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def entry_hash(entry: dict) -> str:
    """Of a record without its own hash."""
    return digest({k: v for k, v in entry.items() if k != "entry_hash"})


def text_hash(text: str) -> str:
    """Empty for an empty text."""
    return hashlib.sha256(text.encode()).hexdigest() if text else ""
