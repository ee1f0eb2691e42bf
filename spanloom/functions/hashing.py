"""Short hashes of specs and folders."""

from __future__ import annotations

from hashlib import sha256


def short_hash(text: str, digits: int = 12) -> str:
    return sha256(text.encode()).hexdigest()[:digits]


def tree_digest(files: dict[str, bytes], digits: int = 16) -> str:
    """A folder's hash over its sorted paths and bytes."""
    h = sha256()
    for path in sorted(files):
        h.update(path.encode() + b"\0" + files[path])
    return h.hexdigest()[:digits]
