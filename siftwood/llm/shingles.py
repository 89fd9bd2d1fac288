"""Word shingles as sets of 64-bit hashes, and what is taken from such sets."""

from __future__ import annotations

import numpy as np

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S = [np.uint64(x) for x in (29, 32, 31)]
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: The digest of an empty set.
EMPTY = b""


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S[0])) * _MIX[0]
    h = (h ^ (h >> _S[1])) * _MIX[1]
    return h ^ (h >> _S[2])


def shingles(text: str | None, width: int = 4) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest as number

    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    ids = np.array([number(w) for w in words], np.uint64)
    width = min(width, len(ids))
    h = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        h = _finish(h * _C[k % 4] + ids[k : len(ids) - width + 1 + k])
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def digest(hashes: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes()) if len(hashes) else EMPTY


def min_hashes(hashes: np.ndarray) -> list[int]:
    """Three independent min-hashes, as signed longs."""
    return [int(_finish(hashes * c).min().view(np.int64)) for c in _C[:3]] if len(hashes) else [0, 0, 0]
