"""Sets of word shingles as 64-bit hashes, and their MinHash signatures, on Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import mix, rows_of, words

_U = np.uint64


def multipliers(k: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, end to end, and the offsets of the texts in them.

    Words are runs of bytes other than white space, A-Z lower-cased; a text with fewer than `width` words has
    its whole sequence as one shingle, one without words none.
    """
    starts, _, hashes = words(data, offsets)
    row = rows_of(starts, offsets)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    place = np.arange(len(row)) - first[row]
    lead = place < np.maximum(1, counts[row] - width + 1)  # words that begin a shingle
    at = np.flatnonzero(lead)
    total = np.minimum(counts[row[at]], width).astype(np.uint64) * _U(0x8CB92BA72F3D8DD7)
    factors = multipliers(width, 17)
    for j in range(width):
        here = j < counts[row[at]]
        total[here] += hashes[at[here] + j] * factors[j]
    values, owner = mix(total), row[at]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[fresh], owner[fresh]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def signatures(values: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """An (n, k) matrix of 32-bit minima; rows of empty sets are 0."""
    n = len(offsets) - 1
    out = np.zeros((n, k), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[full]
        for j, a in enumerate(multipliers(k, 99)):
            hashed = (((values ^ (a >> _U(7))) * a) >> _U(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(hashed, at)
    return out


def set_digest(values: np.ndarray) -> bytes:
    """16 bytes that name a sorted set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
