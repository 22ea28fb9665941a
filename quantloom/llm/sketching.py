"""Fast similarity sketches of hashed sets (numpy).

A sketch has `size` coordinates.  In round i < size every element is thrown into
one hashed bin and offers the value (i, hash); in round size + j every element is
offered to bin j.  A bin keeps its least value.  Rounds stop once all bins are
full, which needs only a few of them for sets larger than the sketch, and the
second half of the rounds guarantees that no coordinate stays empty.  Two sets
agree in a coordinate with probability equal to their Jaccard similarity, with
concentration like that of independent coordinates.
"""

from __future__ import annotations

import numpy as np

from .text_arrays import mix64

_STEP = np.uint64(0xD1342543DE82EF95)
_LOW56 = np.uint64((1 << 56) - 1)
_FULL = np.uint64((1 << 64) - 1)


def sketch(elements: np.ndarray, size: int = 128) -> np.ndarray:
    """uint16[size] coordinates of a non-empty set of 64-bit hashes; size is a power of two up to 128."""
    bits = np.uint64(64 - (size.bit_length() - 1))
    bins = np.full(size, _FULL, np.uint64)
    at_once = max(1, 4096 // len(elements))
    i = 0
    while i < size and (bins == _FULL).any():
        rounds = np.arange(i, min(size, i + at_once), dtype=np.uint64)
        v = mix64(elements[None, :] ^ ((rounds + np.uint64(1)) * _STEP)[:, None])
        np.minimum.at(bins, (v >> bits).astype(np.intp).ravel(), ((rounds << np.uint64(56))[:, None] | (v & _LOW56)).ravel())
        i += len(rounds)
    for j in np.flatnonzero(bins == _FULL):
        v = mix64(elements ^ np.uint64((size + int(j) + 1) * int(_STEP) & (1 << 64) - 1))
        bins[j] = (np.uint64(size + j) << np.uint64(56)) | (v & _LOW56).min()
    return (mix64(bins) >> np.uint64(48)).astype(np.uint16)


def set_fingerprint(elements: np.ndarray) -> bytes:
    """128-bit order-free fingerprint of a set of 64-bit hashes."""
    a = mix64(elements ^ _STEP).sum(dtype=np.uint64)
    b = mix64(elements + _STEP).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def bands_for(threshold: float, size: int = 128, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the longest rows for which a pair at `threshold` is missed with probability below `miss`."""
    for rows in range(16, 0, -1):
        bands = size // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    return size, 1
