"""Word arrays over Arrow text columns, computed batch-wise in numpy.

Several operators need the words `[^\\x20\\x09-\\x0D]+` of whole texts.  These
helpers work on the UTF-8 buffer of an Arrow string column, so no Python object
is made per word: words are byte spans, and each word gets a 64-bit hash from a
rolling prefix sum.  Buffers are processed in slices cut between words, so memory
follows the slice and the longest single text, never the whole batch.

Null texts are treated as empty everywhere in this module.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def releasing(run: Callable) -> Callable:
    """run over batches, then give what the task has freed back to the system: workers are kept between tasks and stages,
    and Arrow and the C library keep such memory, some 150 MB a worker beside the tokenizer's tables."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
            if trim is not None:
                trim(0)

    return released


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 mixing step)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        base, size = 0x100000001B3, 1 << (n - 1).bit_length()
        inverse = pow(base, -1, 1 << 64)
        full = np.full(size, base, dtype=np.uint64)
        full[0] = 1
        back = np.full(size, inverse, dtype=np.uint64)
        back[0] = 1
        _pow, _inv = np.cumprod(full), np.cumprod(back)
    return _pow, _inv


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have length zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.string()), False
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `limit` bytes; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of all words of texts `offsets` into `values`.

    first[i] is the index of the first word of text i; it has len(offsets) entries.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = ~_SPACE[values[lo:hi]]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(hi - lo + 1, bool)
    edge[offsets - lo] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts + lo, np.flatnonzero(ends) + 1 + lo, np.searchsorted(starts + lo, offsets)


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans that are ascending and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = values[lo:hi]
        if fold is not None:
            part = fold[part]
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: hi - lo], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        h = (total[b] - total[a]) * down[a]
        out[i:j] = mix64(h + (b - a).astype(np.uint64) * _MULT + np.uint64(seed))
        i = j
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` adjacent word hashes (len(words)-width+1 of them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix64(h * _MULT + words[k : k + n])
    return h


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))
