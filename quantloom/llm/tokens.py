"""Whole-text tokenisation with public byte-level BPE vocabularies.

A byte-level BPE vocabulary splits text into pieces that never run from a
non-space into a following space, so the ids of a text are the ids of its units
`space* nonspace*` strung together; a full stop or comma that ends a unit behind
an ASCII letter is a piece of its own too.  Units repeat far more often than texts
do, so each worker remembers their ids: numpy cuts the UTF-8 bytes of many texts
into units at once and looks them up in a table of fixed size.  A unit of up to 16
bytes is told by its bytes, exactly; longer ones are keys of a bounded dictionary.
Only units that are not there go to the tokenizers library, many in one call, whose
ids are told apart by byte length.  The result equals encoding each text by itself,
which the tests check.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .text_arrays import mix64

_ONE = np.zeros(256, bool)  # white space of one byte
_ONE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LEAD = np.zeros(256, bool)  # first bytes of longer white space
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LONG = np.array([int.from_bytes(c.encode(), "little") for c in _WIDE])
_WHITE = frozenset("\t\n\x0b\x0c\r ").union(_WIDE)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0xD1342543DE82EF95)


def vocabulary_path(name: str) -> str:
    """Path of an installed public vocabulary; other paths are passed through."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def white_space(values: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    out = _ONE[values]
    at = np.flatnonzero(_LEAD[values[:-1]]) if len(values) and values.max() >= 0xC2 else np.zeros(0, np.int64)
    if len(at):
        padded = np.concatenate([values, np.zeros(2, np.uint8)])
        code = padded[at].astype(np.int64) | padded[at + 1].astype(np.int64) << 8
        code[padded[at] != 0xC2] |= padded[at[padded[at] != 0xC2] + 2].astype(np.int64) << 16
        at = at[np.isin(code, _LONG)]
        out[at] = out[at + 1] = True
        out[at[values[at] != 0xC2] + 2] = True
    return out


def unit_starts(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the units of texts start that lie one behind the other in `values`; begins are those of texts that are not empty."""
    space = white_space(values)
    start = np.zeros(len(values), bool)
    start[1:] = space[1:] & ~space[:-1]
    start[begins] = True
    last = np.ones(len(values), bool)  # the next byte starts a unit
    last[:-1] = start[1:]
    start[1:] |= _STOP[values[1:]] & _LETTER[values[:-1]] & last[1:]
    return np.flatnonzero(start)


class UnitTokenizer:
    """ids of whole texts; 2**bits slots remember units, `long_units` bounds the longer ones and `store` all their ids."""

    def __init__(self, name: str, bits: int = 21, long_units: int = 100_000, store: int = 12_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary_path(name)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        split = parts.get("pre_tokenizer") or {}
        self.by_units = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not parts.get("normalizer")
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.size = self.library.get_vocab_size()
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bits, self.long_units, self.most = bits, long_units, store
        self._forget()

    def _forget(self) -> None:
        #: For each slot the first and last eight bytes of a unit, and place of its ids << 24 | their number << 8 | its length.
        self.slots = np.zeros((1 << self.bits, 3), np.uint64)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.store = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _single(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _keep(self, ids: np.ndarray) -> int:
        """Append ids to the store; the place of the first."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(len(self.store), len(ids)), self.dtype)])
        self.store[at : self.used] = ids
        return at

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the store, number of ids) of each unit, encoded by the library."""
        at, n = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        # White space followed by something else may stand behind any other unit.
        joined = [i for i, u in enumerate(units) if (s := u.decode())[0] in _WHITE and s[-1] not in _WHITE]
        alone = set(range(len(units))).difference(joined)
        for i in range(0, len(joined), 512):
            part = joined[i : i + 512]
            text = b"".join([units[k] for k in part]).decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            wanted = np.cumsum([len(units[k]) for k in part])
            ends = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(ends, wanted) + 1
            if cuts[-1] != len(ids) or not np.array_equal(ends[cuts - 1], wanted):
                alone.update(part)
                continue
            n[part] = np.diff(cuts, prepend=0)
            at[part] = self._keep(ids) + cuts - n[part]
        for k in alone:
            ids = self._single(units[k].decode())
            at[k], n[k] = self._keep(ids), len(ids)
        return at, n

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the store, number of ids) of each unit; data has eight bytes more at its end."""
        sizes = ends - starts
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        head = eight[starts] & _MASK[np.minimum(sizes, 8)]
        tail = np.where(sizes > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
        length = sizes.astype(np.uint64)
        h = mix64(head ^ mix64(tail * _STEP + length))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        row = self.slots[slot]
        known = (row[:, 0] == head) & (row[:, 1] == tail) & ((row[:, 2] & np.uint64(0xFF)) == length) & (sizes <= 16)
        at = (row[:, 2] >> np.uint64(24)).astype(np.int64)
        n = (row[:, 2] >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)
        raw = data.tobytes()
        short = np.flatnonzero(~known & (sizes <= 16))
        if len(short):
            _, first, back = np.unique(h[short], return_index=True, return_inverse=True)
            first = short[first]
            like = first[back]  # the unit whose ids stand for this one; another unit under an equal hash is learned apart
            same = (head[like] == head[short]) & (tail[like] == tail[short]) & (sizes[like] == sizes[short])
            a, m = self._learn([raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            at[short], n[short] = a[back], m[back]
            self.slots[slot[first]] = np.stack([head[first], tail[first], (a.astype(np.uint64) << np.uint64(24)) | (m.astype(np.uint64) << np.uint64(8)) | length[first]], axis=1)
            for k in short[~same]:
                a, m = self._learn([raw[starts[k] : ends[k]]])
                at[k], n[k] = a[0], m[0]
        long = np.flatnonzero(sizes > 16)
        if len(long):
            units = [raw[i:j] for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            new = [u for u in dict.fromkeys(units) if u not in self.long]
            if new:
                a, m = self._learn(new)
                self.long.update(zip(new, zip(a.tolist(), m.tolist(), strict=True), strict=True))
            found = np.array([self.long[u] for u in units], np.int64)
            at[long], n[long] = found[:, 0], found[:, 1]
        return at, n

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids (two bytes each if the vocabulary allows) of each text; null is empty."""
        if not self.by_units:
            return [self._single(t).tobytes() if t else b"" for t in texts]
        if self.used > self.most or len(self.long) > self.long_units:
            self._forget()
        coded = [t.encode() if t else b"" for t in texts]
        bounds = np.cumsum([0, *map(len, coded)])
        if not bounds[-1]:
            return coded
        data = np.frombuffer(b"".join([*coded, bytes(8)]), np.uint8)
        starts = unit_starts(data[: bounds[-1]], bounds[:-1][np.diff(bounds) > 0])
        at, n = self._look_up(data, starts, np.append(starts[1:], bounds[-1]))
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.store[np.repeat(at - before[:-1], n) + np.arange(before[-1])]
        cuts = before[np.searchsorted(starts, bounds)].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


_loaded: dict[str, UnitTokenizer] = {}


def tokenizer(name: str) -> UnitTokenizer:
    """One tokenizer for each Python worker, kept between its tasks."""
    if name not in _loaded:
        _loaded[name] = UnitTokenizer(name)
    return _loaded[name]


def text_groups(texts: list[str | None], chars: int = 1_500_000):
    """(first, last) ranges of about `chars` characters; a longer text stands alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > chars:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)
