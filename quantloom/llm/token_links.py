"""Alignment of the tokens of two public tokenizers, and how often ids go together.

Tokens of A and B are spans of bytes of the same text.  Tokens that overlap are linked,
and the components of those links are the groups: the shortest runs of bytes at whose ends
tokens of both end.  Groups are found by pointer jumping: every token points to its
farthest-right overlapping token (the other side's token at its last byte, or itself where
that one ends no later), and the pointers of all tokens are doubled, p = p[p], until none
changes.  Then every token points to the last token of its component, which labels it.

Both tokenizers are told apart at blanks and line feeds that follow something else than
white space: neither has a token across such a place (checked for the vocabularies when
they are loaded; otherwise texts are not cut).  The units between those places repeat far
more often than texts do, so workers remember their tokens, groups and links, and a text is
the string of its units.

Corpus counts come from blocks of documents.  A block names its distinct id pairs and in how
many of its documents each is linked, Spark adds those up, finds the largest count of each
A id, and sends each block the counts of its own pairs.  A block is bounded in bytes, and no
table of the corpus' pairs is broadcast or collected.

Defined results: null and empty texts, and texts that the tokens of A or B do not spell (as
where B normalises characters) have no tokens: zeros, and an empty string for the groups; rows
that repeat a doc_id or a text are documents of their own, null ids too; any type of doc_id;
an empty table gives no rows; further columns are ignored by name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text_arrays import buffers, releasing, slices
from .tokens import vocabulary_path

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 6_000_000
_UNITS = 200_000  # that a worker remembers
_JOINED = 256  # units that are coded as one text
_UNIT_CHARS = 40  # longer ones are not remembered
_UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_INSIDE = re.compile(r"[ \n]|[^▁]▁")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable ones are themselves, the others follow 255 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … (n[0] of them), first[1], …"""
    before = np.cumsum(n) - n
    return np.repeat(first - before, n) + np.arange(n.sum())


class Tokens(NamedTuple):
    """ids of many texts one behind the other, the number of ids and the bytes of each token, and whether they spell each text."""

    ids: np.ndarray
    count: np.ndarray
    size: np.ndarray
    spelt: np.ndarray


def _tokens(ids: np.ndarray, count: np.ndarray, words: list[bytes | None], sizes: np.ndarray, wanted: list[bytes]) -> Tokens:
    """Tokens of texts with `count` ids each; a text is spelt if its tokens' bytes, one behind the other, are its own."""
    size = sizes[ids]
    bounds = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    cuts = np.concatenate([[0], np.cumsum(count)])
    length = np.array([len(w) for w in wanted], np.int64)
    unknown = np.concatenate([[0], np.cumsum(size < 0)])
    spelt = (bounds[cuts[1:]] - bounds[cuts[:-1]] == length) & (unknown[cuts[1:]] == unknown[cuts[:-1]])
    every = bool(spelt.all())
    own = (ids if every else ids[np.repeat(spelt, count)]).tolist()
    mine = np.frombuffer(b"".join(list(map(words.__getitem__, own))), np.uint8)
    theirs = np.frombuffer(b"".join(wanted if every else [w for w, ok in zip(wanted, spelt.tolist(), strict=True) if ok]), np.uint8)
    differs = np.flatnonzero(mine != theirs)
    if len(differs):
        at = np.flatnonzero(spelt)
        spelt[at[np.searchsorted(np.cumsum(length[at]), differs, side="right")]] = False
    return Tokens(ids, count, np.maximum(size, 0), spelt)


class TwoTokenizers:
    """Both tokenizers, and what is known of units."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary_path(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b))
        alphabet = byte_alphabet()
        self.a_words: list[bytes | None] = [None] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_words[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else None
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        whole = [not (self.b.is_unknown(i) or self.b.is_control(i) or self.b.is_unused(i)) for i in range(len(pieces))]
        self.b_words: list[bytes | None] = [
            (bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) if ok else None for i, (p, ok) in enumerate(zip(pieces, whole, strict=True))
        ]
        with open(vocabulary_path(a), encoding="utf-8") as f:
            parts = json.load(f)
        split = parts.get("pre_tokenizer") or {}
        by_words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not parts.get("normalizer")
        self.cuts = by_words and not any(_INSIDE.search(p) for p, ok in zip(pieces, whole, strict=True) if ok)
        self.a_sizes, self.b_sizes = (np.array([-1 if w is None else len(w) for w in words], np.int64) for words in (self.a_words, self.b_words))
        self.head = len(self.b.encode("x"))
        #: Ids as text, those of A behind nothing, a comma or a semicolon, those of B behind a comma or a bar.
        self.text = [sign + b"%d" % i for i in range(len(self.a_words)) for sign in (b"", b",", b";")] + [sign + b"%d" % i for i in range(len(pieces)) for sign in (b",", b"|")]
        self.text_sizes = np.array(list(map(len, self.text)), np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.units = Units.empty()

    def encode_a(self, units: list[str]) -> Tokens:
        """Units that are cut out of texts: most are coded as a part of one text and told apart by their bytes."""
        wanted = [u.encode() for u in units]
        alone = [i for i, u in enumerate(units) if not self.cuts or u[0] not in " \n" or u[-1].isspace()]
        joined = sorted(set(range(len(units))).difference(alone)) if alone else list(range(len(units)))
        parts = [joined[i : i + _JOINED] for i in range(0, len(joined), _JOINED)]
        texts = ["".join([units[k] for k in part]) for part in parts] + [units[k] for k in alone]
        found = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.array(list(chain.from_iterable(found)), np.int64)
        order = np.array([*joined, *alone], np.int64)
        ends = np.cumsum(np.array([len(w) for w in wanted], np.int64)[order])
        cuts = np.searchsorted(np.cumsum(self.a_sizes[ids]), ends) + 1
        count = np.zeros(len(units), np.int64)
        count[order] = np.diff(cuts, prepend=0)
        first = np.zeros(len(units), np.int64)
        first[order] = cuts - count[order]
        return _tokens(ids[_ranges(first, count)], count, self.a_words, self.a_sizes, wanted)

    def encode_b(self, units: list[str]) -> Tokens:
        """Units as they are coded inside a text: behind a letter, whose ids are left out."""
        found = self.b.encode(["x" + u for u in units], num_threads=1)
        count = np.array(list(map(len, found)), np.int64)
        ids = np.array(list(chain.from_iterable(found)), np.int64)
        ids = ids[_ranges(np.cumsum(count) - count + self.head, count - self.head)]
        return _tokens(ids, count - self.head, self.b_words, self.b_sizes, [u.encode() for u in units])

    def split(self, text: str) -> list[str]:
        """The units of a blank and the text."""
        return _UNIT.findall(" " + text) if self.cuts else [" " + text]


_loaded: dict[tuple[str, str], TwoTokenizers] = {}


def two_tokenizers(a: str, b: str) -> TwoTokenizers:
    """One pair for each Python worker, kept between its tasks."""
    if (a, b) not in _loaded:
        _loaded[a, b] = TwoTokenizers(a, b)
    return _loaded[a, b]


def component_ends(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For tokens of A, then of B, with ascending ends over the same bytes: the token that ends each one's component.

    A's token points to B's token at its last byte, B's to A's if that one ends later and else to itself.
    """
    a_to = np.searchsorted(b_end, a_end)
    b_to = np.searchsorted(a_end, b_end)
    own = len(a_end) + np.arange(len(b_end))
    later = a_end[np.minimum(b_to, len(a_end) - 1)] > b_end if len(a_end) else np.zeros(len(b_end), bool)
    point = np.concatenate([len(a_end) + a_to, np.where(later, b_to, own)])
    while True:
        further = point[point]
        if np.array_equal(further, point):
            return point
        point = further


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (token of A, token of B) that share a byte, in A's order."""
    a_start = np.concatenate([[0], a_end[:-1]]) if len(a_end) else a_end
    first, last = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_end, a_end)
    n = last - first + 1
    before = np.cumsum(n) - n
    return np.repeat(np.arange(len(a_end)), n), np.arange(n.sum()) - np.repeat(before - first, n)


def group_text(a_ids: np.ndarray, b_ids: np.ndarray, label: np.ndarray, a_unit: np.ndarray, kinds: TwoTokenizers) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(the token of B that ends each group, bytes of text of each group, `a1,a2|b1;a3|b2,b3` of all units without the signs between units)."""
    n_a, n_b = len(a_ids), len(b_ids)
    new = np.diff(label[:n_a], prepend=-1) != 0
    a_group = np.cumsum(new) - 1
    ends = label[:n_a][new] - n_a
    b_n = np.diff(ends, prepend=-1)
    b_group = np.repeat(np.arange(len(ends)), b_n)
    b_first = np.zeros(n_b, bool)
    b_first[ends - b_n + 1] = True
    unit_first = np.diff(a_unit, prepend=-1) != 0
    codes = np.zeros(n_a + n_b, np.int64)
    a_at = np.arange(n_a) + (ends - b_n + 1)[a_group]  # behind B's tokens of earlier groups
    b_at = np.arange(n_b) + np.append(np.flatnonzero(new)[1:], n_a)[b_group]
    codes[a_at] = 3 * a_ids + np.where(unit_first, 0, np.where(new, 2, 1))
    codes[b_at] = 3 * len(kinds.a_words) + 2 * b_ids + b_first
    group = np.zeros(n_a + n_b, np.int64)
    group[a_at], group[b_at] = a_group, b_group
    size = np.bincount(group, weights=kinds.text_sizes[codes], minlength=len(ends)).astype(np.int64)
    return ends, size, b"".join(list(map(kinds.text.__getitem__, codes.tolist())))


class Units(NamedTuple):
    """Of each unit: whether both spell it, its numbers of A's and B's tokens and groups, its groups as text, its links' pairs a << 32 | b."""

    spelt: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    text: list[bytes]
    links: np.ndarray  # number of each unit's
    pairs: np.ndarray

    @staticmethod
    def empty() -> Units:
        none = np.zeros(0, np.int64)
        return Units(np.zeros(0, bool), none, none, none, [], none, none)

    def plus(self, other: Units) -> Units:
        return Units(*[x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(self, other, strict=True)])


def align_units(units: list[str], kinds: TwoTokenizers) -> Units:
    """Groups and links of all units at once; a unit that one of them does not spell has none."""
    a, b = kinds.encode_a(units), kinds.encode_b(units)
    spelt = a.spelt & b.spelt
    a_unit, b_unit = np.repeat(np.arange(len(units)), a.count), np.repeat(np.arange(len(units)), b.count)
    keep_a, keep_b = spelt[a_unit], spelt[b_unit]
    a_unit, b_unit, a_ids, b_ids = a_unit[keep_a], b_unit[keep_b], a.ids[keep_a], b.ids[keep_b]
    a_end, b_end = np.cumsum(a.size[keep_a]), np.cumsum(b.size[keep_b])  # units lie one behind the other, so no group leaves one
    at, size, text = group_text(a_ids, b_ids, component_ends(a_end, b_end), a_unit, kinds)
    n_groups = np.bincount(b_unit[at], minlength=len(units))
    cuts = np.concatenate([[0], np.cumsum(np.bincount(b_unit[at], weights=size, minlength=len(units)))]).astype(np.int64).tolist()
    of_a, of_b = overlaps(a_end, b_end)
    return Units(
        spelt, np.where(spelt, a.count, 0), np.where(spelt, b.count, 0), n_groups, [text[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
        np.bincount(a_unit[of_a], minlength=len(units)), a_ids[of_a] << 32 | b_ids[of_b],
    )


class Block(NamedTuple):
    """Documents of a block and what they link: pairs ascend, held has the documents of each, links of each unit its place among the pairs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    sha256: list[str]
    units: list[np.ndarray]
    pairs: np.ndarray
    held: np.ndarray
    unit_links: np.ndarray
    links: np.ndarray


def align_block(texts: list[str | None], kinds: TwoTokenizers) -> Block:
    if len(kinds.known) > _UNITS:
        kinds.forget()
    cut = [kinds.split(t) if t else [] for t in texts]
    count = np.array([len(u) for u in cut], np.int64)
    seen = dict.fromkeys(chain.from_iterable(cut))
    seen = dict(zip(seen, range(len(seen)), strict=True))
    flat = np.fromiter(map(seen.__getitem__, chain.from_iterable(cut)), np.int64, count.sum())
    new = [u for u in seen if u not in kinds.known]
    short, long = [u for u in new if len(u) <= _UNIT_CHARS], [u for u in new if len(u) > _UNIT_CHARS]
    kinds.known.update(zip(short, range(len(kinds.known), len(kinds.known) + len(short)), strict=True))
    if short:
        kinds.units = kinds.units.plus(align_units(short, kinds))
    table, at = kinds.units, kinds.known
    if long:  # behind the remembered ones, for this block
        at = {u: len(kinds.known) + i for i, u in enumerate(long)}
        table = table.plus(align_units(long, kinds))
    place = np.array([kinds.known[u] if u in kinds.known else at[u] for u in seen], np.int64)
    doc = np.repeat(np.arange(len(texts)), count)
    good = count > 0
    np.logical_and.at(good, doc, table.spelt[place][flat])
    n_of = lambda c: np.where(good, np.bincount(doc, weights=c[place][flat], minlength=len(texts)), 0).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(count)])
    own = [flat[i:j] if ok else flat[:0] for i, j, ok in zip(bounds[:-1], bounds[1:], good, strict=True)]
    text = [table.text[p] for p in place.tolist()]
    sha = [hashlib.sha256(b";".join([text[u] for u in units.tolist()])).hexdigest() if ok else "" for units, ok in zip(own, good, strict=True)]
    first = np.cumsum(table.links) - table.links
    unit_links = table.links[place] if len(place) else np.zeros(0, np.int64)
    pairs, links = np.unique(table.pairs[_ranges(first[place], unit_links)] if len(place) else np.zeros(0, np.int64), return_inverse=True)
    # Distinct units of each document, then distinct pairs of each document.
    keep = good[doc]
    key = np.unique(doc[keep] * max(1, len(place)) + flat[keep])
    of_doc, of_unit = key // max(1, len(place)), key % max(1, len(place))
    begin = np.cumsum(unit_links) - unit_links
    linked = links[_ranges(begin[of_unit], unit_links[of_unit])] if len(of_unit) else np.zeros(0, np.int64)
    each = np.unique(np.repeat(of_doc, unit_links[of_unit] if len(of_unit) else of_doc) * max(1, len(pairs)) + linked)
    held = np.bincount(each % max(1, len(pairs)), minlength=len(pairs)) if len(pairs) else np.zeros(0, np.int64)
    return Block(n_of(table.n_a), n_of(table.n_b), n_of(table.n_groups), n_of(table.links), sha, own, pairs, held, unit_links, links)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _align(a: str, b: str, key_type: pa.DataType):
    """A row for each document, and behind those of a block one (without numbers) for its pairs and units."""
    names = ["doc_id", "block", *_NUMBERS, "sha256", "units", "pairs", "held", "unit_links", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, number = two_tokenizers(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in slices(buffers(batch.column(1))[1], BLOCK_BYTES):
                part = batch.slice(i, j - i)
                found, n = align_block(part.column(1).to_pylist(), kinds), j - i
                none = [pa.nulls(n, pa.binary())] * 4
                columns = [part.column(0), pa.array([number] * n, pa.int64()), *[pa.array(getattr(found, c), pa.int64()) for c in _NUMBERS]]
                yield pa.record_batch([*columns, pa.array(found.sha256), pa.array([u.astype("<u4").tobytes() for u in found.units], pa.binary()), *none], names=names)
                own = [found.pairs.astype("<i8"), found.held.astype("<u4"), found.unit_links.astype("<u4"), found.links.astype("<u4")]
                columns = [pa.nulls(1, key_type), pa.array([number], pa.int64()), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
                yield pa.record_batch([*columns, *[pa.array([x.tobytes()], pa.binary()) for x in own]], names=names)
                number += 1

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            pairs, held = np.frombuffer(batch.column(1)[at].as_buffer(), "<i8"), np.frombuffer(batch.column(2)[at].as_buffer(), "<u4")
            yield pa.record_batch([pa.array(np.full(len(pairs), batch.column(0)[at].as_py())), pa.array(pairs), pa.array(held.astype(np.int64))], names=["block", "pair", "held"])


def _count_documents(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Documents of a block with the sums over their links; counts has a row for each of its pairs."""
    block, docs = rows[rows["pairs"].notna()].iloc[0], rows[rows["pairs"].isna()]
    order = np.argsort(counts["pair"].to_numpy())
    links, unit_links = np.frombuffer(block["links"], "<u4"), np.frombuffer(block["unit_links"], "<u4").astype(np.int64)
    unit = np.repeat(np.arange(len(unit_links)), unit_links)
    total, best = np.zeros(len(unit_links), np.int64), np.zeros(len(unit_links), np.int64)
    if len(links):
        np.add.at(total, unit, counts["n"].to_numpy(np.int64)[order][links])
        np.add.at(best, unit, counts["best"].to_numpy(np.int64)[order][links])
    units = [np.frombuffer(u, "<u4") for u in docs["units"]]
    out = docs[["doc_id", *_NUMBERS]].copy()
    out["n_best"], out["count_sum"] = [int(best[u].sum()) for u in units], [int(total[u].sum()) for u in units]
    out["groups_sha256"] = docs["sha256"]
    return out


def link_counts(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """(pair, n, best) of pairs(pair, held): documents of each pair, and whether no pair of its A id has more."""
    counted = scratch.save(pairs.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("a", F.shiftright("pair", 32)), "counted")
    largest = counted.groupBy(F.col("a").alias("_a")).agg(F.max("n").alias("most"))  # at most A's vocabulary
    return counted.join(largest, F.col("a") == F.col("_a")).select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def align_documents(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs(doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    scratch = Scratch(spark, "links")
    kind = docs.schema["doc_id"].dataType
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    schema = f"doc_id {kind.simpleString()}, block long, {numbers}, sha256 string, units binary, pairs binary, held binary, unit_links binary, links binary"
    rows = scratch.save(docs.select("doc_id", "text").mapInArrow(releasing(_align(a, b, to_arrow_type(kind))), schema), "aligned")
    pairs = scratch.save(rows.where("pairs is not null").select("block", "pairs", "held").mapInArrow(_pairs, "block long, pair long, held long"), "pairs")
    counts = scratch.save(link_counts(scratch, pairs), "counts")
    known = pairs.select("block", "pair").join(counts, "pair").select("block", "pair", "n", "best")
    own = rows.select("doc_id", "block", *_NUMBERS, "sha256", "units", "pairs", "unit_links", "links")
    out = f"doc_id {kind.simpleString()}, {numbers}, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_count_documents, out)
