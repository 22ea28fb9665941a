"""Substring deduplication by hashing lines or paragraphs, and the sentences in them.

Texts are cut into blocks (lines or paragraphs) and these into sentences; a unit is a
sentence with the white space behind it, so the units of a text tile it.  Contents are
normalised (lower case, white space to one blank) and hashed to 128 bits, digests are
grouped over the whole corpus, and the occurrence with the least (doc_id, text, unit)
stays.  A later occurrence goes

* if its whole block has an earlier occurrence as a block, however short it is, or
* if it lies in a run of adjacent repeated sentences with at least `min_chars`
  characters of normalised content: so passages inside differing blocks are found,
  and single short sentences, which repeat by chance, stay.

Every distinct unit stays somewhere, as its least occurrence is never removed.  Removed
units are told with their offsets in the original text, in code points, and with the
place of the occurrence that stays.  A document is not `kept` as a whole if nothing but
white space is left, or if it lost a run of at least `min_chars` characters whose units
stand first in other documents: then it holds a passage of another document.

Defined results: null text stays null and kept; empty and blank texts are kept as they
are; rows that repeat doc_id and text are the same document and share one result; rows
that share a doc_id alone are documents of their own; a null doc_id ranks last; an empty
table gives an empty result; further columns are ignored by name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import text_groups

MIN_CHARS = 160
_BETWEEN = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+|(?<=[。！？])[ \t]*")


def units_of(text: str, unit: str = "line") -> list[tuple[int, int, int, bytes]]:
    """(start, end, block, normalised content) of all units of a text; an end is the next start."""
    out, block, at = [], 0, 0
    for stop, after in [*((m.start(), m.end()) for m in _BETWEEN[unit].finditer(text)), (len(text), len(text))]:
        content = text[at:stop]
        last = 0
        for m in _SENTENCE.finditer(content):
            out.append((at + last, at + m.end(), block, b" ".join(content[last : m.start()].lower().encode().split())))
            last = m.end()
        out.append((at + last, after, block, b" ".join(content[last:].lower().encode().split())))
        at, block = after, block + 1
    return out


def _hashes(contents: list[bytes], person: bytes) -> list[bytes]:
    return [hashlib.blake2b(c, digest_size=16, person=person).digest() for c in contents]


def _digests(unit: str):
    """(doc_id, text_hash, unit, level, a, b): level 0 a sentence, 1 one that is a block, 2 a block of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in text_groups(texts):
                rows, numbers, levels, contents, whole = [], [], [], [], []
                for row in range(i, j):
                    held: list[tuple[int, bytes]] = []  # the units of a block
                    last = 0
                    for number, (_, _, block, content) in enumerate([*(units_of(texts[row], unit) if texts[row] else ()), (0, 0, -1, b"")]):
                        if block != last and held:
                            rows += [row] * len(held)
                            numbers += [n for n, _ in held]
                            levels += [int(len(held) == 1)] * len(held)
                            contents += [c for _, c in held]
                            if len(held) > 1:
                                whole.append((row, held[0][0], b" ".join([c for _, c in held])))
                            held = []
                        last = block
                        if content:
                            held.append((number, content))
                digests = _hashes(contents, b"unit") + _hashes([c for _, _, c in whole], b"block")
                at = pa.array([*rows, *(r for r, _, _ in whole)], pa.int64())
                parts = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = [pa.array([*numbers, *(n for _, n, _ in whole)], pa.int32()), pa.array([*levels, *[2] * len(whole)], pa.int32()), pa.array(parts[:, 0]), pa.array(parts[:, 1])]
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["doc_id", "text_hash", "unit", "level", "a", "b"])

    return run


def repeated_units(docs: DataFrame, unit: str, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, units) of docs(doc_id, text_hash, text) with later occurrences of units.

    units is a set of (unit, whole, keep_doc_id, keep_unit, other): the unit, or for a whole block of several
    its first one, the occurrence that stays, and whether that is in another document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = scratch.save(docs.mapInArrow(_digests(unit), f"doc_id {kind}, text_hash long, unit int, level int, a long, b long"), "made")  # read twice
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "unit")
    first = made.groupBy("a", "b").agg(F.min(rank).alias("first"), F.min(F.when(F.col("level") > 0, rank)).alias("block"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written, so that both sides of the join are plain shuffles and a frequent unit can be split.
    again = made.join(scratch.save(first, "first"), ["a", "b"])
    whole = (F.col("level") > 0) & (rank > F.col("block"))
    again = again.where(whole | ((F.col("level") < 2) & (rank > F.col("first"))))
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    one = F.struct("unit", F.col("level").alias("level"), whole.alias("whole"), F.col("first.doc_id").alias("keep_doc_id"), F.col("first.unit").alias("keep_unit"), other.alias("other"))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set(one).alias("units"))


def _runs(units: list[tuple[int, int, int, bytes]], marked: set[int], min_chars: int) -> set[int]:
    """The marked units that lie in runs of at least min_chars characters; units without content end no run."""
    out, run, chars = set(), [], 0
    for k, (_, _, _, content) in enumerate([*units, (0, 0, 0, b".")]):
        if k in marked:
            run.append(k)
            chars += len(content.decode())
        elif content:
            if run and chars >= min_chars:
                out.update(run)
            run, chars = [], 0
    return out


def judge_text(text: str, found: list[dict], unit: str = "line", min_chars: int = MIN_CHARS) -> tuple[str, bool, list[dict]]:
    """(text without its removed units, kept, removed spans) for one text and its repeated units."""
    units = units_of(text, unit)
    again = {x["unit"]: x for x in found if x["level"] < 2}
    whole = {x["unit"] for x in found if x["whole"]}
    blocks = {units[k][2] for k in whole}
    gone = {k for k in again if units[k][2] in blocks} | _runs(units, set(again), min_chars)
    passage = _runs(units, {k for k in gone if again[k]["other"]}, min_chars)
    left = any(c and k not in gone for k, (_, _, _, c) in enumerate(units))
    spans = [{"start": units[k][0], "length": units[k][1] - units[k][0], "keep_doc_id": again[k]["keep_doc_id"], "keep_unit": again[k]["keep_unit"]} for k in sorted(gone)]
    return "".join([text[a:z] for k, (a, z, _, _) in enumerate(units) if k not in gone]), left and not passage, spans


def _cutter(unit: str, min_chars: int, kind: pa.DataType):
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("keep_doc_id", kind), ("keep_unit", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept, spans = [], [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text, whole, cut = judge_text(text, found, unit, min_chars) if found else (text, True, [])
                texts.append(text)
                kept.append(whole)
                spans.append(cut)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(kept, pa.bool_()), pa.array(texts, pa.string()), pa.array(spans, span)], names=["doc_id", "text_hash", "kept", "text", "removed_spans"])

    return run


def dedup_substrings(docs: DataFrame, unit: str = "line", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, text_hash, kept, text, removed_spans.

    text is what is left; removed_spans lists (start, length, keep_doc_id, keep_unit) in the original text;
    text_hash is xxhash64 of the original text.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    kind = docs.schema["doc_id"].dataType
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    listed = scratch.save(repeated_units(keyed, unit, scratch), "listed").toDF("_id", "_hash", "units")
    scratch.drop("made", "first")
    rows = keyed.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text_hash", "text", "units")
    name = kind.simpleString()
    schema = f"doc_id {name}, text_hash long, kept boolean, text string, removed_spans array<struct<start:long,length:long,keep_doc_id:{name},keep_unit:int>>"
    from pyspark.sql.pandas.types import to_arrow_type

    return rows.mapInArrow(_cutter(unit, min_chars, to_arrow_type(kind)), schema)
