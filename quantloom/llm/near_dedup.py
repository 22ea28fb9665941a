"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

1. Whole texts become sets of distinct word shingles; each set gets a sketch and a
   128-bit fingerprint.  Texts with equal sets form a class with one representative.
2. Bands of sketch coordinates put representatives into buckets.  The band shape
   follows the threshold so that a pair at the threshold is missed with a
   probability below 1e-6.
3. Members are compared with a leader of their bucket; pairs whose full sets pass
   are links, and links already merge most of a large group.
4. Buckets that still hold several components are compared exhaustively across
   components, in blocks of bounded size: all members outside the bucket's main
   component meet every member.  A first pass over sketches alone leaves in each block
   the rows that have a partner near enough to be looked at; only these are sent on
   with their texts, and a second pass compares full sets and returns a spanning part
   of the links it confirms.  No pair list is ever made.
5. Components of all links, by stars, give each class its least reachable doc_id.

Defined results: null, empty or wordless text has the empty set and is linked with
nothing; rows that share a doc_id share a node; a row without doc_id stands alone
(component_id null, kept); an empty table gives an empty result; further columns
are ignored by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, fits
from .sketching import bands_for, set_fingerprint, sketch
from .text_arrays import LOWER, buffers, hash_spans, releasing, shingle_set, slices, word_spans

SKETCH = 128
SCREEN_LOSS = 1e-6
BLOCK = 512
BROADCAST_BYTES = 48 << 20
BLOCK_COLUMNS = ["block", "band", "home", "loose", "node", "comp", "n", "sketch"]
BLOCK_TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, A-Z lower-cased."""
    values, offsets = buffers(column)
    for i, j in slices(offsets):
        starts, ends, first = word_spans(values, offsets[i : j + 1])
        words = hash_spans(values, starts, ends, LOWER)
        for d in range(j - i):
            yield shingle_set(words[first[d] : first[d + 1]], width)


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sketches = [], [], []
            for s in _sets(batch.column(2), width):
                sizes.append(len(s))
                prints.append(set_fingerprint(s) if len(s) else None)
                sketches.append(sketch(s, SKETCH).tobytes() if len(s) else None)
            more = [pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.record_batch([batch.column(0), batch.column(1), *more], names=["doc_id", "text_hash", "n", "node", "sketch"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _agreeing(floor: float):
    """Keep edges (a, b, sketch_a, sketch_b) whose sketches agree in a share of at least `floor`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, SKETCH) for c in (batch.column(2), batch.column(3)))
                batch = batch.filter(pa.array((x == y).mean(axis=1) >= floor))
            yield batch.select([0, 1])

    return run


def _verifier(width: int, percent: int):
    """Keep edges (a, b, text_a, text_b) whose full sets pass; rows arrive sorted by b, so its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_b, set_b = None, None
        for batch in batches:
            keep = []
            ids = batch.column(1).to_pylist()
            for i, (own, b) in enumerate(zip(_sets(batch.column(2), width), ids, strict=True)):
                if b != last_b:
                    last_b, set_b = b, next(_sets(batch.column(3).slice(i, 1), width))
                keep.append(_similar(own, set_b, percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


class _Forest:
    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x


def _fewest_agreeing(percent: int) -> int:
    """The most coordinates of which a pair exactly at the threshold has fewer in common with a chance below SCREEN_LOSS."""
    p, k, tail = percent / 100, 0, 0.0
    while (tail := tail + comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)) < SCREEN_LOSS:
        k += 1
    return k


def _able(home: list[tuple], percent: int, rows_in_band: int):
    """For a loose row: which home rows its full set must be compared with, and the share of coordinates they agree in."""
    least, band = _fewest_agreeing(percent) / SKETCH, home[0][1]
    signs = np.frombuffer(b"".join(r[7] for r in home), np.uint16).reshape(-1, SKETCH)
    sizes, comps = np.array([r[6] for r in home]), np.array([r[5] for r in home], dtype="V16")

    def able(r: tuple) -> tuple[np.ndarray, np.ndarray]:
        same = signs == np.frombuffer(r[7], np.uint16)
        agree = same.mean(axis=1)
        small, large = np.minimum(sizes, r[6]), np.maximum(sizes, r[6])
        out = (agree >= least) & (comps != np.void(r[5])) & (100 * small >= percent * large)
        if band:  # a pair that an earlier band has is left to it
            out &= ~same[:, : band * rows_in_band].reshape(len(home), band, rows_in_band).all(axis=2).any(axis=1)
        return out, agree

    return able


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block, which come together: block, band, home, loose, node, comp, n, sketch and more."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and r[0] != held[-1][0]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _screen(percent: int, rows_in_band: int):
    """The rows of each block that have a partner in it whose full set must be looked at; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            at_home = [i for i, r in enumerate(rows) if r[2]]
            if not at_home:
                continue
            able, met, wanted = _able([rows[i] for i in at_home], percent, rows_in_band), np.zeros(len(at_home), bool), set()
            for i, r in enumerate(rows):
                if r[3]:
                    hit, _ = able(r)
                    met |= hit
                    if hit.any():
                        wanted.add(i)
            wanted.update(at_home[j] for j in np.flatnonzero(met))
            some = [rows[i] for i in sorted(wanted)]
            if some:
                yield pa.record_batch([pa.array(*column) for column in zip(zip(*some, strict=True), BLOCK_TYPES, strict=True)], names=BLOCK_COLUMNS)

    return run


def _blocks(width: int, percent: int, rows_in_band: int):
    """Links across components inside each block of BLOCK_COLUMNS and text; rows come sorted by block."""

    def links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        home, loose = [r for r in rows if r[2]], [r for r in rows if r[3]]
        if not home or not loose:
            return []
        able, forest, made, out = _able(home, percent, rows_in_band), _Forest(), {}, []

        def set_of(r: tuple) -> np.ndarray:
            if r[4] not in made:
                made[r[4]] = next(_sets(pa.array([r[8]], pa.string()), width))
            return made[r[4]]

        for r in loose:
            hit, agree = able(r)
            at = np.flatnonzero(hit)
            for i in at[np.argsort(-agree[at], kind="stable")]:
                h = home[i]
                x, y = forest.find(r[5]), forest.find(h[5])
                if x != y and _similar(set_of(r), set_of(h), percent):
                    forest.up[x] = y
                    out.append((r[4], h[4]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            out = links(rows)
            yield pa.record_batch([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])

    return run


def _buckets(reps: DataFrame, bands: int, rows_in_band: int, scratch: Scratch) -> DataFrame:
    """(key, band, node, leader) of buckets with two nodes or more; of buckets with equal members, one."""
    part = lambda i: F.substring("sketch", i * (2 * rows_in_band) + 1, F.lit(2 * rows_in_band))
    sliced = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, part(i)).alias("key")))
    members = reps.select("node", F.explode(sliced).alias("e")).select("e.key", "e.band", "node")
    hashed = F.xxhash64("node").cast("decimal(20,0)")
    whole = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.sum(hashed).alias("sum"), F.min(F.struct(F.xxhash64("node", "key"), F.col("node"))).alias("leader"), F.min("band").alias("least_band")
    )
    whole = scratch.save(whole.where("size > 1"), "whole")
    # Equal size and sum of hashes: the same members. The band with the least number stays, as the blocks count on it.
    first = whole.groupBy("size", "sum").agg(F.min(F.struct("least_band", "key", "leader")).alias("x")).select("x.key", F.col("x.leader.node").alias("leader"))
    first = scratch.save(first, "first")
    out = scratch.save(members.join(first, "key"), "members")
    scratch.drop("whole", "first")
    return out


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _block_rows(members: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, band, home, loose, node, comp) for buckets that hold several components.

    A bucket's main component is its most frequent one.  Members outside it are
    loose and meet all members; members are dealt to home blocks and loose ones to
    loose parts, of about BLOCK rows each.
    """
    placed = scratch.save(_rooted(members, roots), "placed")
    counts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = mixed.select("key", F.col("main.comp").alias("main"), F.ceil(F.col("size") / BLOCK).alias("homes"), F.ceil((F.col("size") - F.col("main.c")) / BLOCK).alias("parts"))
    rows = placed.join(scratch.save(mixed, "mixed"), "key")
    spot = lambda n: F.pmod(F.xxhash64("node", "key"), F.col(n))
    span = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_home = F.transform(span("parts"), lambda p: F.struct(spot("homes").alias("h"), p.alias("p"), F.lit(True).alias("home"), ((F.col("comp") != F.col("main")) & (spot("parts") == p)).alias("loose")))
    as_loose = F.when(F.col("comp") != F.col("main"), F.filter(F.transform(span("homes"), lambda h: F.struct(h.alias("h"), spot("parts").alias("p"), F.lit(False).alias("home"), F.lit(True).alias("loose"))), lambda x: x["h"] != spot("homes")))
    spread = rows.select("key", "band", "node", "comp", F.explode(F.concat(as_home, F.coalesce(as_loose, F.filter(as_home, lambda x: F.lit(False))))).alias("x"))
    return spread.select(F.xxhash64("key", "x.h", "x.p").alias("block"), "band", "x.home", "x.loose", "node", "comp")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, text_hash, n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    distinct `words`-word shingles.
    """
    scratch = Scratch(docs.sparkSession, "near")
    bands, rows_in_band = bands_for(percent / 100, SKETCH)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = scratch.save(hashed.mapInArrow(releasing(_sketcher(words)), f"doc_id {kind}, text_hash long, n long, node binary, sketch binary"), "sketched")
    named = sketched.where("doc_id is not null and node is not null")
    example = F.min(F.struct("doc_id", "text_hash", "n", "sketch")).alias("x")
    reps = scratch.save(named.groupBy("node").agg(example).select("node", "x.*"), "reps")
    members = _buckets(reps, bands, rows_in_band, scratch)

    # The texts of all sets that share a bucket with another set.
    needed = scratch.save(reps.select("node", "doc_id", "text_hash").join(members.select("node").distinct(), "node", "left_semi"), "needed")
    side = F.broadcast(needed) if fits(needed, BROADCAST_BYTES) else needed
    texts = scratch.save(hashed.join(side, ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "text"), "texts")

    # Links to leaders, taken from the pairs whose sketches already say so; blocks see to all others.
    pairs = members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    signs = reps.select("node", "sketch")
    pairs = pairs.join(signs.toDF("a", "sa"), "a").join(signs.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    near = scratch.save(pairs.mapInArrow(_agreeing(percent / 100), "a binary, b binary"), "near")
    near = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").sortWithinPartitions("b").select("a", "b", "ta", "tb")
    stars = scratch.save(near.mapInArrow(releasing(_verifier(words, percent)), "a binary, b binary"), "stars")
    by_id = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    by_id = named.join(by_id, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = scratch.save(stars.unionByName(by_id), "links")

    rows = _block_rows(members, connected_components(links, scratch, "inner"), scratch)
    rows = rows.join(reps.select("node", "n", "sketch"), "node").select(*BLOCK_COLUMNS)
    screen = rows.repartition("block").sortWithinPartitions("block").mapInArrow(releasing(_screen(percent, rows_in_band)), "block long, band int, home boolean, loose boolean, node binary, comp binary, n long, sketch binary")
    rows = scratch.save(screen, "screened").join(texts, "node").select(*BLOCK_COLUMNS, "text").repartition("block").sortWithinPartitions("block")
    across = scratch.save(rows.mapInArrow(releasing(_blocks(words, percent, rows_in_band)), "a binary, b binary"), "across")
    scratch.drop("texts", "members", "placed", "near", "screened")

    roots = connected_components(links.unionByName(across), scratch, "outer")
    classes = _rooted(reps.select("node", "doc_id"), roots)
    least = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = scratch.save(classes.join(least, "comp").select("node", "component_id"), "classes")
    ids = sketched.select("doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = ids.join(classes, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, all columns kept: one doc_id of each group, and what is linked with nothing."""
    marks = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    marks = Scratch(docs.sparkSession, "near").save(marks, "removed")
    side = F.broadcast(marks) if fits(marks, BROADCAST_BYTES) else marks
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so no name can clash
    return rows.join(side, (F.col("row.doc_id") == F.col("id")) & (F.xxhash64("row.text") == F.col("text_hash")), "left_anti").select("row.*")
