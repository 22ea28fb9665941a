"""Exact search for the largest inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it.  The vectors of a
pivot, sorted by distance, are cut into annuli, and an annulus into chunks of a bounded
size, which are rows of a written table.  Of each annulus the pivot, its least and largest
distance and the largest length of a vector are known: at most PIVOTS * ANNULI rows,
whatever the number of vectors.

A vector v of an annulus is no nearer to a query q than |d(q, pivot) - d(v, pivot)| allows
(triangle inequality), and q.v = (|q|^2 + |v|^2 - d(q, v)^2) / 2, so an annulus has an upper
bound of its scores; q.pivot + |q| * d(v, pivot) is another.  Each query sorts the annuli by
that bound and visits them in rounds that grow eightfold; it stops at the first annulus whose
bound is below the score of its k-th best so far.  What is left out can thus hold no result,
and ties are visited.  In a round the queries go to the annuli, packed by the hundred, meet
their chunks in a plain join, which adaptive execution may split, and send the best of each
chunk on.

The pivots are fitted on a bounded sample (SAMPLE rows, those of least hash); they only
decide how much is left out.  Vectors without any cluster structure leave the bound little to
exclude, and the search reads most chunks.

Defined results: vectors that are null or empty, hold null or non-finite entries, are not as
long as most (see `vectors`) or have no id take no part, as candidates or as queries; rows with
the query's own id are no candidates of it; rows that repeat an id are candidates each; of
queries that repeat an id the least vector asks; equal scores go to the smaller id; a score
beyond 64 bits stops there; further columns are ignored by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .vectors import matrix, save_common, whole_vectors

SAMPLE = 8192
PIVOTS = 128
ANNULI = 64
ANNULUS_ROWS = 512  # that an annulus has at least on average
CHUNK_BYTES = 1 << 18
PACKET = 512  # queries sent to an annulus together
FIRST, GROWTH = 2, 8


class Annuli(NamedTuple):
    """Of each annulus its number, pivot, least and largest distance and largest squared length."""

    number: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    most: np.ndarray
    square: np.ndarray


def fit_pivots(sample: np.ndarray, wanted: int, rounds: int = 4) -> np.ndarray:
    """Centres of the sample: far apart at first, then moved to the mean of their nearest rows."""
    sample = np.unique(sample, axis=0).astype(np.float64)
    centres = sample[:1]
    gap = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(wanted, len(sample)):
        centres = np.concatenate([centres, sample[gap.argmax()][None]])
        gap = np.minimum(gap, ((sample - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = distances(sample, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """float64[rows, centres]; differences are taken before squaring, a centre at a time."""
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def score_bounds(q: np.ndarray, centres: np.ndarray, annuli: Annuli) -> np.ndarray:
    """float64[queries, annuli]: no vector of the annulus has a higher inner product with the query."""
    d = distances(q, centres)[:, annuli.pivot]
    square = (q**2).sum(axis=1)[:, None]
    gap = np.maximum(0.0, np.maximum(d - annuli.most, annuli.least - d))
    by_triangle = (square + annuli.square - gap**2) / 2
    by_length = (q @ centres.T)[:, annuli.pivot] + np.sqrt(square) * annuli.most
    bound = np.minimum(by_triangle, by_length)
    return bound + 1e-9 * (np.abs(bound) + square + annuli.square) + 1e-6  # above any rounding of what goes in


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """int64[queries, candidates], exact; beyond 64 bits the largest or least number."""
    most = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(c).max(initial=0))) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best_of(scores: np.ndarray, allowed: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best allowed scores of each row that reach its floor; earlier columns win ties."""
    least = np.iinfo(np.int64).min
    if scores.shape[1] > k:
        kth = np.partition(np.where(allowed, scores, least), -k, axis=1)[:, -k]
        floor = np.maximum(floor, kth)
    row, column = np.nonzero(allowed & (scores >= floor[:, None]))
    order = np.lexsort((column, ~scores[row, column], row))  # ~ turns the order of whole numbers round within 64 bits
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _key(centres: np.ndarray, dimensions: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimensions)
            d = distances(x.astype(np.float64), centres)
            nearest = d.argmin(axis=1)
            packed = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
            yield pa.record_batch([batch.column(0), packed, pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(x)), nearest], pa.float64())], names=["id", "x", "pivot", "r"])

    return run


def _chunks(edges: dict[int, list[float]], annuli: int, dimensions: int, kind: str, most_rows: int):
    """Chunks of rows that come sorted by pivot and distance."""

    def made(annulus: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        for at in range(0, table.num_rows, most_rows):
            part = table.slice(at, most_rows)
            part = part.take(pc.sort_indices(part, sort_keys=[("id", "ascending"), ("x", "ascending")])).combine_chunks()
            x, r = matrix(part["x"].combine_chunks(), dimensions, kind), part["r"].to_numpy()
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["id"].combine_chunks())
            square = float((x.astype(np.float64) ** 2).sum(axis=1).max())
            columns = [pa.array([annulus], pa.int32()), pa.array([r.min()]), pa.array([r.max()]), pa.array([square]), ids, pa.array([x.tobytes()], pa.binary())]
            yield pa.record_batch(columns, names=["annulus", "least", "most", "square", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = -1, [], 0
        for batch in batches:
            pivot, r = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ring = np.array([np.searchsorted(edges[p], v, side="left") for p, v in zip(pivot.tolist(), r.tolist(), strict=True)], np.int64)
            number = pivot * annuli + np.minimum(ring, annuli - 1)
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j == i:
                    continue
                if held and (number[i] != now or n >= most_rows):
                    yield from made(now, held)
                    held, n = [], 0
                now = int(number[i])
                held.append(batch.slice(i, j - i))
                n += j - i
        if held:
            yield from made(now, held)

    return run


def _visits(centres: np.ndarray, annuli: Annuli, dimensions: int, kind: str, first: int, last: int):
    """Packets of queries for the annuli from place `first` to `last` in each query's order whose bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKET):
                part = batch.slice(at, PACKET)
                q = matrix(part.column(1), dimensions)
                floor = part.column(2).fill_null(np.iinfo(np.int64).min).to_numpy()
                bound = score_bounds(q.astype(np.float64), centres, annuli)
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                wanted = np.take_along_axis(bound, order, axis=1) >= floor[:, None]
                row, place = np.nonzero(wanted)
                at_annulus = order[row, place]
                by = np.lexsort((row, at_annulus))
                row, at_annulus = row[by], at_annulus[by]
                packed = q.astype(kind)
                for k in np.split(np.arange(len(row)), np.flatnonzero(np.diff(at_annulus)) + 1):
                    if len(k):
                        own = row[k]
                        ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part.column(0).take(pa.array(own)))
                        columns = [pa.array([annuli.number[at_annulus[k[0]]]], pa.int32()), ids, pa.array([packed[own].tobytes()], pa.binary()), pa.array([floor[own].tobytes()], pa.binary())]
                        yield pa.record_batch(columns, names=["annulus", "asking", "q", "floors"])

    return run


def _score(dimensions: int, kind: str, k: int):
    """The k best of each chunk for the queries of each packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                asking, ids = batch.column(0)[at].values, batch.column(3)[at].values
                q = np.frombuffer(batch.column(1)[at].as_buffer(), kind).reshape(-1, dimensions)
                floor = np.frombuffer(batch.column(2)[at].as_buffer(), np.int64)
                c = np.frombuffer(batch.column(4)[at].as_buffer(), kind).reshape(-1, dimensions)
                scores = inner_products(q, c)
                allowed = np.ones(scores.shape, bool)
                places = pd.Index(ids.to_pandas()).get_indexer_non_unique(asking.to_pandas())[0]
                if (places >= 0).any():
                    known = {v: i for i, v in enumerate(asking.to_pylist())}
                    own = ids.to_pylist()
                    for p in set(places[places >= 0].tolist()):
                        allowed[known[own[p]], p] = False
                row, column = best_of(scores, allowed, floor, k)
                columns = [asking.take(pa.array(row)), ids.take(pa.array(column)), pa.array(scores[row, column], pa.int64())]
                yield pa.record_batch(columns, names=["query_id", "vec_id", "score"])

    return run


def _pivots_of(table: DataFrame, dimensions: int, n: int) -> np.ndarray:
    """Pivots fitted on the SAMPLE rows of least hash."""
    rows = table.select("x", F.xxhash64(F.col("id").cast("string"), "x").alias("h")).orderBy("h", "x").limit(SAMPLE).collect()
    sample = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<i8").reshape(-1, dimensions)
    return fit_pivots(sample, int(max(1, min(PIVOTS, np.sqrt(n) / 8))))


def build_index(scratch: Scratch, table: DataFrame, dimensions: int, kind: str) -> tuple[DataFrame, np.ndarray, Annuli]:
    """(chunks, pivots, annuli) of table(id, x)."""
    n = table.count()
    centres = _pivots_of(table, dimensions, n)
    id_kind = table.schema["id"].dataType.simpleString()
    keyed = scratch.save(table.select("id", "x").mapInArrow(_key(centres, dimensions, kind), f"id {id_kind}, x binary, pivot int, r double"), "keyed")
    rings = int(max(1, min(ANNULI, n // (len(centres) * ANNULUS_ROWS))))
    shares = [i / rings for i in range(1, rings)]
    found = keyed.groupBy("pivot").agg(F.percentile_approx("r", shares, 2000).alias("e") if shares else F.array().cast("array<double>").alias("e")).collect()  # a row a pivot
    edges = {r["pivot"]: list(r["e"]) for r in found}
    most_rows = max(16, min(1024, CHUNK_BYTES // (dimensions * np.dtype(kind).itemsize)))
    parts = max(1, min(20_000, -(-n * dimensions * np.dtype(kind).itemsize // (1 << 24))))
    spread = keyed.repartitionByRange(max(parts, 12), "pivot", "r", "id").sortWithinPartitions("pivot", "r")
    chunks = scratch.save(spread.mapInArrow(_chunks(edges, rings, dimensions, kind, most_rows), f"annulus int, least double, most double, square double, ids array<{id_kind}>, data binary"), "chunks")
    known = chunks.groupBy("annulus").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("square").alias("square")).orderBy("annulus").collect()  # at most PIVOTS * ANNULI
    number = np.array([r["annulus"] for r in known], np.int64)
    return chunks, centres, Annuli(number, number // rings, *[np.array([r[c] for r in known]) for c in ("least", "most", "square")])


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of queries the k rows of vectors with the largest inner products."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "search")
    id_kind = vectors.schema[key].dataType.simpleString()
    table, dimensions, most = save_common(scratch, whole_vectors(vectors.where(vectors[key].isNotNull()), key, vector, scale), "whole")
    schema = f"query_id {id_kind}, rank int, vec_id {id_kind}, score long"
    asked = scratch.save(whole_vectors(queries.where(queries[key].isNotNull()), key, vector, scale).where(F.col("k") == dimensions), "asked")
    largest = asked.agg(F.max("most")).first()[0]
    if not dimensions or largest is None:
        return spark.createDataFrame([], schema)
    kind = next(c for c in ("<i2", "<i4", "<i8") if max(most, largest) <= np.iinfo(c).max)
    chunks, centres, annuli = build_index(scratch, table, dimensions, kind)
    asked = scratch.save(asked.groupBy("id").agg(F.min("x").alias("x")), "queries")
    best, first, last, turn = None, 0, FIRST, 0
    records = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    while first < len(annuli.number):
        floor = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor")) if best is not None else None
        ready = asked.join(floor, F.col("id") == F.col("query_id"), "left") if best is not None else asked.withColumn("floor", F.lit(None).cast("long"))
        plan = _visits(centres, annuli, dimensions, kind, first, last)
        packets = scratch.save(ready.select("id", "x", "floor").mapInArrow(plan, f"annulus int, asking array<{id_kind}>, q binary, floors binary"), f"packets{turn}")
        if packets.isEmpty():
            break
        met = packets.join(chunks.select("annulus", "ids", "data"), "annulus").select("asking", "q", "floors", "ids", "data")
        found = met.mapInArrow(_score(dimensions, kind, k), f"query_id {id_kind}, vec_id {id_kind}, score long")
        found = found.unionByName(best.select("query_id", "vec_id", "score")) if best is not None else found
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 32)  # a row holds a chunk and a packet
        try:
            best = scratch.save(_best(found, k), f"best{turn}")
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        scratch.drop(f"packets{turn}", *([f"best{turn - 1}"] if turn else []))
        first, last, turn = last, last * GROWTH, turn + 1
    scratch.drop("keyed", "chunks", "whole", "asked")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
