"""Whitening of embeddings with exact cross-products from bit slices.

Entries become whole numbers x = floor(scale * entry) + shift.  The scatter matrix is
counted instead of multiplied: each dimension, less its least value, is cut into bit
planes; a plane packs one bit of 64 rows into a word; and the sum of products of two
dimensions is the sum over pairs of their planes of 2**(a + b) * popcount(plane_a AND
plane_b).  Every task adds whole numbers of its own rows and sends a row for each
pair of dimensions, Spark adds those, and the driver centres them as whole numbers of
any length, n * sum(xy) - sum(x) * sum(y), before it takes the eigenvectors.  So the
covariance is exact up to its one rounding to double, for any number and order of rows.

What reaches the driver grows with the square of the dimensions and not with the rows.

Defined results: vectors that are null or empty, hold null or non-finite entries or are
not as long as most (see `vectors`) take no part and have no rows; repeated rows and null
ids count as rows of their own; entries beyond 2**62 stop there; `deviation` is null where
it leaves 64 bits; `whitened` is null for components whose eigenvalue is no more than 1e-12
of the first (all rows equal, or more components than independent dimensions), which
`identity_error` leaves out; a table without usable vectors gives no rows; further columns
are ignored by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .vectors import matrix, save_common, whole_vectors

COMPONENTS = 8
_LIMB = 20  # planes of a dimension whose products, over a batch of rows, stay below 2**63
_ROWS = 1 << 16
_LOW = (1 << 32) - 1
_LEAST = 1e-12


class Model(NamedTuple):
    """n, sums and eigenvalues of the fit list; axes has a component in each column."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    widest: int  # of the ranges of the dimensions


def _halves(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return total >> 32, total & _LOW


def _ranges(dimensions: int):
    """Of each dimension the rows, their sum in two halves, least and largest value: a row a task and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64)
        least, most = np.full(dimensions, np.iinfo(np.int64).max), np.full(dimensions, np.iinfo(np.int64).min)
        for batch in batches:
            x = matrix(batch.column(0), dimensions)
            if not len(x):
                continue
            n += len(x)
            for part, total in zip(_halves(x), (high, low), strict=True):
                total += part.sum(axis=0)
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            columns = [np.arange(dimensions), np.full(dimensions, n), high, low, least, most]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["d", "n", "high", "low", "least", "most"])

    return run


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """uint64[planes, words]: the planes of each dimension of y, the lowest first, a bit for each row; `bits` has their numbers."""
    rows = -(-len(y) // 64) * 64
    planes = np.zeros((sum(bits), rows // 8), np.uint8)
    at = 0
    for d, n in enumerate(bits):
        column = np.ascontiguousarray(y[:, d]).astype(np.uint64)
        for b in range(n):
            packed = np.packbits(((column >> np.uint64(b)) & np.uint64(1)).astype(bool))
            planes[at, : len(packed)] = packed
            at += 1
    return planes.view(np.uint64)


def plane_products(planes: np.ndarray, group: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """int64[groups, groups], upper triangle: sums of weight * weight * popcount(AND) of the planes of two groups; group ascends."""
    out = np.zeros((groups, groups), np.int64)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    for p in range(len(planes)):
        counts = np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)
        value = counts * weight[p:] * weight[p]
        own = group[p:] == group[p]
        own[0] = False
        value[own] *= 2  # a pair of planes of one group stands for both orders
        begins = np.concatenate([[p], first[first > p]])
        out[group[p], group[begins]] += np.add.reduceat(value, begins - p)
    return out


def _scatter(least: list[int], bits: list[int]):
    """Sums of products of all pairs of dimensions over a task's rows, by power of 2**20, in two halves."""
    dimensions = len(least)
    limbs = -(-max([1, *bits]) // _LIMB)
    spans = [(limb, d, min(_LIMB, n - limb * _LIMB)) for limb in range(limbs) for d, n in enumerate(bits) if n > limb * _LIMB]
    group = np.repeat([limb * dimensions + d for limb, d, _ in spans], [n for *_, n in spans]).astype(np.int64)
    weight = np.concatenate([1 << np.arange(n) for *_, n in spans] or [np.zeros(0)]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = limbs * dimensions
        high, low = np.zeros((groups, groups), np.int64), np.zeros((groups, groups), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = matrix(batch.column(0).slice(at, _ROWS), dimensions)
                y = x.astype(np.uint64) - np.array(least).astype(np.uint64)  # modulo 2**64, where the difference fits
                sliced = [((y[:, d] >> np.uint64(limb * _LIMB)) & np.uint64((1 << _LIMB) - 1)) for limb, d, _ in spans]
                if not len(x) or not spans:
                    continue
                planes = bit_planes(np.stack(sliced, axis=1), [n for *_, n in spans])
                for part, total in zip(_halves(plane_products(planes, group, weight, groups)), (high, low), strict=True):
                    total += part
        one, two = np.nonzero((high != 0) | (low != 0))
        i, j = one % dimensions, two % dimensions
        twice = np.where((i == j) & (one != two), 2, 1)
        columns = [np.minimum(i, j), np.maximum(i, j), one // dimensions + two // dimensions, high[one, two] * twice, low[one, two] * twice]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["i", "j", "power", "high", "low"])

    return run


def exact_covariance(table: DataFrame, dimensions: int) -> tuple[int, list[int], list[list[int]], int]:
    """(n, sums, n * sum(xy) - sum(x) * sum(y) for all pairs, widest range) of table(x), all whole numbers."""
    ranges = table.select("x").mapInArrow(_ranges(dimensions), "d long, n long, high long, low long, least long, most long")
    sums_of = [F.sum(c).alias(c) for c in ("n", "high", "low")]
    found = ranges.groupBy("d").agg(*sums_of, F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect()  # a row a dimension
    if not found:
        return 0, [], [], 0
    n = found[0]["n"]
    sums = [(r["high"] << 32) + r["low"] for r in found]
    least, bits = [r["least"] for r in found], [(r["most"] - r["least"]).bit_length() for r in found]
    parts = table.select("x").mapInArrow(_scatter(least, bits), "i long, j long, power long, high long, low long")
    cells = parts.groupBy("i", "j", "power").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # a row a pair of dimensions
    shifted = [s - n * m for s, m in zip(sums, least, strict=True)]
    centred = [[-a * b for b in shifted] for a in shifted]
    for r in cells:
        value = n * (((r["high"] << 32) + r["low"]) << (_LIMB * r["power"]))
        centred[r["i"]][r["j"]] += value
        if r["i"] != r["j"]:
            centred[r["j"]][r["i"]] += value
    return n, sums, centred, max(r["most"] - r["least"] for r in found)


def fit(table: DataFrame, dimensions: int) -> Model:
    """Eigenvalues, falling, and unit eigenvectors of the covariance (divisor n) of table(x)."""
    n, sums, centred, widest = exact_covariance(table, dimensions)
    if not n:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0)
    covariance = np.array([[v / (n * n) for v in row] for row in centred])  # whole numbers divided with one rounding
    values, axes = np.linalg.eigh(covariance)
    return Model(n, sums, values[::-1].copy(), axes[:, ::-1].copy(), float(np.trace(covariance)), widest)


def _centred(x: np.ndarray, model: Model) -> tuple[np.ndarray, list[int | None]]:
    """(x less its mean, the exact sums of squares of n * x - sum) of each row."""
    if model.n * model.widest < 1 << 62 and max(map(abs, model.sums)) < 1 << 62:
        moved = x * model.n - np.array(model.sums)
        if len(model.sums) * (model.n * model.widest) ** 2 < 1 << 63:
            return moved / model.n, (moved * moved).sum(axis=1).tolist()
    moved = x.astype(object) * model.n - np.array(model.sums, object)
    squares = [int(v) for v in (moved * moved).sum(axis=1)]
    return (moved / model.n).astype(np.float64), [v if v < 1 << 63 else None for v in squares]


def _whiten(x: np.ndarray, model: Model, components: int) -> tuple[np.ndarray, list[int | None]]:
    z, squares = _centred(x, model)
    return z @ model.axes[:, :components] / np.sqrt(model.values[:components]), squares


def _moments(model: Model, components: int):
    """Sums and sums of products of whitened components over a task's rows; the mean has the number -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            w, _ = _whiten(matrix(batch.column(0), len(model.sums)), model, components)
            sums += w.sum(axis=0)
            products += w.T @ w
        i, j = np.indices((components, components)).reshape(2, -1)
        columns = [np.concatenate([i, np.arange(components)]), np.concatenate([j, np.full(components, -1)])]
        values = np.concatenate([products.reshape(-1), sums])
        yield pa.record_batch([*[pa.array(c, pa.int32()) for c in columns], pa.array(values)], names=["i", "j", "v"])

    return run


def identity_error(table: DataFrame, model: Model, components: int) -> float:
    """The largest absolute entry of the whitened components' covariance less the identity."""
    rows = table.select("x").mapInArrow(_moments(model, components), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    found = {(r["i"], r["j"]): r["v"] / model.n for r in rows}  # components squared
    pairs = [(i, j) for i in range(components) for j in range(components)]
    return max((abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i, j in pairs), default=0.0)


def _rows(model: Model, usable: int, components: int, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            w, squares = _whiten(matrix(batch.column(1), len(model.sums)), model, usable)
            each = np.repeat(np.arange(n), components)
            whole = np.full((n, components), np.nan)
            whole[:, :usable] = w
            deviation = pa.array(squares, pa.int64()).take(pa.array(each))
            share = np.tile(model.values[:components] / model.trace if model.trace > 0 else np.zeros(components), n)
            columns = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, components + 1), n), pa.int32()), pa.array(np.full(n * components, model.n), pa.int64()),
                deviation, pa.array(whole.reshape(-1), from_pandas=True), pa.array(share), pa.array(np.full(n * components, error)),
            ]
            yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = 1024, shift: int = 100_000) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    schema = f"vec_id {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    table, dimensions, _ = save_common(scratch, whole_vectors(vectors, key, vector, scale, shift), "whole")
    if not dimensions:
        return spark.createDataFrame([], schema)
    model = fit(table, dimensions)
    wanted = min(components, dimensions)
    usable = int((model.values[:wanted] > max(0.0, _LEAST * model.values[0])).sum())
    error = identity_error(table, model, usable) if usable else 0.0
    return table.select("id", "x").mapInArrow(_rows(model, usable, wanted, error), schema)
