"""Tables of vectors as scaled whole numbers.

A vector takes part if it is neither null nor empty, all its entries are finite numbers,
and it has the length that most such vectors have (the longer of two equally frequent ones).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Scaled entries stop at +-2**62, so that they stay whole numbers of 64 bits.
_END = float(1 << 62)


def finite_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, starts, lengths, entries) of the lists that are not empty and hold finite numbers only."""
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    rows = np.flatnonzero((lengths > 0) & (bad[starts + lengths] == bad[starts]))
    return rows, starts, lengths, flat


def _scale(factor: float, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, lengths, flat = finite_rows(batch.column(1))
            whole = np.clip(np.floor(factor * np.where(np.isfinite(flat), flat, 0.0)), -_END, _END).astype("<i8") + offset
            parts = [whole[i : i + n] for i, n in zip(starts[rows], lengths[rows], strict=True)]
            most = pa.array([int(max(abs(int(p.min())), abs(int(p.max())))) for p in parts], pa.int64())
            columns = [batch.column(0).take(pa.array(rows)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(lengths[rows], pa.int32()), most]
            yield pa.record_batch(columns, names=["id", "x", "k", "most"])

    return run


def whole_vectors(rows: DataFrame, key: str, vector: str, factor: float, offset: int = 0) -> DataFrame:
    """(id, x, k, most): entries floor(factor * entry) + offset as little-endian 64-bit numbers, their number and largest size."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(rows[key].alias("id"), rows[vector].cast("array<double>").alias("x")).mapInArrow(_scale(factor, offset), f"id {kind}, x binary, k int, most long")


def save_common(scratch: Scratch, whole: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """(vectors of the most frequent length, that length, largest size of an entry); the length is 0 if there are none."""
    saved = scratch.save(whole, name)
    found = saved.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most")).orderBy(F.desc("n"), F.desc("k")).first()
    k, most = (found["k"], found["most"]) if found else (0, 0)
    return saved.where(F.col("k") == k), k, most


def matrix(blobs: pa.Array, dimensions: int, kind: str = "<i8") -> np.ndarray:
    """The vectors of a column of equally long binaries, a row each."""
    return np.frombuffer(b"".join(x.as_buffer() for x in blobs), kind).reshape(-1, dimensions)
