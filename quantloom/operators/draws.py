"""Resampling in blocks of draws over one array a key.

The values that draws pick from are gathered once for each key: a few hundred returns, or the
trades of one strategy.  Each key is dealt out once for every block of draws, so keys and
blocks spread over the cluster, and a task picks all draws of a block from the array at once.
No row is made for a draw and place, and none is shuffled to its value.  Results that need
all draws of a key (`whole`) come from one task a key, and no draw is sent at all.  A draw is a function
of (seed, parts), the same as `validation.draw` in column form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 100  # draws of one key that a task makes together


def uniform(seed: int | np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """Numbers below 2**31 - 1 from the parts alone: two rounds of a 31-bit congruential step for each. A result is the seed of further parts."""
    h = np.int64(seed)
    for p in parts:
        h = (h * np.int64(1103515245) + np.asarray(p, np.int64) * np.int64(12345) + np.int64(1013904223)) % np.int64(2147483647) * np.int64(48271) % np.int64(2147483647)
    return h


def gathered(rows: DataFrame, keys: list[str], order: list[str], value: str, *more: Column) -> DataFrame:
    """(keys, …more aggregates, values): the values of each key in order, for keys whose rows are bounded by the number of bars."""
    cells = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_value"))))
    return rows.groupBy(*keys).agg(*more, cells.alias("_c")).withColumn("values", F.transform("_c", lambda x: x["_value"])).drop("_c")


def _tasks(spark: SparkSession) -> int:
    """A given number, as adaptive execution would put these few bytes, but much work, into one task."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_blocks(arrays: DataFrame, keys: list[str], n_draws: int, first: int, salt: Column, numbers: list[Column], make: Callable[[np.ndarray, np.ndarray, int, tuple], list[np.ndarray]], out: str) -> DataFrame:
    """(keys, draw, what `make` returns) for arrays(keys, values, …).

    make(values, draws, salt, numbers) returns columns with an entry for each draw of a block; an entry of two dimensions
    becomes an array.  `out` is the schema of those columns.
    """
    starts = F.sequence(F.lit(first), F.lit(first + n_draws - 1), F.lit(BLOCK))
    rows = arrays.select(*keys, "values", salt.cast("long").alias("_salt"), F.array(*[c.cast("double") for c in numbers]).alias("_numbers"), F.explode(starts).alias("_first"))
    rows = rows.repartition(_tasks(arrays.sparkSession), *keys, "_first")
    names = [x.split()[0] for x in out.split(", ")]
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = batch.column(n_keys)[k].values.to_numpy(zero_copy_only=False)
                salt_of, given, at = (batch.column(n_keys + i)[k].as_py() for i in (1, 2, 3))
                draws = np.arange(at, min(at + BLOCK, first + n_draws))
                found = make(values, draws, salt_of, tuple(given))
                own = [batch.column(i).take(pa.array([k] * len(draws))) for i in range(n_keys)]
                made = [pa.array(x) if x.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1))) for x in found]
                yield pa.record_batch([*own, pa.array(draws, pa.int32()), *made], names=[*keys, "draw", *names])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, draw int, {out}")


def whole(arrays: DataFrame, keys: list[str], salt: Column, numbers: list[Column], make: Callable[[np.ndarray, int, tuple], list[np.ndarray]], out: str) -> DataFrame:
    """(keys, what `make` returns) for arrays(keys, values, …): all draws of a key in one task, for results that need them together.

    make(values, salt, numbers) returns columns of one length, with NaN for null; numbers that are null come as None.
    """
    rows = arrays.select(*keys, "values", salt.cast("long").alias("_salt"), F.array(*[c.cast("double") for c in numbers]).alias("_numbers"))
    rows = rows.repartition(_tasks(arrays.sparkSession), *keys)
    names = [x.split()[0] for x in out.split(", ")]
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = batch.column(n_keys)[k].values.to_numpy(zero_copy_only=False)
                found = make(values, batch.column(n_keys + 1)[k].as_py(), tuple(batch.column(n_keys + 2)[k].as_py()))
                own = [batch.column(i).take(pa.array([k] * len(found[0]))) for i in range(n_keys)]
                yield pa.record_batch([*own, *[pa.array(x, from_pandas=True) for x in found]], names=[*keys, *names])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, {out}")


def block_picks(n: int, draws: np.ndarray, steps: int, block: int, seed: int, salt: int) -> np.ndarray:
    """int64[draws, steps]: places that go on by one, round the end, and start anew with chance 1 / block."""
    step = np.arange(steps)
    h = uniform(seed, salt, draws[:, None], step[None, :])
    anew = uniform(h, 1) % block == 0
    anew[:, 0] = True
    at = np.flatnonzero(anew)
    # Only the steps that start anew draw a place; the others keep their distance to it.
    start = uniform(h.reshape(-1)[at], 2) % n - at % steps
    return (np.repeat(start, np.diff(np.append(at, h.size))).reshape(h.shape) + step) % n
