"""Picks of the block bootstrap: made in blocks of paths that spread over tasks, with no sort of their steps."""

import zlib

import pytest
from pyspark.sql import functions as F

from quantloom.operators import resample as rs
from quantloom.plans import all_queries


def _draw(seed, *parts):
    h = seed
    for p in parts:
        h = (h * 1103515245 + p * 12345 + 1013904223) % 2147483647 * 48271 % 2147483647
    return h


def _picks(symbol, n, path, horizon, block):
    salt, at, out = zlib.crc32(symbol.encode()), 0, []
    for step in range(horizon):
        at = _draw(11, salt, path, step, 2) % n if step == 0 or _draw(11, salt, path, step, 1) % block == 0 else (at + 1) % n
        out.append(at)
    return out


def test_each_pick_is_that_of_its_path(spark):
    sizes = {"A": 756, "Ö": 3, "": 1}
    found = rs.block_bootstrap(spark.createDataFrame([*sizes.items()], "symbol string, n bigint"), 130, 40, block=5)
    assert found.dtypes == [("symbol", "string"), ("path", "int"), ("step", "int"), ("pick", "bigint")]
    got = {(r["symbol"], r["path"], r["step"]): r["pick"] for r in found.collect()}
    assert got == {(s, path, step): x for s, n in sizes.items() for path in range(130) for step, x in enumerate(_picks(s, n, path, 40, 5))}


def test_no_symbol_and_no_rows_have_null_picks(spark):
    sizes = spark.createDataFrame([(None, 5), ("none", None), ("A", 5)], "symbol string, n bigint")
    counts = rs.block_bootstrap(sizes, 3, 7).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count("pick").alias("found"))
    assert {r["symbol"]: (r["rows"], r["found"]) for r in counts.collect()} == {None: (21, 0), "none": (21, 0), "A": (21, 21)}


@pytest.mark.parametrize("name", ["r1_block_bootstrap", "r1_block_bootstrap_full"])
def test_steps_are_not_sorted_and_spread_over_tasks(spark, sf, name):
    picks = all_queries()[0][name](spark, sf)
    plan = picks._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Generate")]  # above the rows of steps, where a window would sort and spill them
    tasks = picks.select(F.spark_partition_id().alias("task"), "symbol").groupBy("task").count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == picks.select("symbol").distinct().count() * 2000 * 252
