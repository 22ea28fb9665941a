"""Ranks and as-of joins of hot keys, the kept panels, and cards of stored runs."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import asof as j
from quantloom.operators import ranks
from quantloom.operators import tuning as tu
from quantloom.plans import backtest as bt
from quantloom.plans.registry import Panels
from quantloom.session import release, written
from quantloom.sources import store

DAY = dt.date(2020, 1, 1)


def _average_ranks(values):
    order = sorted(v for v in values if v is not None)
    low, high = {v: i for i, v in reversed(list(enumerate(order, 1)))}, {v: i for i, v in enumerate(order, 1)}
    return [None if v is None else (low[v] + high[v]) / 2 for v in values]


def test_average_ranks_with_ties_nulls_and_several_keys(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.choice([None, 1.5, 2.0, rng.random(), rng.random()]), float(rng.randrange(5))) for k in range(2000)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double")
    got = {r["id"]: (r["rx"], r["ry"]) for r in ranks.with_average_ranks(df, ["g"], {"x": "rx", "y": "ry"}, ranges=7).collect()}
    for g in "ab":
        own = [r for r in rows if r[1] == g]
        for r, x, y in zip(own, _average_ranks([r[2] for r in own]), _average_ranks([r[3] for r in own]), strict=True):
            assert got[r[0]] == (x, y)
    assert len(got) == len(rows) and not ranks.with_average_ranks(df.limit(0), ["g"], {"x": "rx"}).count()


def test_ranks_of_one_key_fill_all_ranges(spark):
    """A key that holds 98 % of a million rows is dealt out evenly, and the ranks are those of sorting."""
    n, parts = 1_000_000, 16
    df = spark.range(n).select("id", F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("g"), (F.xxhash64("id") % 800_000).cast("double").alias("x"))
    ranked = written(ranks.value_ranks(df, ["g"], ["x"], parts), "ranked")
    x = df.where("g = 'hot'").select("x").toPandas()["x"].to_numpy()
    values, first, counts = np.unique(x, return_index=True, return_counts=True)
    got = ranked.where("g = 'hot'").orderBy("_v").select("_v", "_rank").toPandas()
    assert np.array_equal(got["_v"], values) and np.array_equal(got["_rank"], np.cumsum(counts) - (counts - 1) / 2)
    spread = df.groupBy("g", "x").count().repartitionByRange(parts, "g", "x").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(spread) == parts and max(r["count"] for r in spread) < 2 * min(r["count"] for r in spread if r["count"])


def test_dates_split_at_a_sample_count(spark):
    rng = random.Random(2)
    rows = [(h, DAY + dt.timedelta(days=rng.randrange(30))) for h in ("short", "mid") for _ in range(777)]
    got = tu.split_by_date(spark.createDataFrame(rows, "horizon string, date date")).collect()
    for h in ("short", "mid"):
        dates = sorted(d for k, d in rows if k == h)
        assert {r["cut"] for r in got if r["horizon"] == h} == {dates[int(777 * 0.7)]}
        assert sum(r["is_test"] for r in got if r["horizon"] == h) == sum(d >= dates[int(777 * 0.7)] for d in dates)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_of_a_hot_symbol_by_slices(spark, forward):
    """Nine tenths of the rows have one symbol; gaps of more than a slice, dates before and after all prices, nulls."""
    rng = random.Random(4)
    left = [(k, "H" if rng.random() < 0.9 else rng.choice(["A", "B", None]), None if k == 5 else DAY + dt.timedelta(days=rng.randrange(900))) for k in range(4000)]
    right = [(s, DAY + dt.timedelta(days=d), None if d % 9 == 0 else float(d)) for s in ("H", "A") for d in sorted(rng.sample(range(100, 800), 60))]
    out = j.asof(spark.createDataFrame(left, "id int, symbol string, date date"), spark.createDataFrame(right, "symbol string, date date, v double"), ["symbol"], "date", "v", forward=forward, days=8)
    got = {r["id"]: r["v"] for r in out.collect()}
    for k, s, d in left:
        known = sorted((e, v) for t, e, v in right if t == s and v is not None and d is not None and (e >= d if forward else e <= d))
        assert got[k] == (None if not known else known[0 if forward else -1][1])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window " in line]
    assert windows and all("_slice" in w for w in windows)  # no window takes all rows of a symbol


def test_cards_of_a_run(spark):
    card = lambda k, s, c=0.5, a=True: {"key": k, "available": a, "score": s, "confidence": c}
    results = [
        {"modules": [card("technical", 0.4), card("mood", -1.0, 0.12345), card("analogs", 1.0)], "analogs": {"mid": {"available": True, "score": 0.2, "confidence": 1}}},
        {"modules": [card("a", 0.4), card("a", 0.8), card("b", None), card("c", 1.0, a=False), {"key": None, "available": True, "score": 1, "confidence": 1}]},
        {"modules": [], "analogs": {"mid": {"available": False, "score": 1, "confidence": 1}}},
        {},
    ]
    rows = [(k, json.dumps(x)) for k, x in enumerate(results)] + [(4, "not json"), (5, None), (6, '{"modules": 3}')]
    got = {r["id"]: r["x"] for r in spark.createDataFrame(rows, "id int, r string").select("id", tu.card_signals(F.col("r"), F.lit("mid")).alias("x")).collect()}
    assert got == {0: {"technical": 0.2, "mood": -0.1235, "analogs": 0.2}, 1: {"a": 0.4}, 2: {}, 3: {}, 4: {}, 5: {}, 6: {}}


def test_panels_are_built_once_for_an_input(spark, sf, tmp_path, monkeypatch):
    import shutil

    built = []
    one = bt.module_rows
    monkeypatch.setattr(bt, "module_rows", lambda *a: built.append(1) or one(*a))
    for name in ("lineitem",):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    folder = str(tmp_path)
    first = Panels(spark, folder).samples
    again = Panels(spark, folder).samples
    assert len(built) == 1 and sorted(first.drop("x").collect()) == sorted(again.drop("x").collect())
    plan = Panels(spark, folder).stored_bars.groupBy("symbol").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # bucketed by symbol
    shutil.copy(f"{sf}/lineitem.parquet", tmp_path / "lineitem.parquet")  # a later time is another input
    assert Panels(spark, folder).samples.count() == first.count() and len(built) == 2
    assert store.drop_old(spark, keep=1) and Panels(spark, folder).samples.count() > 0 and len(built) == 2


def test_written_tables_go_when_told(spark):
    import glob

    path = written(spark.range(5), "some").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert glob.glob(f"{path}/*.parquet") and release(spark) >= 1 and not glob.glob(f"{path}*") and release(spark) == 0
