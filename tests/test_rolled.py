"""Rolling figures made beside the smoothing against window functions, and the plan of the signals."""

import datetime as dt
import re

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators import indicators as ind
from quantloom.operators import smooth
from quantloom.operators import strategies as st
from quantloom.plans import backtest as bt
from quantloom.plans.registry import Panels
from quantloom.sources import fixtures as fx
from quantloom.sources.fixtures import render


def test_rolled_columns_are_those_of_windows(spark):
    rng = np.random.default_rng(7)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=k), *[None if k % 97 == 41 else float(x) for x in rng.uniform(90, 110, 3)]) for s, n in (("A", 400), ("B", 7)) for k in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double").withColumn("obv", F.col("close") * 3)
    names = ["sma5", "sma50", "obv_sma10", "sd20", "high_before20", "low_before10"]
    high, low = ind.donchian(20, 10)
    sd = (ind.bollinger("close")[1] - ind.bollinger("close")[0]) / 2
    want = bars.select("symbol", "date", ind.sma("close", 5).alias("sma5"), ind.sma("close", 50).alias("sma50"), ind.sma("obv", 10).alias("obv_sma10"), sd.alias("sd20"), high.alias("high_before20"), low.alias("low_before10"))
    a, b = (x.orderBy("symbol", "date").select(names).toPandas().to_numpy(float) for x in (smooth.with_smoothed(bars.repartition(5), names), want))
    assert len(a) == 407 and np.isfinite(a).sum(axis=0).min() > 50 and np.allclose(a, b, rtol=1e-12, atol=1e-10, equal_nan=True)


def test_signals_take_no_frame_of_many_bars(spark, sf):
    plan = st.wide_signals(Panels(spark, sf).bars)._jdf.queryExecution().executedPlan().toString()
    frames = re.findall(r"RowFrame, -(\d+), (-?\d+|currentrow)", plan)
    assert all(f"-{a}" == b for a, b in frames)  # lags only
    assert plan.count(" Sort [symbol") <= 3 and "_chunk" not in plan


def test_bars_keep_two_rows_a_group(spark, sf):
    """The least and the greatest row of a symbol and day give all four columns: no aggregate for each of them."""
    plan = Panels(spark, sf).bars._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "max_by" not in plan and max(line.count("partial_max(") for line in plan.split("\n")) == 1


def test_volatility_is_that_of_a_window_over_known_returns(spark):
    rng = np.random.default_rng(3)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=k), None if k % hole == hole - 1 else float(rng.uniform(90, 110))) for s, n, hole in (("A", 700, 89), ("B", 300, 2), ("C", 40, 9)) for k in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    r = bars.select("*", ind.change("close").alias("r"))
    want = r.select("symbol", "date", F.when(ind.bar_index() >= 251, F.stddev_samp("r").over(ind.last(252))).alias("vol252"))
    a, b = (x.orderBy("symbol", "date").select("vol252").toPandas().to_numpy(float) for x in (smooth.with_smoothed(bars, ["vol252"]), want))
    assert len(a) == 1040 and np.isfinite(a).sum() == 449 and np.allclose(a, b, rtol=1e-12, equal_nan=True)


def test_module_rows_take_no_frame_of_many_bars(spark, sf):
    """A window takes a step for each bar of its frame: what is read of a symbol's bars comes from the smoothing pass, and sample dates are written before they are joined."""
    t = Panels(spark, sf)
    plan = bt.module_rows(t.smoothed, t.stored_series, t.sectors)._jdf.queryExecution().executedPlan().toString()
    assert "stddev_samp" not in plan.replace("stddev_samp(fwd_", "") and re.search(r"FileScan parquet \[symbol[^\]]*beta", plan)
    assert not re.search(r"\[symbol#\d+\], \[date#\d+ ASC NULLS FIRST\], RowFrame, -\d{2,}, currentrow", plan)


def test_series_and_sectors_sort_no_rows_of_lines(spark, sf):
    t = Panels(spark, sf)
    for panel in (t.series, t.sectors):
        plan = panel._jdf.queryExecution().executedPlan().toString().split("\n")
        read = [k for k, line in enumerate(plan) if "FileScan" in line]
        above = [next(line for line in reversed(plan[:k]) if "Project" not in line and "ColumnarToRow" not in line and "Filter" not in line) for k in read]
        assert above and all("HashAggregate" in line or "BroadcastHashJoin" in line for line in above)


def test_days_of_lines_without_an_order(spark, tmp_path):
    """Missing orders stand before all others and alone on a day; equal orders are told apart by the rest of the key."""
    day = lambda d: dt.date(2000, 1, d)
    rows = [(None, 1, 1, 1, 1.0, 1.0, 0.01, 0.0, day(1)), (5, 2, 1, 1, 1.0, 1.0, 0.02, 0.0, day(1)), (5, 1, 1, 1, 1.0, 1.0, 0.03, 0.0, day(1)), (None, 2, 1, 1, 1.0, 1.0, 0.04, 0.0, day(2)),
            (None, 1, 1, 1, 1.0, 1.0, 0.05, 0.0, day(2)), (7, 1, 1, 1, 1.0, 1.0, 0.06, 0.0, day(3)), (7, 1, 1, 1, 1.0, 2.0, 0.07, 0.0, day(3)), (8, 1, 1, 1, 1.0, 2.0, 0.08, 0.0, None)]
    names = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"
    lines = spark.createDataFrame(rows, names)
    got = spark.sql(render(fx._days(True), True).replace("FROM lineitem", "FROM {lines}"), lines=lines).select("date", "d0", "d1").collect()
    assert {tuple(r) for r in got} == {(day(1), 0.01, 0.02), (day(2), 0.05, 0.04), (day(3), 0.06, 0.07), (None, 0.08, 0.08)}


def test_rows_are_dealt_out_before_days_are_made_of_them(spark, sf):
    """Few rows share a symbol and day: a grouping before the exchange sorts all rows and leaves nearly as many, and so does a sort by texts."""
    plan = Panels(spark, sf).bars._jdf.queryExecution().executedPlan().toString().split("\n")
    grouped = max(k for k, line in enumerate(plan) if "SortAggregate" in line)
    below = "\n".join(plan[grouped:])
    assert below.index("Sort [place") < below.index("Exchange hashpartitioning(symbol") and "\n".join(plan).count("hashpartitioning(symbol") == 2


def test_days_of_symbols_with_equal_orders_and_holes(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(5)
    pick = lambda *x: x[rng.integers(len(x))]
    day = lambda: pick(None, *[dt.date(2000, 1, d) for d in range(1, 6)])
    rows = [(int(rng.integers(4)), int(rng.integers(2)), k, pick(None, 1, 99, 100, 250), float(rng.integers(9)), 1.0, float(rng.integers(11)) / 100, float(rng.integers(9)) / 100, pick("A", "R"), pick("F", "O"), day()) for k in range(600)]
    names = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    lines = spark.createDataFrame(rows, names)
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = spark.sql(render("<BARS>", True).replace("FROM lineitem", "FROM {lines}"), lines=lines).collect()
    assert {tuple(r) for r in got} == set(con.execute(render("<BARS>", False)).fetchall()) and len(got) > 50


def test_numbers_to_four_places_are_those_of_decimals(spark):
    rng = np.random.default_rng(6)
    xs = [*(float(x) for x in rng.normal(0, 10.0 ** rng.integers(-5, 12, 3000))), *(k / 20000 for k in range(-999, 999, 2)), 1.00005, 0.00015, 123456.78905, -2.00005, 0.0, -0.0, 1e13, None]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("CAST(x AS DECIMAL(18,4)) AS a", f"CAST({fx._SCALED.format(x='x')} * 0.0001 AS DECIMAL(18,4)) AS b")
    assert rows.where("NOT a <=> b").count() == 0 and "AS BIGINT) ELSE" in fx._days(True)


def test_smoothed_rows_stay_in_their_buckets(spark, sf, tmp_path, monkeypatch):
    t = Panels(spark, sf)
    bars, dealt = t.stored_bars, []
    frame = type(bars)
    one = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(a) or one(self, *a))
    monkeypatch.setattr("quantloom.sources.store._code", lambda: str(tmp_path))  # another version, so it is built here
    t.stored_bars = bars
    rows = t.smoothed
    assert not dealt and "open" not in rows.columns and len(rows.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.count() == bars.count() and "Exchange" not in rows.groupBy("symbol").count()._jdf.queryExecution().executedPlan().toString()
