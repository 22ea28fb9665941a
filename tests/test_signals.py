"""Hand-computed cases and invariants of the signal engine."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars as sc
from quantloom.operators import accounting as acc
from quantloom.operators import indicators as ind
from quantloom.operators import metrics as met
from quantloom.operators import smooth
from quantloom.operators import strategies as st
from quantloom.operators import textqa as qa
from quantloom.operators import validation as va
from quantloom.plans import backtest as bt
from quantloom.plans.registry import Panels


def _bars(spark, n=600, seed=5, symbol="T", scale=1.0):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.01, n)))
    close[n - 50 :] *= scale
    open_ = np.concatenate([[100], close[:-1]]) * np.exp(rng.normal(0, 0.002, n))
    days = pd.bdate_range("2018-01-01", periods=n)
    pdf = pd.DataFrame({"symbol": symbol, "date": days.date, "open": open_, "high": np.maximum(open_, close) * 1.004, "low": np.minimum(open_, close) * 0.996, "close": close, "volume": rng.integers(1000, 9000, n).astype(float)})
    return spark.createDataFrame(pdf, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_next_open_fill(spark):
    rows = [("A", dt.date(2020, 1, d), "s", 0, o, c, p) for d, o, c, p in ((1, 10.0, 10.0, 1.0), (2, 11.0, 12.0, 1.0), (3, 12.0, 12.0, 0.0), (6, 13.0, 13.0, 0.0))]
    sig = spark.createDataFrame(rows, "symbol string, date date, strategy string, variant int, open double, close double, value double")
    out = [r["ret"] for r in acc.position_returns(sig, fee=0.0, rate=0.0).orderBy("date").collect()]
    assert math.prod(1 + r for r in out) == pytest.approx(13 / 11)
    trade = acc.extract_trades(acc.position_returns(sig, 0.0, 0.0), 0.0).collect()
    assert [(t["entry_px"], t["exit_px"], t["days"], t["is_open"]) for t in trade] == [(11.0, 13.0, 2, False)]


def test_breakout_fill(spark):
    rows = [("A", dt.date(2020, 1, d), "b", 0, o, h, l, c, v) for d, o, h, l, c, v in ((1, 9.0, 9.5, 9.0, 9.2, None), (2, 9.5, 11.0, 9.0, 10.5, 10.0), (3, 11.0, 11.0, 10.0, 10.0, 99.0))]
    sig = spark.createDataFrame(rows, "symbol string, date date, strategy string, variant int, open double, high double, low double, close double, value double")
    trade = acc.breakout_trades(sig, 0.0).collect()
    assert [(t["entry_px"], t["exit_px"]) for t in trade] == [(10.0, 11.0)]
    total = math.prod(1 + r["ret"] for r in acc.breakout_returns(sig, 0.0, 0.0).collect())
    assert total == pytest.approx(11 / 10)


def test_smoothing_with_gaps(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    x = spark.createDataFrame([("A", day(k), v) for k, v in enumerate([None, 1.0, 2.0, None, 4.0])], "symbol string, date date, x double")
    got = smooth.smooth(x, [smooth.Smoothing("y", "x", 0.5, 1)]).orderBy("date").collect()
    assert [round(r["y"], 4) for r in got[1:]] == [1.0, 1.5, 1.5, 3.1667] and got[0]["y"] is None
    flat = spark.createDataFrame([("A", day(k), 5.0, 5.0, 5.0) for k in range(40)], "symbol string, date date, high double, low double, close double")
    assert smooth.with_smoothed(flat, ["rsi14"]).orderBy(F.col("date").desc()).first()["rsi14"] == 100.0


def test_signals_do_not_look_ahead(spark):
    bars = _bars(spark)
    cut = dt.date(2019, 11, 1)
    full = st.wide_signals(bars).where(F.col("date") <= cut).orderBy("date").toPandas()
    part = st.wide_signals(bars.where(F.col("date") <= cut)).orderBy("date").toPandas()
    for name in full.columns[7:]:
        assert np.allclose(full[name], part[name], equal_nan=True), name
    assert len(full.columns) - 7 == 30


def test_future_prices_leave_past_verdicts(spark, sf):
    t = Panels(spark, "/root/testdata/sf0.01")
    bars = t.bars.where("symbol = 'AF'").cache()
    last = bars.agg(F.max("date")).first()[0]
    late = F.col("date") > F.lit(last - dt.timedelta(days=400))
    other = bars.select("symbol", "date", *[F.when(late, F.col(c) * 3).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume")
    keys, old = ["symbol", "date", "horizon"], F.col("date") <= F.lit(last - dt.timedelta(days=400))
    a = bt.engine_samples(bars, t.series).where(old).orderBy(*keys).select(*keys, "verdict", "conf").toPandas()
    b = bt.engine_samples(other, t.series).where(old).orderBy(*keys).select(*keys, "verdict", "conf").toPandas()
    both = a.merge(b, on=keys)
    assert len(both) > 50 and (both.verdict_x == both.verdict_y).all() and (both.conf_x == both.conf_y).all()


def test_folds(spark):
    one = spark.range(2600).select(F.lit("L").alias("symbol"))
    two = spark.range(700).select(F.lit("M").alias("symbol"))
    none = spark.range(200).select(F.lit("S").alias("symbol"))
    rows = va.folds(one.union(two).union(none)).orderBy("symbol", "fold").collect()
    assert [r["symbol"] for r in rows] == ["L"] * 7 + ["M"]
    assert all(r["a"] - r["a0"] == 756 for r in rows[:-1]) and rows[-2]["b"] == 2600
    assert (rows[-1]["a0"], rows[-1]["a"], rows[-1]["b"]) == (140, 476, 700)


def test_summary_of_four_rows(spark):
    rows = [("short", "buy", 0.7, 0.05), ("short", "buy", 0.5, -0.01), ("short", "hold", 0.65, 0.02), ("short", "sell", 0.9, 0.01)]
    s = spark.createDataFrame(rows, "horizon string, verdict string, conf double, ret double")
    buy = bt.summarize_verdicts(s).where("verdict = 'buy'").first()
    assert (buy["n"], buy["hit"], buy["base"], round(buy["avg_ret"], 4)) == (2, 0.5, 0.25, 0.02)
    assert [r["n"] for r in bt.summarize_conf(s).orderBy("bin").collect()] == [1, 2, 1]


def test_probabilities_and_grades(spark):
    got = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.96)], "x double").select(va.normal_cdf("x").alias("p")).collect()
    assert [round(r["p"], 4) for r in got] == [0.1587, 0.5, 0.975]
    rows = [(0.01, 0.6, 20, 0.9), (0.08, 0.4, 9, 0.6), (0.2, 0.1, 6, None), (0.2, 0.0, 6, None), (None, 1.0, 50, 0.9)]
    out = va.graded(spark.createDataFrame(rows, "p double, oos_sharpe double, oos_trades int, dsr double")).collect()
    assert [r["grade"] for r in out] == ["A", "B", "C", "F", "F"]


def test_random_walk_rarely_passes_permutation(spark):
    bars = _bars(spark, 1500)
    held = acc.position_returns(st.stacked(st.wide_signals(bars, ["sma_cross"]), ["sma_cross"])).where("variant = 1")
    p = va.permutation_p(va.numbered(held).withColumn("fold", F.lit(0)), 50).first()["p"]
    assert 1 / 51 <= p <= 1


def test_text_checks(spark):
    row = spark.range(1).select(
        qa.grounded(F.lit("up 2.1 on 1,200 shares"), F.array(F.lit(2.13), F.lit(1200.0))).alias("a"), qa.grounded(F.lit("up 2.2"), F.array(F.lit(2.13))).alias("b"),
        qa.trigger_ok(F.lit("closes above $90"), F.lit(100.0)).alias("c"), qa.trigger_ok(F.lit("closes below $90, or rises above $1,110.5"), F.lit(100.0)).alias("d"),
        qa.tidy_sentences(F.lit("A sell verdict stands."), F.lit("buy")).alias("e"), sc.is_junk(F.lit("Shares sold by Oak Wealth LLC")).alias("f"), sc.is_junk(F.lit("Firm sells its stake in Acme")).alias("g"),
        sc.slot(F.expr("timestamp '2024-01-06 12:00:00'"), -1).cast("string").alias("h"), sc.slot(F.expr("timestamp '2024-01-05 22:00:00'"), 1).cast("string").alias("i"),
    ).first()
    assert [row[x] for x in "abcdefg"] == [True, False, False, True, "A sell verdict stands.", True, False]
    assert row["h"] == "2024-01-05 16:40:00" and row["i"] == "2024-01-08 16:40:00"


def test_sharpe_guards(spark):
    flat = spark.createDataFrame([("A", 0.01)] * 30, "k string, ret double")
    assert flat.groupBy("k").agg(met.sharpe().alias("s")).first()["s"] == 0.0
    few = spark.createDataFrame([("A", float(x)) for x in range(10)], "k string, ret double")
    assert few.groupBy("k").agg(met.sharpe().alias("s")).first()["s"] == 0.0


def test_implied_growth_prices_the_share(spark, sf):
    from quantloom.plans.registry import QUERIES
    from quantloom.plans import all_queries

    all_queries()
    rows = QUERIES["g10_implied_growth"](spark, sf).toPandas()
    inner = rows[(rows.implied_g > -0.29) & (rows.implied_g < 0.79)]
    assert len(rows) and np.allclose(inner.value, inner.price, rtol=1e-6)


def test_empty_bars(spark):
    none = _bars(spark).limit(0)
    assert st.stacked(st.wide_signals(none, ["sma_cross", "rsi2"]), ["sma_cross", "rsi2"]).count() == 0
    assert ind.newest(ind.price_levels(none)).count() == 0


def test_one_deflated_sharpe_for_each_strategy(spark, sf):
    from quantloom.plans import all_queries

    rows = all_queries()[0]["v10_deflated_sharpe"](spark, sf).toPandas()
    assert len(rows) == rows[["symbol", "strategy"]].drop_duplicates().shape[0] == 66 and rows.dsr.between(0, 1).all()
