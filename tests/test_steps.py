"""Smoothing, moving sums, as-of joins, statement dates, the normal distribution and tuned weights against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import asof as j
from quantloom.operators import indicators as ind
from quantloom.operators import smooth
from quantloom.operators import tuning as tu
from quantloom.operators import validation as va
from quantloom.operators.fundamentals import build_metrics, stmt_pivot

DAY = dt.date(2020, 1, 1)


def _series(spark, n, holes):
    rng = random.Random(3)
    rows = [(s, DAY + dt.timedelta(days=i), None if i in holes else 100 + rng.random() * 10) for s in ("A", "B") for i in range(n)]
    return rows, spark.createDataFrame(rows, "symbol string, date date, x double")


SPANS = (1, 2, 9, 46, 200, 3000)


@pytest.mark.parametrize("holes", [{0, 1, 500, 501, 502, 899, 900, 1500}, set(range(300, 1250)), set(range(900, 5900)), {k for k in range(1, 7000) if k * k % 7}])
def test_smoothing_of_any_rate_over_any_hole(spark, holes):
    rows, df = _series(spark, 7000, holes)
    wanted = [smooth.ema(f"e{n}", "x", n) for n in SPANS] + [smooth.wilder(f"w{n}", "x", n) for n in SPANS]
    got = {(r["symbol"], r["date"]): r for r in smooth.smooth(df, wanted).collect()}
    for s in wanted:
        for symbol in ("A", "B"):
            y, weight, seen = None, 1.0, 0
            for _, date, x in (r for r in rows if r[0] == symbol):
                weight *= 1 - s.alpha
                if x is not None:
                    y, weight, seen = (x if y is None else (weight * y + s.alpha * x) / (weight + s.alpha)), 1.0, seen + 1
                value = got[symbol, date][s.name]
                assert value is None if seen < s.need else value == pytest.approx(y, rel=1e-12)
    with pytest.raises(ValueError):
        smooth.smooth(df, [smooth.Smoothing("no_rate", "x", 0.0, 1)])


def test_moving_sums(spark):
    rows, df = _series(spark, 137, set())
    got = {(r["symbol"], r["date"]): r for r in ind.moving_sums(df, {"total": F.col("x")}, 20).collect()}
    for symbol in ("A", "B"):
        xs = [r for r in rows if r[0] == symbol]
        for k, (_, date, _) in enumerate(xs):
            part = [x for _, _, x in xs[max(0, k - 19) : k + 1]]
            assert got[symbol, date]["total"] == pytest.approx(sum(part), rel=1e-12) and got[symbol, date]["rows"] == len(part)


def test_asof_both_ways_with_and_without_keys(spark):
    rng = random.Random(5)
    left = [(k, rng.choice("AB"), None if k == 7 else DAY + dt.timedelta(days=rng.randrange(40))) for k in range(60)]
    right = [(s, DAY + dt.timedelta(days=d), float(d)) for s in "AB" for d in rng.sample(range(5, 35), 12)]
    a = spark.createDataFrame(left, "k int, symbol string, date date")
    b = spark.createDataFrame(right, "symbol string, date date, v double")
    for keys in (["symbol"], []):
        table = b if keys else b.where("symbol = 'A'").drop("symbol")
        for forward in (False, True):
            got = {r["k"]: r["v"] for r in j.asof(a, table, keys, "date", "v", forward).collect()}
            assert len(got) == len(left)
            for k, s, d in left:
                able = [v for t, e, v in right if t == (s if keys else "A") and d is not None and (e >= d if forward else e <= d)]
                assert got[k] == ((min if forward else max)(able) if able else None), (k, keys, forward)


def test_statement_dates_are_numbered_for_all_items(spark):
    """An item that skips the newest date has no value there, and all periods count."""
    rows = [("X", "income", "Total Revenue", dt.date(2020 - i, 12, 31), 100.0 - i) for i in range(7)]
    rows += [("X", "income", "Net Income", dt.date(2020 - i, 12, 31), 10.0 + i) for i in range(1, 7)]
    rows += [("X", "balance", "Stockholders Equity", dt.date(2020 - i, 12, 31), 50.0) for i in range(7)]
    pivot = stmt_pivot(spark.createDataFrame(rows, "symbol string, stmt string, item string, period_end date, value double"))
    (r,) = build_metrics(pivot, pivot.select("symbol", F.lit(1.0).alias("price"))).collect()
    assert r["net_income_0"] is None and r["net_income_1"] == 11.0 and r["years"] == 7 and len(r["roe_hist"]) == 6 and r["rev_all_up"] is True


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -7.2, -3.3, -1.0, 0.0, 0.5, 1.96, 7.0, 7.5, 38.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", va.normal_cdf("x").alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=1e-8, abs=1e-300) for r in got)


def test_tuned_weights_take_all_modules_once_live_samples_suffice(spark):
    rng, rows = random.Random(2), []
    for k in range(400):
        x = rng.uniform(-1, 1)
        rows.append(("short", f"S{k % 40}", DAY + dt.timedelta(days=31 * (k // 40)), 0.1 * x + rng.gauss(0, 0.01), {"technical": x, "sentiment": rng.uniform(-1, 1)}, "live"))
        rows.append(("mid", f"S{k % 40}", DAY + dt.timedelta(days=92 * (k // 40)), 0.1 * x + rng.gauss(0, 0.01), {"technical": x, "regime": rng.uniform(-1, 1)}, "bt"))
    rows += [("long", "S0", DAY, 0.1, {"technical": 0.1}, "bt")]
    samples = spark.createDataFrame(rows, "horizon string, symbol string, date date, ret double, x map<string,double>, src string")
    prior = spark.createDataFrame([(h, m, 0.3) for h in ("short", "mid", "long") for m in ("technical", "regime", "sentiment")], "horizon string, module string, w double")
    out = {(r["horizon"], r["module"]): r for r in tu.tuned_weights(samples, prior, ["technical", "regime", "sentiment"], ["technical", "regime"]).collect()}
    assert len(out) == 9 and {h: out[h, "technical"]["mode"] for h in ("short", "mid", "long")} == {"short": "all", "mid": "backtest", "long": "backtest"}
    assert out["short", "technical"]["adopted"] and out["short", "technical"]["w"] > out["short", "sentiment"]["w"]
    assert out["mid", "technical"]["adopted"] and out["mid", "sentiment"]["w"] == 0.3 and out["mid", "technical"]["w"] + out["mid", "regime"]["w"] == pytest.approx(0.6, abs=2e-3)
    assert not out["long", "technical"]["adopted"] and out["long", "technical"]["w"] == 0.3
