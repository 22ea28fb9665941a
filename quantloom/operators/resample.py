"""Resampled price paths from block bootstraps.

Draws are a function of (seed, symbol, path, step), so a path is the same whatever
the partitioning.  A symbol's returns are gathered once and dealt out for each block of
paths (`draws`); a path is one row with an array of its steps until someone wants the steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HORIZON_BARS, clip
from .draws import BLOCK, block_picks, gathered, in_blocks, whole
from .indicators import log_return
from .risk import tail

PREMIUM = 0.045
# Stop and target of each horizon in true ranges, risk and weight limits.
RANGES = {"short": (2.0, 4.0), "mid": (3.0, 6.0), "long": (5.0, 10.0)}
RISK, MOST = 0.01, 0.25
FAN = (5, 25, 50, 75, 95)


def drift(profile: DataFrame) -> DataFrame:
    """profile(symbol, rf, beta) with the yearly drift of its paths."""
    return profile.withColumn("drift", F.col("rf") + F.coalesce(clip(F.col("beta"), 0, 2.5), F.lit(1.0)) * PREMIUM)


def _salt() -> Column:
    return F.crc32(F.encode("symbol", "UTF-8"))


def block_bootstrap(sizes: DataFrame, n_paths: int, horizon: int, block: int = 10, seed: int = 11) -> DataFrame:
    """(symbol, path, step, pick) for sizes(symbol, n): each step goes on to the next row, or with chance 1/block anew; null without a symbol or rows.

    A path comes from its task as an array and becomes rows there, so none is sorted, sent or spilled.
    """
    c = F.col
    known = c("symbol").isNotNull() & (c("n") > 0)

    def picks(values, draws, salt, numbers):
        return [block_picks(int(numbers[0]), draws, horizon, block, seed, salt)]

    rows = sizes.select("symbol", "n", F.array().cast("array<double>").alias("values"))
    paths = in_blocks(rows, ["symbol", "n"], n_paths, 0, F.coalesce(_salt(), F.lit(0)), [F.greatest("n", F.lit(1))], picks, "picks array<bigint>")
    steps = paths.select("symbol", "n", c("draw").alias("path"), F.posexplode("picks").alias("step", "pick"))
    return steps.select("symbol", "path", "step", F.when(known, c("pick")).alias("pick"))


def _pool(bars: DataFrame, drifts: DataFrame, horizon: int) -> DataFrame:
    """(symbol, values, _shift): three years of log returns of each symbol, and what centres them on its drift (null for a single return)."""
    c = F.col
    r = tail(bars.select("symbol", "date", log_return().alias("r")).where("r is not null"), 3 * horizon)
    rows = gathered(r, ["symbol"], ["date"], "r", F.avg("r").alias("mean"), F.var_samp("r").alias("var")).join(drifts.select("symbol", "drift"), "symbol")
    return rows.select("symbol", "values", (F.log(1 + c("drift")) / horizon - c("var") / 2 - c("mean")).alias("_shift"))


def path_arrays(bars: DataFrame, drifts: DataFrame, n_paths: int = 2000, horizon: int = 252, block: int = 10, seed: int = 11) -> DataFrame:
    """(symbol, path, growth): growth of the price from its last close at each step, from three years of centred log returns."""
    pool = _pool(bars, drifts, horizon)

    def grown(values, draws, salt, numbers):
        return [np.exp(np.cumsum((values + numbers[0])[block_picks(len(values), draws, horizon, block, seed, salt)], axis=1))]

    paths = in_blocks(pool, ["symbol"], n_paths, 0, _salt(), [F.col("_shift")], grown, "growth array<double>")
    return paths.withColumnRenamed("draw", "path")


def forward_paths(bars: DataFrame, drifts: DataFrame, n_paths: int = 2000, horizon: int = 252, block: int = 10, seed: int = 11) -> DataFrame:
    """(symbol, path, step, growth): the paths of path_arrays, a row for each step."""
    return path_arrays(bars, drifts, n_paths, horizon, block, seed).select("symbol", "path", F.posexplode("growth").alias("step", "growth"))


def _as_arrays(paths: DataFrame) -> DataFrame:
    """Paths with a row for each step as arrays; arrays as they are."""
    if "step" not in paths.columns:
        return paths
    return gathered(paths, ["symbol", "path"], ["step"], "growth").withColumnRenamed("values", "growth")


def summarize_paths(paths: DataFrame, horizon_bars: dict[str, int] | None = None) -> DataFrame:
    """(symbol, horizon, p_up, percentiles, cvar95) of returns at the end of each horizon."""
    ends = [F.struct(F.lit(k).alias("horizon"), (F.try_element_at("growth", F.lit(h)) - 1).alias("f")) for k, h in (horizon_bars or HORIZON_BARS).items()]
    parts = _as_arrays(paths).select("symbol", F.explode(F.array(*ends)).alias("e")).select("symbol", "e.horizon", "e.f").where("f is not null")
    keys = ["symbol", "horizon"]
    w = Window.partitionBy(*keys)
    rows = parts.withColumn("_r", F.row_number().over(w.orderBy("f"))).withColumn("_k", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 20)))
    q = lambda p: F.percentile("f", F.lit(p / 100)).alias(f"p{p}")
    return rows.groupBy(*keys).agg(F.avg((F.col("f") > 0).cast("double")).alias("p_up"), *[q(p) for p in (5, 25, 50, 75, 95)], (-F.avg(F.when(F.col("_r") <= F.col("_k"), F.col("f")))).alias("cvar95"))


def path_fan(paths: DataFrame, every: int = 4) -> DataFrame:
    """(symbol, day, p5 … p95) at every fourth day."""
    some = F.filter(F.transform("growth", lambda g, i: F.struct((i + 1).alias("day"), g.alias("g"))), lambda x: x["day"] % every == 0)
    rows = _as_arrays(paths).select("symbol", F.explode(some).alias("x")).select("symbol", "x.day", "x.g")
    return rows.groupBy("symbol", "day").agg(*[F.percentile("g", F.lit(p / 100)).alias(f"p{p}") for p in FAN])


def forward_fan(bars: DataFrame, drifts: DataFrame, n_paths: int = 2000, horizon: int = 252, block: int = 10, seed: int = 11, every: int = 4) -> DataFrame:
    """path_fan of the paths of path_arrays. One task makes all paths of a symbol, a block at a time, and keeps n_paths * horizon / every doubles (1 MB): no path is sent or grouped."""
    days = np.arange(every, horizon + 1, every)

    def fan(values, salt, numbers):
        values = values + (np.nan if numbers[0] is None else numbers[0])
        growth = np.empty((len(days), n_paths))
        for first in range(0, n_paths, BLOCK):
            draws = np.arange(first, min(first + BLOCK, n_paths))
            sums = np.cumsum(values[block_picks(len(values), draws, horizon, block, seed, salt)], axis=1)
            growth[:, draws] = np.exp(sums[:, days - 1]).T
        return [days.astype(np.int32), *np.quantile(growth, [p / 100 for p in FAN], axis=1)]

    return whole(_pool(bars, drifts, horizon), ["symbol"], _salt(), [F.col("_shift")], fan, ", ".join(["day int", *[f"p{p} double" for p in FAN]]))


def trade_plan(prices: DataFrame, horizon: str) -> DataFrame:
    """prices(symbol, price, atr[, win_rate, avg_win, avg_loss]) with stop, target, reward to risk and sizes."""
    c = F.col
    down, up = RANGES[horizon]
    rows = prices.withColumn("horizon", F.lit(horizon)).withColumn("stop", F.greatest(c("price") - down * c("atr"), c("price") * 0.5)).withColumn("target", c("price") + up * c("atr"))
    distance = (c("price") - c("stop")) / c("price")
    rows = rows.withColumn("reward_risk", F.try_divide(c("target") - c("price"), F.when(c("price") > c("stop"), c("price") - c("stop"))))
    rows = rows.withColumn("max_weight", F.when(distance > 0, F.least(RISK / distance, F.lit(MOST))))
    if "win_rate" in prices.columns:
        r = F.try_divide(c("avg_win"), F.abs(c("avg_loss")))
        rows = rows.withColumn("kelly_half", F.when(r > 0, clip((c("win_rate") - (1 - c("win_rate")) / r) / 2, 0, MOST)))
    return rows


def first_touch(paths: DataFrame, plan: DataFrame, bars: int) -> DataFrame:
    """(symbol, p_target_first, p_stop_first, p_neither, expected_return) of plan(symbol, price, stop, target) over paths."""
    c = F.col
    rows = _as_arrays(paths).join(plan.select("symbol", "price", "stop", "target"), "symbol").withColumn("_g", F.slice("growth", 1, bars))
    first = lambda hit: F.nullif(F.array_position(F.transform("_g", hit), True), F.lit(0).cast("long")) - 1
    per = rows.select(
        "symbol", first(lambda g: g * c("price") >= c("target")).alias("t"), first(lambda g: g * c("price") <= c("stop")).alias("s"), (F.element_at("_g", -1) - 1).alias("end"),
        (c("target") / c("price") - 1).alias("up"), (c("stop") / c("price") - 1).alias("down"),
    )
    never = F.lit(bars + 1)
    t, s = F.coalesce("t", never), F.coalesce("s", never)
    share = lambda cond: F.avg(cond.cast("double"))
    none = c("t").isNull() & c("s").isNull()
    g = per.groupBy("symbol").agg(share(t < s).alias("p_target_first"), share(s < t).alias("p_stop_first"), share(none).alias("p_neither"), F.coalesce(F.avg(F.when(none, c("end"))), F.lit(0.0)).alias("_rest"), F.first("up").alias("_up"), F.first("down").alias("_down"))
    value = c("p_target_first") * c("_up") + c("p_stop_first") * c("_down") + c("p_neither") * c("_rest")
    return g.select("symbol", "p_target_first", "p_stop_first", "p_neither", value.alias("expected_return"))


def annual(rate_per_bar: float, ppy: int = 252) -> float:
    return rate_per_bar * math.sqrt(ppy)
