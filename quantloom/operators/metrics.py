"""Performance metrics of return series, grouped by any keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import equity


def sharpe(ret: Column | str = "ret", rate: float = 0.0001, ppy: int = 252) -> Column:
    """Annualised mean excess over the deviation of the raw return; 0 below 20 rows or without variation."""
    r = F.col(ret) if isinstance(ret, str) else ret
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= 20) & (sd > 0), F.try_divide(F.avg(r - rate), sd) * math.sqrt(ppy)).otherwise(0.0)


def period_sharpe(ret: Column | str = "ret", rate: float = 0.0001) -> Column:
    """Not annualised and without a least number of rows."""
    r = F.col(ret) if isinstance(ret, str) else ret
    sd = F.stddev_samp(r)
    return F.when(sd > 0, F.try_divide(F.avg(r - rate), sd)).otherwise(0.0)


def moments(returns: DataFrame, keys: list[str], *more: Column, rate: float = 0.0001) -> DataFrame:
    """n, mean, sd of the excess and its standardised third and fourth moments, from power sums of one pass, and `more` aggregates of it."""
    names = [x for x in returns.groupBy(*keys).agg(*more).columns if x not in keys] if more else []
    ex = F.col("ret") - rate
    g = returns.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg(ex).alias("mean"), F.stddev_samp(ex).alias("sd"), *[F.avg(F.pow(ex, F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)], *more)
    m, s = F.col("mean"), F.col("sd")
    third = F.col("m3") - 3 * m * F.col("m2") + 2 * F.pow(m, F.lit(3))
    fourth = F.col("m4") - 4 * m * F.col("m3") + 6 * m * m * F.col("m2") - 3 * F.pow(m, F.lit(4))
    return g.select(*keys, "n", "mean", "sd", F.try_divide(third, F.pow(s, F.lit(3))).alias("skew"), F.try_divide(fourth, F.pow(s, F.lit(4))).alias("kurt"), *names)


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and averages of closed trades; the profit factor stops at 99."""
    closed = trades.where(~F.col("is_open"))
    win, loss = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") <= 0, F.col("ret"))
    g = closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.coalesce(F.sum(win), F.lit(0.0)).alias("_won"),
        F.coalesce(-F.sum(loss), F.lit(0.0)).alias("_lost"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"), F.avg("days").alias("avg_days"),
    )
    factor = F.when(F.col("_lost") > 0, F.least(F.col("_won") / F.col("_lost"), F.lit(99.0))).when(F.col("_won") > 0, 99.0).otherwise(0.0)
    return g.withColumn("profit_factor", factor).drop("_won", "_lost")


def performance(returns: DataFrame, trades: DataFrame, keys: list[str], rate: float = 0.0001, ppy: int = 252) -> DataFrame:
    """Fourteen figures for each key of returns(keys, date, ret, held) and trades(keys, ret, days, is_open)."""
    curve = equity(returns, keys)
    ex = F.col("ret") - rate
    g = curve.groupBy(*keys).agg(
        F.max_by("equity", "date").alias("_end"), F.count(F.lit(1)).alias("_n"), F.stddev_samp("ret").alias("_sd"), sharpe("ret", rate, ppy).alias("sharpe"), F.avg(ex).alias("_mean"),
        F.sqrt(F.avg(F.pow(F.least(ex, F.lit(0.0)), F.lit(2)))).alias("_down"), F.min("drawdown").alias("max_drawdown"), F.avg("held").alias("exposure"),
    )
    years = F.greatest(F.col("_n") / ppy, F.lit(1 / ppy))
    g = g.withColumn("cagr", F.when(F.col("_end") > 0, F.pow("_end", 1 / years) - 1).otherwise(-1.0))
    g = g.select(
        *keys, (F.col("_end") - 1).alias("total_return"), "cagr", F.coalesce(F.col("_sd") * math.sqrt(ppy), F.lit(0.0)).alias("vol"), "sharpe",
        F.when(F.col("_down") > 0, F.col("_mean") / F.col("_down") * math.sqrt(ppy)).otherwise(0.0).alias("sortino"), "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"), "exposure",
    )
    return g.join(trade_stats(trades, keys), keys, "left").na.fill(0)
