"""Risk figures of a symbol against an index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import indicators as ind


def join_returns(bars: DataFrame, index: DataFrame, *more: Column) -> DataFrame:
    """(symbol, date, r, x, …more columns of bars): one-bar returns of the symbol and the index on their common dates."""
    own = bars.select("symbol", "date", ind.change("close").alias("r"), *more)
    market = index.select("date", (F.col("value") / F.lag("value").over(Window.orderBy("date")) - 1).alias("x"))
    return own.join(F.broadcast(market), "date").where("r is not null and x is not null").select("symbol", "date", "r", "x", *own.columns[3:])  # a row a trading day


def rolling_beta(joined: DataFrame, days: int = 504, least: int = 120) -> DataFrame:
    """Beta at every date over the newest `days` joined returns; null below `least` rows or for a flat index. More columns of joined are kept."""
    r, x, n = F.col("r"), F.col("x"), F.col("rows")
    s = ind.moving_sums(joined, {"sr": r, "sx": x, "srx": r * x, "sxx": x * x}, days)
    both, own = F.col("srx") - F.col("sr") * F.col("sx") / n, F.col("sxx") - F.col("sx") * F.col("sx") / n
    # Sums of squares keep some twelve digits: less is a flat index.
    value = F.when((n >= least) & (own > 1e-12 * F.col("sxx")), both / own)
    return s.select(*[k for k in joined.columns if k not in ("r", "x")], value.alias("beta"))


def tail(bars: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    return bars.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def tail_drawdown(bars: DataFrame, n: int) -> DataFrame:
    """Deepest fall inside the newest n bars, peaks before them left out."""
    inside = tail(bars.select("symbol", "date", "close"), n)
    fall = F.col("close") / F.max("close").over(ind.so_far()) - 1
    return inside.withColumn("_f", fall).groupBy("symbol").agg(F.min("_f").alias("drawdown"))


def risk_profile(bars: DataFrame, index: DataFrame, ppy: int = 252) -> DataFrame:
    """One row for each symbol: volatility, beta, drawdowns, one-day value at risk, true range and a level."""
    from .smooth import with_smoothed

    r = bars.select("symbol", "date", ind.change("close").alias("r")).where("r is not null")
    vol = tail(r, ppy).groupBy("symbol").agg((F.stddev_samp("r") * math.sqrt(ppy)).alias("vol_1y"))
    var = tail(r, 2 * ppy).groupBy("symbol").agg((-F.percentile("r", F.lit(0.05))).alias("var95_1d"))
    beta = ind.newest(rolling_beta(join_returns(bars, index))).select("symbol", "beta")
    atr = ind.newest(with_smoothed(bars, ["atr14"])).select("symbol", F.col("atr14").alias("atr"), (F.col("atr14") / F.col("close")).alias("atr_pct"))
    out = vol.join(var, "symbol").join(beta, "symbol", "left").join(atr, "symbol")
    for years in (1, 5):
        out = out.join(tail_drawdown(bars, years * ppy).withColumnRenamed("drawdown", f"mdd_{years}y"), "symbol")
    level = F.when(F.col("vol_1y") < 0.2, "low").when(F.col("vol_1y") < 0.35, "medium").when(F.col("vol_1y") < 0.6, "high").otherwise("very high")
    return out.withColumn("level", level)
