"""What followed earlier bars in the same market state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HORIZON_BARS, clip
from . import indicators as ind
from .smooth import with_smoothed


def with_state(bars: DataFrame) -> DataFrame:
    """bars with the bar index i and the market state."""
    rows = bars if "rsi14" in bars.columns else with_smoothed(bars, ["rsi14", "sma200"])
    return rows.select("symbol", "date", "close", ind.bar_index().alias("i"), ind.market_state(F.col("rsi14"), avg=F.col("sma200")).alias("state"))


def _figures(n: Column, mean: Column, sd: Column, all_n: Column, all_mean: Column, h: int) -> list[Column]:
    """available, n, n_eff, mean, base_mean, t_stat, score, confidence."""
    ok = (all_n >= 250) & (n >= 20)
    n_eff = n / max(1.0, 2 * h / 3)
    se = sd / F.sqrt(F.greatest(n_eff, F.lit(1.0)))
    t = F.when(se > 0, (mean - all_mean) / se).otherwise(0.0)
    given = lambda x, name: F.when(F.coalesce(ok, F.lit(False)), x).alias(name)
    return [
        F.coalesce(ok, F.lit(False)).alias("available"), n.alias("n"), given(n_eff, "n_eff"), given(mean, "mean"), given(all_mean, "base_mean"), given(t, "t_stat"),
        given(F.round(clip(t / 3, -1, 1), 3), "score"), given(F.round(F.least(F.lit(1.0), n_eff / 10), 3), "confidence"),
    ]


def analogs(bars: DataFrame, horizon: str) -> DataFrame:
    """Per symbol: returns over the horizon after bars in today's state against those after all bars."""
    h = HORIZON_BARS[horizon]
    rows = with_state(bars).withColumn("fwd", ind.forward_return(h))
    now = ind.newest(rows).select("symbol", F.col("state").alias("now"))
    valid = rows.where("state is not null and fwd is not null").join(now, "symbol")
    same = F.when(F.col("state") == F.col("now"), F.col("fwd"))
    g = valid.groupBy("symbol").agg(
        F.count("fwd").alias("all_n"), F.avg("fwd").alias("all_mean"), F.count(same).alias("n"), F.avg(same).alias("m"), F.stddev_samp(same).alias("sd"), F.percentile(same, F.lit(0.5)).alias("median"),
        F.avg((same > 0).cast("double")).alias("hit_rate"), F.avg((F.col("fwd") > 0).cast("double")).alias("base_hit_rate"),
    )
    c = F.col
    return g.select("symbol", *_figures(c("n"), c("m"), c("sd"), c("all_n"), c("all_mean"), h), "median", "hit_rate", "base_hit_rate")


def analogs_of_all(states: DataFrame, horizons: list[str], at: Column | None = None) -> DataFrame:
    """Analogs at every bar (or those where `at` holds), of each of the horizons, from outcomes known by then: bars whose
    horizon has passed, a row for each horizon h.

    The frames end a horizon's bars before the row, so one pass over (symbol, state) and one
    over (symbol) replace a pass for each date; all horizons share both.
    """
    c = F.col
    hs = {k: HORIZON_BARS[k] for k in horizons}
    rows = states.select("*", *[F.when(c("state").isNotNull(), F.lead("close", h).over(ind.history()) / c("close") - 1).alias(f"fwd_{k}") for k, h in hs.items()])
    known = lambda h, *keys: Window.partitionBy(*keys).orderBy("i").rangeBetween(Window.unboundedPreceding, -h)
    same = [f(f"fwd_{k}").over(known(h, "symbol", "state")).alias(f"{n}_{k}") for k, h in hs.items() for n, f in (("n", F.count), ("m", F.avg), ("sd", F.stddev_samp))]
    every = [f(f"fwd_{k}").over(known(h, "symbol")).alias(f"{n}_{k}") for k, h in hs.items() for n, f in (("all_n", F.count), ("all_mean", F.avg))]
    rows = rows.select("*", *every).select("*", *same)
    rows = rows.where(at) if at is not None else rows
    n = lambda k: F.when(c("state").isNotNull(), c(f"n_{k}")).otherwise(F.lit(0))
    cells = [F.struct(F.lit(k).alias("h"), *_figures(n(k), c(f"m_{k}"), c(f"sd_{k}"), c(f"all_n_{k}"), c(f"all_mean_{k}"), h)) for k, h in hs.items()]
    return rows.select("symbol", "date", "i", F.explode(F.array(*cells)).alias("e")).select("symbol", "date", "i", "e.*")


def analogs_asof(states: DataFrame, horizon: str) -> DataFrame:
    """The analogs of one horizon at every bar."""
    return analogs_of_all(states, [horizon]).drop("h")


def histogram(df: DataFrame, keys: list[str], col: str, lo: float = -0.6, hi: float = 0.6, bins: int = 24) -> DataFrame:
    """(keys, bin, n): equal bins from 0; values beyond the ends go to the end bins, the top edge to the last."""
    at = F.least(F.width_bucket(clip(F.col(col), lo, hi), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)) - 1
    return df.where(F.col(col).isNotNull()).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
