"""Module scores and the verdict that combines them, at every date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, weighted
from . import indicators as ind
from .asof import asof
from .smooth import with_smoothed

# Weight of each module for each horizon.
MODULES = ["technical", "strategies", "analogs", "sentiment", "consensus", "valuation", "quality", "personas", "regime"]
WEIGHTS = {
    "short": [0.22, 0.22, 0.08, 0.16, 0.06, 0.04, 0.02, 0.05, 0.15],
    "mid": [0.12, 0.15, 0.06, 0.10, 0.12, 0.15, 0.12, 0.10, 0.08],
    "long": [0.04, 0.05, 0.02, 0.04, 0.10, 0.28, 0.25, 0.18, 0.04],
}
BUY, STRONG = 0.15, 0.35
TECHNICAL = ["rsi14", "macd_12_26_9", "adx14", "sma50", "sma200"]
SMOOTHED = [*TECHNICAL, "vol252"]  # what the modules and the volatility beside them read
READ = ["symbol", "date", "close", "volume"]  # and of bars


def weight_table(spark, modules: list[str] | None = None) -> DataFrame:
    """(horizon, module, w): a row for each horizon and module."""
    rows = [(h, m, w) for h, ws in WEIGHTS.items() for m, w in zip(MODULES, ws, strict=True) if modules is None or m in modules]
    return spark.createDataFrame(rows, "horizon string, module string, w double")


def index_columns(index: DataFrame) -> DataFrame:
    """(date, idx, idx_n, idx_avg200, idx_ret63, idx_ret126) of an index series, by its own bars."""
    w = Window.orderBy("date")
    n = F.row_number().over(w)
    back = lambda k: F.col("value") / F.lag("value", k).over(w) - 1
    avg = F.when(n >= 200, F.avg("value").over(w.rowsBetween(-199, 0)))
    return index.select("date", F.col("value").alias("idx"), n.alias("idx_n"), avg.alias("idx_avg200"), back(63).alias("idx_ret63"), back(126).alias("idx_ret126"))


def technical(bars: DataFrame, index: DataFrame) -> DataFrame:
    """(symbol, date, i, available, score, confidence): trend, momentum, relative strength, RSI, MACD and volume."""
    c = F.col
    rows = ind.with_obv(bars if "adx14" in bars.columns else with_smoothed(bars, TECHNICAL))
    rows = rows.join(index_columns(index).select("date", "idx_n", "idx_ret126"), "date", "left")
    rows = rows.withColumn("hist", c("macd_12_26_9_line") - c("macd_12_26_9_signal"))
    lag = lambda x, k: F.lag(x, k).over(ind.history())
    rows = rows.select(
        "symbol", "date", "close", "rsi14", "adx14", "hist", "idx_n", "idx_ret126", ind.bar_index().alias("i"), c("sma50").alias("s50"), c("sma200").alias("s200"),
        lag("hist", 3).alias("hist3"), (c("close") - lag("close", 20)).alias("p20"), (c("obv") - lag("obv", 20)).alias("o20"),
        (c("close") / lag("close", 126) - 1).alias("r6"), (lag("close", 21) / lag("close", 252) - 1).alias("r12"),
    )
    above50, above200, golden = c("close") > c("s50"), c("close") > c("s200"), c("s50") > c("s200")
    base = F.when(above200 & above50, 1.0).when(above200, 0.25).when(above50, -0.25).otherwise(-1.0)
    adx = F.coalesce(c("adx14"), F.lit(20.0))
    trend = clip(base + F.when(golden, 0.3).otherwise(-0.3), -1, 1) * F.when(adx > 25, 1.2).when(adx < 15, 0.7).otherwise(1.0)
    r12 = F.when(c("i") >= 253, c("r12"))
    momentum = F.when(r12.isNotNull() & c("r6").isNotNull(), (c("r6") + r12) / 2).otherwise(F.coalesce(c("r6"), r12))
    relative = F.when(c("idx_n") > 127, c("r6") - c("idx_ret126"))
    rsi = F.when(c("rsi14") > 70, -0.5).when(c("rsi14") < 30, 0.5).when(c("rsi14") >= 50, 0.25).otherwise(-0.25)
    up = c("hist") > F.coalesce(c("hist3"), F.lit(0.0))
    macd = F.when(c("hist") > 0, F.when(up, 0.5).otherwise(0.2)).otherwise(F.when(up, -0.2).otherwise(-0.5))
    agree = F.signum("p20") == F.signum("o20")
    volume = F.when(c("p20").isNotNull(), F.when(agree & (c("p20") > 0), 0.25).when(~agree, -0.25).otherwise(-0.1))
    score, _ = weighted([(0.35, F.when(c("s200").isNotNull(), clip(trend, -1, 1))), (0.25, clip(momentum / 0.3, -1, 1)), (0.15, clip(relative / 0.2, -1, 1)), (0.10, rsi), (0.10, macd), (0.05, volume)])
    ok = c("i") >= 59
    return rows.select("symbol", "date", "i", ok.alias("available"), F.when(ok, F.round(score, 3)).otherwise(0.0).alias("score"), F.when(ok, F.when(c("s200").isNotNull(), 0.9).otherwise(0.6)).otherwise(0.0).alias("confidence"))


def market_score(series: DataFrame) -> DataFrame:
    """(date, available, s): the market's part of the regime score, the same for all symbols."""
    one = lambda k: series.where(F.col("series_id") == k).select("date", "value")
    w = Window.orderBy("date")
    change = one("Y10").select("date", (F.col("value") - F.lag("value", 63).over(w)).alias("dt"), F.row_number().over(w).alias("k"))
    m = index_columns(one("INDEX")).join(one("VOL").withColumnRenamed("value", "v"), "date", "left").join(change, "date", "left")
    c = F.col
    s = F.when(c("idx") > c("idx_avg200"), 0.5).otherwise(-0.5) + F.when(c("idx_ret63") > 0, 0.25).otherwise(-0.25)
    s = s + F.when(c("v").isNull(), 0.0).when(c("v") < 18, 0.25).when(c("v") < 25, 0.0).when(c("v") < 32, -0.25).otherwise(-0.5)
    s = s + F.when(c("k") > 64, F.when(c("dt") > 0.5, -0.25).when(c("dt") < -0.5, 0.15).otherwise(0.0)).otherwise(0.0)
    return m.select("date", (c("idx_n") >= 210).alias("available"), s.alias("s"))


def sector_score(series: DataFrame, funds: list[str] | None = None) -> DataFrame:
    """(fund, date, sector_s): a quarter up or down as a sector's fund stands above or below its 200-bar average, from its 211th bar on."""
    rows = series if funds is None else series.where(F.col("series_id").isin(*funds))
    w = Window.partitionBy("series_id").orderBy("date")
    above = F.col("value") > F.avg("value").over(w.rowsBetween(-199, 0))
    score = F.when(F.row_number().over(w) > 210, F.when(above, 0.25).otherwise(-0.25))
    return rows.select(F.col("series_id").alias("fund"), "date", score.alias("sector_s"))


def regime(dates: DataFrame, series: DataFrame, funds: list[str] | None = None) -> DataFrame:
    """dates(symbol, date, beta[, fund]) with the regime's availability, score and confidence; fund names the series of the symbol's sector, as of the date."""
    market = market_score(series)
    factor = F.coalesce(clip(F.col("beta"), 0.6, 1.4), F.lit(1.0))
    rows = dates.join(F.broadcast(market), "date")  # a row for each trading day
    if "fund" in dates.columns:
        own = sector_score(series, funds)
        rows = asof(rows, own, ["fund"], "date", "sector_s").withColumn("s", F.col("s") + F.coalesce("sector_s", F.lit(0.0)))
    ok = F.col("available")
    return rows.select("symbol", "date", ok.alias("available"), F.when(ok, F.round(clip(clip(F.col("s"), -1, 1) * factor, -1, 1), 3)).otherwise(0.0).alias("score"), F.when(ok, 0.8).otherwise(0.0).alias("confidence"))


def combine(modules: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict for each key (which include horizon) of modules(keys, module, available, score, confidence[, vol_1y, earnings_days]).

    Unavailable modules and those without confidence drop out and the weights of the
    others are scaled up; agreement of the rest raises the confidence.
    """
    c = F.col
    for extra in ("vol_1y", "earnings_days"):
        if extra not in modules.columns:
            modules = modules.withColumn(extra, F.lit(None).cast("double"))
    used = modules.where(c("available") & (c("confidence") > 0)).join(F.broadcast(weights), ["horizon", "module"])  # a row for each horizon and module
    wcs = c("w") * c("confidence") * c("score")
    g = used.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("module", wcs.alias("v"), "w", (c("w") * c("confidence")).alias("wc"))), asc=False).alias("parts"), F.max("vol_1y").alias("vol"), F.min("earnings_days").alias("days"),
    )
    # The order of a sum decides the verdict of a score that is 0.15 but for its last bit: by module name, from the last.
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda a, x: a + f(x))
    g = g.select(*keys, "vol", "days", total(lambda x: x["w"]).alias("wsum"), total(lambda x: x["v"]).alias("num"), total(lambda x: x["wc"]).alias("wc"), total(lambda x: F.abs(x["v"])).alias("absum"),
        F.map_from_entries(F.reverse(F.transform("parts", lambda x: F.struct(x["module"], x["v"])))).alias("raw"))
    score, agreement, coverage = c("num") / c("wsum"), F.when(c("absum") > 0, F.abs("num") / c("absum")).otherwise(0.0), c("wc") / c("wsum")
    conf = coverage * (0.5 + 0.5 * agreement) * F.when(c("days").between(0, 10), 0.85).otherwise(1.0) * F.when(c("vol") > 0.6, 0.9).otherwise(1.0)
    verdict = F.when(score >= BUY, "buy").when(score <= -BUY, "sell").otherwise("hold")
    return g.select(
        *keys, verdict.alias("verdict"), ((F.abs(score) >= STRONG) & (verdict != "hold")).alias("strong"), score.alias("score"), conf.alias("confidence"), agreement.alias("agreement"), coverage.alias("coverage"),
        F.transform_values("raw", lambda k, v: v / c("wsum")).alias("contributions"),
    )


def missing_modules(modules: DataFrame, keys: list[str], expected: list[str]) -> DataFrame:
    used = F.collect_set(F.when(F.col("available") & (F.col("confidence") > 0), F.col("module")))
    return modules.groupBy(*keys).agg(F.array_sort(F.array_except(F.array(*[F.lit(m) for m in expected]), used)).alias("missing"))


def rank_contributions(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, module, value, rank) by absolute value."""
    rows = verdicts.select(*keys, F.explode("contributions").alias("module", "value"))
    order = Window.partitionBy(*keys).orderBy(F.abs("value").desc(), "module")
    return rows.withColumn("rank", F.row_number().over(order))


def waterfall(contributions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, module, value, step, from, to): gains from the largest, then losses from the smallest, each from where the last ended."""
    order = Window.partitionBy(*keys).orderBy((F.col("value") < 0), F.col("value").desc(), "module")
    run = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = contributions.withColumn("step", F.row_number().over(order)).withColumn("to", run)
    return rows.withColumn("from", F.col("to") - F.col("value"))


def nearest_levels(levels: DataFrame, names: list[str]) -> DataFrame:
    """levels(symbol, date, close, names…) with the nearest level above and below the price, those within 0.01 % left out."""
    cells = F.array(*[F.struct(F.col(n).alias("v"), F.lit(n).alias("name")) for n in names])
    above = F.array_min(F.filter(cells, lambda x: x["v"] > F.col("close") * 1.0001))
    below = F.array_max(F.filter(cells, lambda x: x["v"] < F.col("close") * 0.9999))
    return levels.select("symbol", "date", "close", above["v"].alias("above"), above["name"].alias("above_name"), below["v"].alias("below"), below["name"].alias("below_name"))


def price_ladder(levels: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, date, name, level, distance, rank): levels from high to low."""
    rows = levels.select("symbol", "date", "close", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("level")) for n in names])).alias("e")).where("e.level is not null")
    rows = rows.select("symbol", "date", "e.name", "e.level", (F.col("e.level") / F.col("close") - 1).alias("distance"))
    order = Window.partitionBy("symbol", "date").orderBy(F.col("level").desc(), "name")
    return rows.withColumn("rank", F.row_number().over(order))


def price_triggers(nearest: DataFrame) -> DataFrame:
    """(…, verdict) with what passing the nearest level up or down would mean."""
    up = F.when(F.col("verdict") == "buy", "buy_stronger").when(F.col("verdict") == "hold", "towards_buy").otherwise("towards_hold")
    down = F.when(F.col("verdict") == "buy", "towards_hold").when(F.col("verdict") == "hold", "towards_sell").otherwise("sell_stronger")
    return nearest.withColumn("if_above", F.when(F.col("above").isNotNull(), up)).withColumn("if_below", F.when(F.col("below").isNotNull(), down))


def advice(verdicts: DataFrame, held: Column) -> DataFrame:
    """(symbol, date, horizon, verdict, action, shorter, longer) from the verdicts of the three horizons of a key.

    shorter and longer name the nearest shorter or longer horizon that says the opposite.
    """
    c = F.col
    by_h = verdicts.groupBy("symbol", "date").agg(*[F.max(F.when(c("horizon") == h, c("verdict"))).alias(f"v_{h}") for h in WEIGHTS])
    rows = verdicts.join(by_h, ["symbol", "date"])
    opposite = F.when(c("verdict") == "buy", "sell").when(c("verdict") == "sell", "buy")
    says = lambda h: F.when(c(f"v_{h}") == opposite, h)
    shorter = F.when(c("horizon") == "mid", says("short")).when(c("horizon") == "long", F.coalesce(says("short"), says("mid")))
    longer = F.when(c("horizon") == "short", F.coalesce(says("mid"), says("long"))).when(c("horizon") == "mid", says("long"))
    buy = F.when(held, "keep").when(shorter.isNotNull(), "buy_in_parts").when(longer.isNotNull(), "buy_briefly").otherwise("consider_buying")
    sell = F.when(held, "reduce").otherwise("do_not_buy")
    action = F.when(c("verdict") == "buy", buy).when(c("verdict") == "sell", sell).when(held, "keep").otherwise("watch")
    return rows.select("symbol", "date", "horizon", "verdict", action.alias("action"), shorter.alias("shorter"), longer.alias("longer"))


def top_reasons(modules: DataFrame, keys: list[str], n: int = 3, floor: float = 0.1) -> DataFrame:
    """(keys, side, module, rank): available modules by score times confidence, for and against."""
    product = F.col("score") * F.col("confidence")
    rows = modules.where("available").withColumn("side", F.when(F.col("score") > floor, "bull").when(F.col("score") < -floor, "bear")).where("side is not null")
    order = Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "bull", -product).otherwise(product), "module")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(*keys, "side", "module", "rank")


def group_scores(modules: DataFrame, keys: list[str], company: tuple[str, ...]) -> DataFrame:
    """Confidence-weighted mean of available modules for the company and for the timing."""
    group = F.when(F.col("module").isin(*company), "company").otherwise("timing")
    g = modules.where("available").withColumn("part", group).groupBy(*keys, "part")
    return g.agg(F.try_divide(F.sum(F.col("confidence") * F.col("score")), F.sum("confidence")).alias("score"))


def quotes(bars: DataFrame, span: int = 260) -> DataFrame:
    """Newest price, its change, the extremes of `span` bars and the two long averages."""
    w = ind.last(span)
    rows = bars.select("symbol", "date", F.col("close").alias("price"), ind.change("close").alias("change"), F.max("high").over(w).alias("high52"), F.min("low").over(w).alias("low52"), ind.sma("close", 50).alias("sma50"), ind.sma("close", 200).alias("sma200"))
    return ind.newest(rows)
