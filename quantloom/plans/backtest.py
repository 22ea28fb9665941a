"""Point-in-time back-test of the verdict: what it would have said at each sample date, and what followed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HORIZON_BARS, is_hit
from ..operators import analogs as an
from ..operators import indicators as ind
from ..operators import verdict as vd
from ..operators.asof import asof
from ..operators.smooth import with_smoothed
from ..session import written
from ..operators.cleaning import sector_etf
from ..operators.risk import join_returns, rolling_beta

STEP, START = 21, 504
TESTED = ["technical", "analogs", "regime"]
BINS = ((0.0, 0.6), (0.6, 0.8), (0.8, 1.01))


def with_fund(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """rows(symbol, date, …) with fund, the series of the sector that sectors(symbol, since, sector) gives the symbol at the date."""
    dated = sectors.select("symbol", F.col("since").alias("date"), F.col("sector").alias("_sector"))
    return asof(rows, dated, ["symbol"], "date", "_sector").withColumn("fund", sector_etf(F.col("_sector"))).drop("_sector")


def _sampled(i: Column, start: int = START, step: int = STEP) -> Column:
    return (i >= start) & ((i - start) % step == 0)


def sample_dates(bars: DataFrame, h: int, step: int = STEP, start: int = START) -> DataFrame:
    """(symbol, date, i) of every step-th bar from start that has a bar h later."""
    rows = bars.select("symbol", "date", ind.bar_index().alias("i"), F.lead("close", h).over(ind.history()).alias("_f"))
    return rows.where((F.col("i") >= start) & ((F.col("i") - start) % step == 0) & F.col("_f").isNotNull()).select("symbol", "date", "i")


def module_rows(bars: DataFrame, series: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """(symbol, date, horizon, module, available, score, confidence, vol_1y, ret, i) at all sample dates.

    All columns look back only, so each is computed once over the full history and
    then looked up, instead of once for every date.  Bars and their smoothed columns
    are written once (unless they come with them), as all modules read them, and so are the sample dates with their
    volatility, returns and betas; rows between sample dates go before anything is joined.
    sectors(symbol, since, sector) dates the sector of each symbol.
    """
    bars = bars if {"adx14", "vol252"} <= set(bars.columns) else written(with_smoothed(bars.drop("vol252"), vd.SMOOTHED), "smoothed")
    index, i = series.where("series_id = 'INDEX'").select("date", "value"), F.col("i")
    tech = vd.technical(bars, index).where(_sampled(i))
    base = bars.select("symbol", "date", ind.bar_index().alias("i"), (F.col("vol252") * math.sqrt(252)).alias("vol_1y"), *[(F.lead("close", h).over(ind.history()) / F.col("close") - 1).alias(f"ret_{k}") for k, h in HORIZON_BARS.items()])
    betas = rolling_beta(join_returns(bars, index, ind.bar_index().alias("i"))).where(_sampled(i)).drop("i")
    base = written(base.where(_sampled(i)).join(betas, ["symbol", "date"], "left"), "sampled")
    betas = base.select("symbol", "date", "beta")
    reg = vd.regime(with_fund(betas, sectors) if sectors is not None else betas, series)
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.col(f"ret_{k}").alias("ret")) for k in HORIZON_BARS])).alias("e")
    dates = base.select("symbol", "date", "i", "vol_1y", found).select("symbol", "date", "i", "vol_1y", "e.horizon", "e.ret").where("ret is not null")
    cols = ["symbol", "date", "available", "score", "confidence"]
    parts = [m.select(*cols, F.lit(None).cast("string").alias("h"), F.lit(n).alias("module")) for n, m in (("technical", tech), ("regime", reg))]
    parts.append(an.analogs_of_all(an.with_state(bars), list(HORIZON_BARS), _sampled(i)).select(*cols, "h", F.lit("analogs").alias("module")))
    modules = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return dates.join(modules, ["symbol", "date"]).where("h is null or h = horizon").drop("h")


def engine_samples(bars: DataFrame, series: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """(symbol, date, horizon, verdict, conf, ret, x): verdicts with later returns and the modules' signals."""
    return samples_of(written(module_rows(bars, series, sectors), "modules"))


def samples_of(rows: DataFrame) -> DataFrame:
    """The samples of a written table of module rows."""
    keys = ["symbol", "date", "horizon"]
    verdicts = vd.combine(rows, vd.weight_table(rows.sparkSession), keys)
    signals = rows.where("available").groupBy(*keys).agg(F.max("ret").alias("ret"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", F.round(F.col("score") * F.col("confidence") + 1e-9, 4))))).alias("x"))
    return verdicts.join(signals, keys).select(*keys, "verdict", F.round("confidence", 3).alias("conf"), "ret", "x")


def summarize_verdicts(samples: DataFrame) -> DataFrame:
    """Of a written table of samples, by horizon and verdict: n, hit rate, the hit rate had every sample got that verdict, and mean return."""
    g = samples.groupBy("horizon", "verdict").agg(F.count(F.lit(1)).alias("n"), F.avg(is_hit(F.col("verdict"), F.col("ret")).cast("double")).alias("hit"), F.avg("ret").alias("avg_ret"))
    return g.join(_baselines(samples), ["horizon", "verdict"])


def _baselines(samples: DataFrame) -> DataFrame:
    all_of = samples.groupBy("horizon").agg(*[F.avg(is_hit(F.lit(v), F.col("ret")).cast("double")).alias(v) for v in ("buy", "hold", "sell")])
    return all_of.unpivot("horizon", ["buy", "hold", "sell"], "verdict", "base")


def summarize_conf(samples: DataFrame, bins: tuple = BINS) -> DataFrame:
    """Of a written table of samples, by horizon and confidence bin: n, hit rate and the mean baseline of the bin's verdicts."""
    at = F.coalesce(*[F.when((F.col("conf") >= lo) & (F.col("conf") < hi), F.lit(k)) for k, (lo, hi) in enumerate(bins)])
    rows = samples.join(F.broadcast(_baselines(samples)), ["horizon", "verdict"]).withColumn("bin", at)  # nine rows
    return rows.groupBy("horizon", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(is_hit(F.col("verdict"), F.col("ret")).cast("double")).alias("hit"), F.avg("base").alias("base"))


def findings(by_verdict: DataFrame, margin: float = 0.03) -> DataFrame:
    """Cells whose hit rate is clearly above or below its baseline."""
    lift = F.col("hit") - F.col("base")
    kind = F.when(lift >= margin, "better").when(lift <= -margin, "worse")
    return by_verdict.withColumn("lift", lift).withColumn("finding", kind).where("finding is not null").select("horizon", "verdict", "n", "lift", "finding")


def conclusions(samples: DataFrame) -> DataFrame:
    """One row over all horizons: whether prices rose more after sells than after all verdicts, and whether the highest
    confidence bin does no better against its baseline than the lowest."""
    sell = summarize_verdicts(samples).where("verdict = 'sell'").select("horizon", F.col("avg_ret").alias("sell"))
    every = samples.groupBy("horizon").agg(F.avg("ret").alias("every")).join(sell, "horizon", "left")
    rise = every.agg(F.bool_and(F.coalesce("sell", F.lit(-1.0)) > F.col("every")).alias("sells_rise"))
    bins = summarize_conf(samples).withColumn("lift", F.col("hit") - F.col("base")).groupBy("horizon")
    ends = bins.agg(F.count(F.lit(1)).alias("n"), F.min_by("lift", "bin").alias("low"), F.max_by("lift", "bin").alias("high"))
    flat = ends.agg(F.bool_and((F.col("n") > 1) & (F.col("high") <= F.col("low"))).alias("confidence_tells_nothing"))
    return rise.crossJoin(flat)  # one row each


def engine_report(samples: DataFrame) -> DataFrame:
    """Span, size and the weight of the tested modules, by horizon."""
    share = F.create_map(*[x for h, w in vd.WEIGHTS.items() for x in (F.lit(h), F.lit(round(sum(v for m, v in zip(vd.MODULES, w, strict=True) if m in TESTED), 2)))])
    g = samples.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("avg_ret"), F.min("date").alias("start"), F.max("date").alias("end"), F.count_distinct("symbol").alias("symbols"))
    return g.withColumn("weight_share", share[F.col("horizon")])
