"""Weight tuning: rank correlations of module signals with later returns, and shrunk weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .asof import price_on
from .ranks import with_average_ranks

LEAST = 30
SHRINK = 500


def n_eff(samples: DataFrame, keys: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """Distinct (symbol, stretch of one horizon) per key: overlapping returns count once."""
    days = F.datediff("date", F.lit("1970-01-01").cast("date")) + 719163  # day numbers that start in year 1
    stretch = F.floor(days / sc.by_horizon(sc.HORIZON_DAYS, F.col("horizon")))
    return samples.groupBy(*keys).agg(F.count_distinct(F.struct("symbol", stretch.alias("s"))).alias("n_eff"))


def spearman(samples: DataFrame, keys: list[str], a: str, b: str, least: int = LEAST) -> DataFrame:
    """(keys, n, ic): rank correlation, null below `least` rows."""
    rows = samples.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("_x"), F.col(b).alias("_y"))
    ranked = with_average_ranks(rows, keys, {"_x": "ra", "_y": "rb"})
    g = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_samp("ra", "rb").alias("_c"), F.stddev_samp("ra").alias("_a"), F.stddev_samp("rb").alias("_b"))
    ic = F.when((F.col("n") >= least) & (F.col("_a") > 0) & (F.col("_b") > 0), F.col("_c") / (F.col("_a") * F.col("_b")))
    return g.select(*keys, "n", ic.alias("ic"))


def module_ic(samples: DataFrame, modules: list[str]) -> DataFrame:
    """(horizon, module, ic, n_eff) of samples(horizon, symbol, date, ret, x map)."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("module"), F.try_element_at("x", F.lit(m)).alias("v")) for m in modules]))
    rows = samples.select("horizon", "symbol", "date", "ret", cells.alias("e")).select("horizon", "symbol", "date", "ret", "e.module", "e.v").where("v is not null")
    return spearman(rows, ["horizon", "module"], "v", "ret").drop("n").join(n_eff(rows, ("horizon", "module")), ["horizon", "module"])


def combined_score(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """samples with s, the weighted mean of the signals whose weight is above 0; weights(horizon, module, w) is small."""
    table = weights.where("w > 0").groupBy("horizon").agg(F.map_from_entries(F.collect_list(F.struct("module", "w"))).alias("_w"))
    rows = samples.join(F.broadcast(table), "horizon")  # one row for each horizon
    used = F.filter(F.map_keys("_w"), lambda m: F.map_contains_key(F.col("x"), m))
    total = F.aggregate(used, F.lit(0.0), lambda a, m: a + F.col("_w")[m])
    value = F.aggregate(used, F.lit(0.0), lambda a, m: a + F.col("_w")[m] * F.col("x")[m])
    return rows.withColumn("s", F.when(total > 0, F.round(value / total, 9))).drop("_w")


def combined_ic(samples: DataFrame, weights: DataFrame) -> DataFrame:
    return spearman(combined_score(samples, weights), ["horizon"], "s", "ret")


def propose(ics: DataFrame, prior: DataFrame, keep_total: bool | Column = True) -> DataFrame:
    """(horizon, module, w) from ics(horizon, module, ic, n_eff) and prior(horizon, module, w).

    Weight moves from the prior to the share of the positive correlations as
    n_eff grows, stops at twice the prior, and is scaled back to the group's total.
    """
    rows = prior.withColumnRenamed("w", "w0").join(ics, ["horizon", "module"], "left")
    g = Window.partitionBy("horizon")
    ok = F.col("ic").isNotNull() & (F.col("n_eff") >= LEAST)
    positive = F.when(ok, F.greatest("ic", F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("_ok", ok).withColumn("_p", positive).withColumn("_mass", F.sum("w0").over(g)).withColumn("_tot", F.sum("_p").over(g))
    lam = F.col("n_eff") / (F.col("n_eff") + SHRINK)
    evidence = F.when(F.col("_tot") > 0, F.col("_mass") * F.col("_p") / F.col("_tot")).otherwise(0.0)
    rows = rows.withColumn("_n", F.when(F.col("_ok"), F.least((1 - lam) * F.col("w0") + lam * evidence, 2 * F.col("w0"))).otherwise(F.col("w0")))
    kept = F.lit(keep_total) if isinstance(keep_total, bool) else keep_total
    scale = F.when(kept & F.max("_ok").over(g), F.col("_mass") / F.sum("_n").over(g)).otherwise(1.0)
    return rows.select("horizon", "module", F.round(F.col("_n") * scale, 3).alias("w"))


def split_by_date(samples: DataFrame, share: float = 0.7) -> DataFrame:
    """samples with is_test: on or after the date of the floor(share * n)-th sample of the horizon, which counts by day find."""
    by_day = samples.groupBy(F.col("horizon").alias("_h"), "date").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_h")  # a row a day
    days = by_day.select("_h", "date", F.sum("_n").over(w.orderBy("date")).alias("_to"), F.floor(F.sum("_n").over(w) * share).alias("_k"))
    cuts = days.where("_to > _k").groupBy("_h").agg(F.min("date").alias("cut"))
    rows = samples.join(F.broadcast(cuts), F.col("horizon") == F.col("_h"), "left").drop("_h")  # a row for each horizon
    return rows.withColumn("is_test", F.col("date") >= F.col("cut"))


def tune(samples: DataFrame, prior: DataFrame, modules: list[str], margin: float = 0.01) -> DataFrame:
    """(horizon, ic_prior, ic_new, adopted): weights fitted on the older samples, judged on the newer ones."""
    parts = split_by_date(samples)
    fitted = propose(module_ic(parts.where("not is_test"), modules), prior)
    test = parts.where("is_test")
    old, new = combined_ic(test, prior).select("horizon", F.col("ic").alias("ic_prior")), combined_ic(test, fitted).select("horizon", F.col("ic").alias("ic_new"))
    better = F.coalesce(F.col("ic_new") >= F.col("ic_prior") + margin, F.lit(False))
    return old.join(new, "horizon", "full").withColumn("adopted", better)


def tuned_weights(samples: DataFrame, prior: DataFrame, modules: list[str], tested: list[str], margin: float = 0.01, least_live: int = 60) -> DataFrame:
    """(horizon, module, w, mode, n, n_eff, n_live, ic_prior, ic_new, adopted) for every row of prior(horizon, module, w).

    Horizons with enough independent live samples tune all modules, the others the tested ones, whose total stays.  Weights
    fitted on the older samples are judged on the newer ones; if they do better by `margin`, those fitted on all samples
    are taken, else, and where samples are too few, the prior.
    """
    c = F.col
    samples = samples if "src" in samples.columns else samples.withColumn("src", F.lit("bt"))
    live = n_eff(samples.where("src = 'live'")).withColumnRenamed("n_eff", "n_live")
    stats = samples.groupBy("horizon").agg(F.count(F.lit(1)).alias("n")).join(n_eff(samples), "horizon").join(live, "horizon", "left")
    rows = prior.join(F.broadcast(stats), "horizon", "left").na.fill(0, ["n", "n_eff", "n_live"])  # a row for each horizon
    rows = rows.withColumn("all", c("n_live") >= least_live)
    group = rows.where(c("all") | c("module").isin(*tested)).select("horizon", "module", "w", "all")

    def fitted(part: DataFrame) -> DataFrame:
        new = propose(module_ic(part, modules), group, ~c("all")).withColumnRenamed("w", "_new")
        return prior.join(new, ["horizon", "module"], "left").select("horizon", "module", F.coalesce("_new", "w").alias("w"))

    parts = split_by_date(samples)
    test = parts.where("is_test")
    old = combined_ic(test, prior).select("horizon", c("ic").alias("ic_prior"))
    new = combined_ic(test, fitted(parts.where("not is_test"))).select("horizon", c("ic").alias("ic_new"))
    final = fitted(samples).withColumnRenamed("w", "_final")
    out = rows.join(final, ["horizon", "module"]).join(old, "horizon", "left").join(new, "horizon", "left")
    changed = F.max(c("_final") != c("w")).over(Window.partitionBy("horizon"))
    adopted = changed & (c("n") >= 2 * LEAST) & F.coalesce(c("ic_new") >= c("ic_prior") + margin, F.lit(False))
    out = out.withColumn("adopted", adopted)
    return out.select("horizon", "module", F.when(c("adopted"), c("_final")).otherwise(c("w")).alias("w"), F.when(c("all"), "all").otherwise("backtest").alias("mode"), "n", "n_eff", "n_live", "ic_prior", "ic_new", "adopted")


CARD = "available boolean, score double, confidence double"
RESULT = f"modules array<struct<key string, {CARD}>>, analogs map<string, struct<{CARD}>>"


def card_signals(result: Column, horizon: Column) -> Column:
    """Map of module -> round(score * confidence, 4) from a run's result as JSON.

    Every card that is available and has both numbers is kept, of modules that nobody knows too; of cards with the same
    key the last; the analogs of the horizon stand for a card of theirs. Cards that are missing or unreadable are absent.
    """
    found = F.from_json(result, f"struct<{RESULT}>")
    able = lambda c: F.coalesce(c["available"], F.lit(False)) & c["score"].isNotNull() & c["confidence"].isNotNull()
    entry = lambda key, c: F.struct(key.alias("key"), F.round(c["score"] * c["confidence"], 4).alias("value"))
    cards = F.filter(F.coalesce(found["modules"], F.array()), lambda c: able(c) & c["key"].isNotNull() & (c["key"] != "analogs"))
    cards = F.transform(cards, lambda c: entry(c["key"], c))
    last = F.filter(cards, lambda c, i: ~F.exists(F.slice(cards, i + 2, F.greatest(F.size(cards) - i - 1, F.lit(0))), lambda d: d["key"] == c["key"]))
    own = F.try_element_at(found["analogs"], horizon)
    analog = F.when(F.coalesce(able(own), F.lit(False)), F.array(entry(F.lit("analogs"), own))).otherwise(F.slice(F.array(entry(F.lit(""), own)), 1, 0))
    return F.map_from_entries(F.concat(last, analog))


def live_samples(runs: DataFrame, bars: DataFrame) -> DataFrame:
    """(horizon, date, symbol, x, ret, src) of runs(id, symbol, created, price, result): every run is a sample of each horizon
    whose end has a price; of several runs of a symbol, day and horizon the newest stays, among those with both prices."""
    c = F.col
    rows = runs.where("price is not null and price <> 0").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in sc.HORIZON_DAYS])))
    rows = rows.withColumn("due", sc.due_date(c("created"), c("horizon")))
    rows = price_on(rows, bars, "due").where("end_price is not null")
    order = Window.partitionBy("symbol", F.to_date("created"), "horizon").orderBy(c("created").desc(), c("id").desc())
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.select("horizon", F.to_date("created").alias("date"), "symbol", card_signals(c("result"), c("horizon")).alias("x"), (c("end_price") / c("price") - 1).alias("ret"), F.lit("live").alias("src"))


def all_samples(backtest: DataFrame, live: DataFrame) -> DataFrame:
    return backtest.withColumn("src", F.lit("bt")).unionByName(live, allowMissingColumns=True)
