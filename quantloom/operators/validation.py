"""Statistical validation of strategies: folds, permutation and resampling tests, deflated Sharpe, grades."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import accounting as acc
from .draws import gathered, in_blocks, uniform
from . import metrics as met

IN, OUT, WARM = 756, 252, 252
SHIFTS = 50
EULER = 0.5772156649015329
# Grade, weight, largest p, least Sharpe, least trades, least deflated Sharpe.
GRADES = (("A", 1.0, 0.05, 0.5, 15, 0.8), ("B", 0.6, 0.10, 0.3, 8, 0.5), ("C", 0.25, 0.25, 0.0, 5, None))


def draw(seed: int, *parts: Column, below: Column) -> Column:
    """A uniform integer from 0 to below-1 that depends on its parts alone: two rounds of a 31-bit congruential step."""
    h = F.lit(seed).cast("long")
    for p in parts:
        h = ((h * 1103515245 + p.cast("long") * 12345 + 1013904223) % 2147483647 * 48271) % 2147483647
    return h % below


def folds(bars: DataFrame, in_len: int = IN, out_len: int = OUT, warm: int = WARM) -> DataFrame:
    """(symbol, fold, n, a0, a, b): in-sample [a0, a), out-of-sample [a, b), from each symbol's number of bars.

    Short histories give one 60/40 split, those with under 250 usable bars none.
    """
    g = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return g.select("symbol", "n", F.posexplode(_spans(F.col("n"), in_len, out_len, warm)).alias("fold", "x")).select("symbol", "fold", "n", "x.a0", "x.a", "x.b")


def _spans(n: Column, in_len: int = IN, out_len: int = OUT, warm: int = WARM) -> Column:
    """The folds of a history of n bars in order, (a0, a, b) each; null where there are none."""
    w = F.least(F.lit(warm), F.floor(n / 5))
    usable = n - w
    one = F.array(F.struct(w.alias("a0"), (w + F.floor(usable * 0.6)).alias("a"), n.alias("b")))
    last = F.floor((n - w - in_len - 1) / out_len)
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))), lambda k: F.struct((w + k * out_len).alias("a0"), (w + k * out_len + in_len).alias("a"), F.least(w + k * out_len + in_len + out_len, n).alias("b")))
    return F.when(usable >= 250, F.when(usable < in_len + out_len, one).otherwise(many))


def with_folds(rows: DataFrame) -> DataFrame:
    """rows(symbol, i, a row for each bar) with n, the symbol's bars, ins, the folds that have the bar in sample, and fold, the one
    that has it out of sample: what a join with `folds` gives, without one."""
    c = F.col
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).withColumn("_spans", _spans(c("n")))
    at = F.transform("_spans", lambda x, k: F.struct(k.alias("k"), x["a0"].alias("a0"), x["a"].alias("a"), x["b"].alias("b")))
    own = lambda lo, hi: F.transform(F.filter(at, lambda x: (c("i") >= x[lo]) & (c("i") < x[hi])), lambda x: x["k"])
    return rows.withColumn("ins", own("a0", "a")).withColumn("fold", F.get(own("a", "b"), F.lit(0))).drop("_spans")


def picks(chosen: DataFrame) -> DataFrame:
    """(symbol, picked): a row for each symbol, the variant of each strategy in each fold."""
    g = chosen.groupBy("symbol", "fold").agg(F.map_from_entries(F.collect_list(F.struct("strategy", "variant"))).alias("v"))
    return g.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("fold", "v"))).alias("picked"))


def stitched(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """walk_forward of accounting.wide_returns with folds: only chosen variants of a bar become rows."""
    c = F.col
    rows = cells.where("fold is not null").join(picks(chosen), "symbol").withColumn("_v", F.try_element_at("picked", c("fold"))).where("_v is not null")
    mine = F.filter("names", lambda x: F.try_element_at(c("_v"), x["strategy"]) == x["variant"])
    return acc.unfolded(rows, ["symbol", "fold", "date", "i", "close", "open"], mine)


def argmax_variant(scores: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the largest score of each key; the first variant on ties."""
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col("variant"))
    return scores.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def numbered(returns: DataFrame) -> DataFrame:
    """returns with the bar number i of its key, which a stored table has already."""
    return returns if "i" in returns.columns else returns.withColumn("i", F.row_number().over(acc.order()) - 1)


def numbered_bars(bars: DataFrame) -> DataFrame:
    """bars with their number i."""
    return bars.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1)


def _in_fold(returns: DataFrame, fold_table: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows of each fold's span: a join on symbol that keeps only rows inside, whose way Spark picks by the table's size."""
    f = fold_table.select(F.col("symbol").alias("_symbol"), "fold", F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    inside = (F.col("symbol") == F.col("_symbol")) & (F.col("i") >= F.col("_lo")) & (F.col("i") < F.col("_hi"))
    return returns.join(f, inside).drop("_symbol", "_lo", "_hi")


def chosen_variants(returns: DataFrame, fold_table: DataFrame) -> DataFrame:
    """(symbol, strategy, fold, variant, is_sharpe): the best variant in sample."""
    rows = returns.withColumn("fold", F.explode("ins")) if "ins" in returns.columns else _in_fold(numbered(returns), fold_table, "a0", "a")
    scores = rows.groupBy("symbol", "strategy", "fold", "variant").agg(F.round(met.sharpe(), 9).alias("is_sharpe"))
    return argmax_variant(scores, ["symbol", "strategy", "fold"], "is_sharpe")


def walk_forward(returns: DataFrame, fold_table: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(symbol, strategy, fold, date, i, variant, held, ret, close): out-of-sample rows of the chosen variants, stitched."""
    chosen = chosen if chosen is not None else chosen_variants(returns, fold_table)
    rows = _in_fold(numbered(returns), fold_table, "a", "b")
    keys = ["symbol", "strategy", "fold", "variant"]
    return rows.join(chosen.select(*keys), keys).select("symbol", "strategy", "fold", "date", "i", "variant", "held", "ret", "close", "open")


def wf_efficiency(returns: DataFrame, fold_table: DataFrame, chosen: DataFrame | None = None, oos: DataFrame | None = None) -> DataFrame:
    """Mean out-of-sample Sharpe over mean in-sample Sharpe; null if that is not positive."""
    chosen = chosen if chosen is not None else chosen_variants(returns, fold_table)
    oos = oos if oos is not None else walk_forward(returns, fold_table, chosen)
    oos = oos.groupBy("symbol", "strategy", "fold").agg(met.sharpe().alias("oos_sharpe"))
    g = chosen.join(oos, ["symbol", "strategy", "fold"]).groupBy("symbol", "strategy").agg(F.avg("is_sharpe").alias("is_mean"), F.avg("oos_sharpe").alias("oos_mean"))
    return g.withColumn("efficiency", F.when(F.col("is_mean") > 0, F.col("oos_mean") / F.col("is_mean")))


def oos_trades(trades: DataFrame, bars: DataFrame, fold_table: DataFrame, chosen: DataFrame) -> DataFrame:
    """Closed trades of a fold's chosen variant that begin inside it; trades may have the fold already."""
    if "fold" in trades.columns:
        rows = trades.where("not is_open and fold is not null").join(picks(chosen), "symbol")
        return rows.where(F.try_element_at(F.try_element_at("picked", F.col("fold")), F.col("strategy")) == F.col("variant")).drop("picked", "i")
    at = bars.select("symbol", F.col("date").alias("entry"), (F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1).alias("i"))
    rows = _in_fold(trades.where("not is_open").join(at, ["symbol", "entry"]), fold_table, "a", "b")
    keys = ["symbol", "strategy", "fold", "variant"]
    return rows.join(chosen.select(*keys), keys)


def permutation_p(oos: DataFrame, n_perm: int = 1000, fee: float = acc.FEE, rate: float = acc.RATE, seed: int = 7) -> DataFrame:
    """(symbol, strategy, p): share of circular shifts of the held array that do at least as well; null for short or constant ones.

    Held and market arrays of a key are gathered once, a thousand-odd doubles each, and dealt out
    once; its task makes SHIFTS shifts at a time in numpy, so no array is sent for a shift or block.
    """
    c = F.col
    order = Window.partitionBy("symbol", "strategy").orderBy("i")
    market = F.coalesce(c("close") / c("_prev") - 1, F.lit(0.0))
    rows = oos.withColumn("mkt", market) if "_prev" in oos.columns else oos.withColumn("_prev", F.lag("close").over(order)).withColumn("mkt", market)
    g = rows.groupBy("symbol", "strategy").agg(F.array_sort(F.collect_list(F.struct("i", "held", "mkt"))).alias("x"))
    g = g.select("symbol", "strategy", F.transform("x", lambda e: e["held"].cast("double")).alias("h"), F.transform("x", lambda e: e["mkt"]).alias("m"))
    spark = oos.sparkSession
    # A given number, as adaptive execution would put these few bytes, but much work, into one task.
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def ratios(held: np.ndarray, market: np.ndarray) -> np.ndarray:
        ret = held * market + (1 - held) * rate
        ret[:, 1:] -= fee * np.abs(np.diff(held, axis=1))
        varied = ret.max(axis=1) > ret.min(axis=1)
        return np.where(varied, np.round((ret.mean(axis=1) - rate) / np.where(varied, ret.std(axis=1, ddof=1), 1.0), 9), 0.0)

    def share(held: np.ndarray, market: np.ndarray) -> float | None:
        n = len(held)
        if n < 120 or held.min() == held.max():
            return None
        turned = np.lib.stride_tricks.sliding_window_view(np.concatenate([held, held]), n)
        actual, better = ratios(held[None, :], market)[0], 0
        for first in range(1, n_perm + 1, SHIFTS):
            by = 20 + uniform(seed, np.arange(first, min(first + SHIFTS, n_perm + 1))) % (n - 40)
            better += int((ratios(turned[n - by], market) >= actual).sum())
        return (1 + better) / (n_perm + 1)

    def run(batches):
        for batch in batches:
            h, m = batch.column(2), batch.column(3)
            p = [share(*(x[k].values.to_numpy(zero_copy_only=False) for x in (h, m))) for k in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p, pa.float64())], names=["symbol", "strategy", "p"])

    kinds = ", ".join(f"{k} {g.schema[k].dataType.simpleString()}" for k in ("symbol", "strategy"))
    return g.repartition(tasks, "symbol", "strategy").mapInArrow(run, f"{kinds}, p double")


def random_day_p(trades: DataFrame, baseline: DataFrame, n_draws: int = 1000, seed: int = 7) -> DataFrame:
    """(symbol, strategy, p): how often as many random days of baseline(symbol, i, ret) do at least as well as the trades."""
    keys = ["symbol", "strategy"]
    pool = gathered(baseline.where("ret is not null"), ["symbol"], ["i"], "ret")
    g = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("actual")).join(pool, "symbol").where((F.col("n") >= 10) & (F.size("values") >= 30))

    def means(values, draws, salt, numbers):
        place = np.arange(1, int(numbers[0]) + 1)
        return [values[uniform(seed, draws[:, None], place[None, :]) % len(values)].mean(axis=1)]

    sims = in_blocks(g, [*keys, "actual"], n_draws, 1, F.lit(0), [F.col("n")], means, "sim double")
    return sims.groupBy(*keys).agg(((1 + F.count_if(F.round("sim", 12) >= F.round("actual", 12))) / (n_draws + 1)).alias("p"))


def trade_bootstrap(trades: DataFrame, n_draws: int = 1000, seed: int = 7) -> DataFrame:
    """(symbol, strategy, …): percentiles of end value and drawdown when the trades are drawn again; five trades at least."""
    keys = ["symbol", "strategy"]
    pool = gathered(trades, keys, ["entry", "variant"], "ret").where(F.size("values") >= 5)

    def curves(values, draws, salt, numbers):
        place = np.arange(1, len(values) + 1)
        equity = np.cumprod(1 + values[uniform(seed, draws[:, None], place[None, :]) % len(values)], axis=1)
        return [equity[:, -1] - 1, (equity / np.maximum(np.maximum.accumulate(equity, axis=1), 1.0) - 1).min(axis=1)]

    ends = in_blocks(pool, keys, n_draws, 1, F.lit(0), [], curves, "final double, mdd double")
    q = lambda col, p: F.percentile(col, F.lit(p))
    return ends.groupBy(*keys).agg(q("final", 0.05).alias("ret_p5"), q("final", 0.5).alias("ret_p50"), q("final", 0.95).alias("ret_p95"), q("mdd", 0.05).alias("mdd_p5"), q("mdd", 0.5).alias("mdd_p50"))


# The double-precision rational approximation of the normal distribution published by Hart (1968) and West (2005).
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_FAR = 7.07106781186547


def normal_cdf(x: Column | str) -> Column:
    """Φ(x) in column expressions, to about fifteen digits."""
    x = F.col(x) if isinstance(x, str) else x
    z = F.abs(x)

    def polynomial(factors: tuple[float, ...]) -> Column:
        out = F.lit(factors[0])
        for f in factors[1:]:
            out = out * z + f
        return out

    far = z + 0.65
    for k in (4, 3, 2, 1):
        far = z + k / far
    near = polynomial(CDF_TOP) / polynomial(CDF_BOTTOM)
    tail = F.exp(-z * z / 2) * F.when(z < CDF_FAR, near).otherwise(1 / (far * math.sqrt(2 * math.pi)))
    tail = F.when(z > 37, F.lit(0.0)).otherwise(tail)
    return F.when(x.isNotNull(), F.when(x > 0, 1 - tail).otherwise(tail))


def psr(moments: DataFrame, star: Column | float = 0.0) -> DataFrame:
    """moments(…, n, mean, sd, skew, kurt) with psr: the probability that the true ratio exceeds `star`."""
    star = F.lit(star) if isinstance(star, float) else star
    sr = F.try_divide(F.col("mean"), F.col("sd"))
    room = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    ok = (F.col("n") >= 30) & (F.col("sd") > 0) & (room > 0)
    return moments.withColumn("psr", F.coalesce(normal_cdf(F.when(ok, (sr - star) * F.sqrt(F.col("n") - 1) / F.sqrt(room))), F.lit(0.0)))


def expected_max_factor(trials: int) -> float:
    """Expected largest of `trials` standard normals, by the public approximation."""
    if trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    return (1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e))


def expected_max_sr(returns: DataFrame, trials: int) -> DataFrame:
    """(symbol, sr0) from the spread of all variants' per-period ratios."""
    srs = returns.groupBy(*acc.KEYS).agg(met.period_sharpe().alias("sr"))
    return srs.groupBy("symbol").agg((F.sqrt(F.var_samp("sr")) * expected_max_factor(trials)).alias("sr0"))


def deflated_sharpe(returns: DataFrame, trials: int) -> DataFrame:
    """(symbol, strategy, variant, dsr) of each strategy's best variant over the whole history, three decimals."""
    m = met.moments(returns, acc.KEYS, F.round(met.sharpe(), 3).alias("s"), met.period_sharpe().alias("sr"))  # one pass
    m = m.withColumn("sr0", F.sqrt(F.var_samp("sr").over(Window.partitionBy("symbol"))) * expected_max_factor(trials))
    return psr(argmax_variant(m, ["symbol", "strategy"], "s"), F.col("sr0")).select(*acc.KEYS, F.round("psr", 3).alias("dsr"))


def graded(rows: DataFrame) -> DataFrame:
    """rows(p, oos_sharpe, oos_trades, dsr) with grade and weight; the lowest passing grade needs a Sharpe above 0."""
    c = F.col
    grade, weight = None, None
    for name, w, p, s, n, d in GRADES:
        ok = c("p").isNotNull() & (c("p") <= p) & (c("oos_trades") >= n) & ((c("oos_sharpe") > s) if s == 0 else (c("oos_sharpe") >= s))
        ok = ok if d is None else ok & (c("dsr") >= d)
        grade = F.when(ok, name) if grade is None else grade.when(ok, name)
        weight = F.when(ok, w) if weight is None else weight.when(ok, w)
    return rows.withColumn("grade", grade.otherwise("F")).withColumn("weight", weight.otherwise(0.0))


def current_signal(returns: DataFrame, positions: DataFrame, families: DataFrame, recent: int = IN) -> DataFrame:
    """(symbol, strategy, variant, decision, vote): the best variant of the newest bars and what it says now."""
    c = F.col
    back = Window.partitionBy(*acc.KEYS).orderBy(c("date").desc())
    tail = returns.where(c("i") >= c("n") - recent) if "n" in returns.columns else returns.withColumn("_r", F.row_number().over(back)).where(c("_r") <= recent)
    best = argmax_variant(tail.groupBy(*acc.KEYS).agg(F.round(met.sharpe(), 9).alias("s")), ["symbol", "strategy"], "s").select(*acc.KEYS)
    now = positions.groupBy(*acc.KEYS).agg(F.max_by("value", "date").alias("decision"))
    rows = best.join(now, acc.KEYS).join(F.broadcast(families), "strategy")  # a row for each strategy
    vote = F.when(c("family") == "day", 0.0).when(c("decision") >= 0.5, 1.0).when(c("family") == "trend", -1.0).otherwise(0.0)
    return rows.select(*acc.KEYS, "decision", vote.alias("vote"))


def strategy_score(graded_rows: DataFrame) -> DataFrame:
    """(symbol, score, confidence) from rows(symbol, family, weight, vote) of strategies that passed."""
    used = graded_rows.where((F.col("weight") > 0) & (F.col("family") != "day"))
    g = used.groupBy("symbol").agg(F.sum(F.col("weight") * F.col("vote")).alias("v"), F.sum("weight").alias("w"))
    return g.select("symbol", (F.col("v") / F.col("w")).alias("score"), F.least(F.lit(1.0), F.col("w") / 2).alias("confidence"))


def vote_weights(graded_rows: DataFrame) -> DataFrame:
    used = graded_rows.where((F.col("weight") > 0) & (F.col("family") != "day"))
    return used.groupBy("symbol", F.signum("vote").cast("int").alias("side")).agg(F.sum("weight").alias("weight"))


def rank_strategies(graded_rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("symbol").orderBy(F.col("weight").desc(), F.coalesce("oos_sharpe", F.lit(-9.0)).desc(), "strategy")
    return graded_rows.withColumn("rank", F.row_number().over(order))


def strategy_report(returns: DataFrame, trades: DataFrame, bars: DataFrame, positions: DataFrame, grid: DataFrame, day_returns: DataFrame, trials: int, n_perm: int = 1000, n_draws: int = 1000, marks_since: Column | None = None, chosen: DataFrame | None = None, oos: DataFrame | None = None) -> DataFrame:
    """One row for each symbol and strategy with folds: the whole chain from walk-forward to grade, weight and vote.

    returns, trades and positions are those of all variants, written tables as they are read in many branches; grid is
    the table of variants; day_returns(symbol, i, ret) the open-to-open returns that a day strategy's trades compete with.
    """
    c, keys = F.col, ["symbol", "strategy"]
    fold_table = folds(bars)
    chosen = chosen if chosen is not None else written(chosen_variants(returns, fold_table), "chosen")
    oos = written(oos if oos is not None else walk_forward(returns, fold_table, chosen), "oos")
    own = written(oos_trades(trades, bars, fold_table, chosen), "oos_trades")
    families = grid.select("strategy", "family", "kind").distinct()  # a row for each strategy
    held = oos.join(F.broadcast(families.where("kind = 'position'").select("strategy")), "strategy")
    days = own.join(F.broadcast(families.where("kind = 'breakout'").select("strategy")), "strategy")
    by_fold = oos.groupBy(*keys, "fold").agg(met.sharpe().alias("x")).join(chosen, [*keys, "fold"])
    efficiency = by_fold.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.avg("is_sharpe").alias("is_mean"), F.avg("x").alias("oos_mean"))
    p = permutation_p(held, n_perm).unionByName(random_day_p(days, _in_fold(day_returns, fold_table, "a", "b"), n_draws))
    out = oos.groupBy(*keys).agg(met.sharpe().alias("oos_sharpe"), (F.product(1 + c("ret")) - 1).alias("oos_return"), F.avg("held").alias("oos_exposure"))
    counts = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("oos_trades"), F.avg((c("ret") > 0).cast("double")).alias("oos_win_rate"))
    rows = out.join(efficiency, keys).join(p, keys, "left").join(counts, keys, "left").join(trade_bootstrap(own, n_draws), keys, "left")
    rows = rows.join(deflated_sharpe(returns, trials).withColumnRenamed("variant", "best_variant"), keys, "left")
    signal = current_signal(returns, positions, families.select("strategy", "family"))
    rows = rows.join(signal.withColumnRenamed("variant", "current_variant"), keys, "left").join(F.broadcast(families.select("strategy", "family")), "strategy")
    if marks_since is not None:
        shown = markers(trades, marks_since).groupBy(*acc.KEYS).agg(F.count(F.lit(1)).alias("markers")).withColumnRenamed("variant", "current_variant")
        rows = rows.join(shown, [*keys, "current_variant"], "left").withColumn("markers", F.coalesce("markers", F.lit(0)))
    rows = rows.withColumn("efficiency", F.when(c("is_mean") > 0, c("oos_mean") / c("is_mean"))).withColumn("oos_trades", F.coalesce("oos_trades", F.lit(0)))
    return graded(rows)


def markers(trades: DataFrame, since: Column, limit: int = 60) -> DataFrame:
    """(keys, time, side, price): buys and sells of trades that began on or after `since`, the newest `limit` of each key."""
    rows = trades.where(F.col("entry") >= since)
    buy = F.struct(F.col("entry").alias("time"), F.lit("buy").alias("side"), F.col("entry_px").alias("price"))
    sell = F.when(~F.col("is_open"), F.struct(F.col("exit").alias("time"), F.lit("sell").alias("side"), F.col("exit_px").alias("price")))
    flat = rows.select(*acc.KEYS, "entry", F.explode(F.array_compact(F.array(buy, sell))).alias("m"))
    order = Window.partitionBy(*acc.KEYS).orderBy(F.col("entry").desc(), F.col("m.side").desc())
    return flat.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select(*acc.KEYS, "m.time", "m.side", "m.price")
