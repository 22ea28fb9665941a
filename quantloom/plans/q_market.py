"""Queries of bars, indicators, strategies, accounting and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import accounting as acc
from ..operators import indicators as ind
from ..operators import metrics as met
from ..operators import smooth
from ..operators import strategies as st
from . import oracle as o
from .registry import Panels, query

c = F.col
W = o.OVER
OWN = "symbol, date"


@query("SELECT symbol, date, open, high, low, close, volume FROM bars")
def s2_make_bars(t: Panels) -> DataFrame:
    return t.bars


@query("SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(coalesce(volume, 0), 6) AS volume FROM bars WHERE open IS NOT NULL AND close IS NOT NULL")
def s1_read_bars(t: Panels) -> DataFrame:
    from ..sources.tables import clean_bars

    return clean_bars(t.bars)


@query("SELECT date, value FROM series WHERE series_id = 'INDEX'")
def s3_read_series(t: Panels) -> DataFrame:
    from ..sources.tables import one_series

    return one_series(t.series, "INDEX")


@query(f"SELECT {OWN}, close / lag(close) {W} - 1 AS ret1, ln(close) - ln(lag(close) {W}) AS log_ret, close / lag(close, 63) {W} - 1 AS ret63 FROM bars")
def p5_returns(t: Panels) -> DataFrame:
    return t.bars.select("symbol", "date", ind.change("close").alias("ret1"), ind.log_return().alias("log_ret"), ind.change("close", 63).alias("ret63"))


@query(f"SELECT {OWN}, lead(close, 21) {W} / close - 1 AS fwd21 FROM bars")
def p6_forward_return(t: Panels) -> DataFrame:
    return t.bars.select("symbol", "date", ind.forward_return(21).alias("fwd21"))


@query(f"SELECT {OWN}, i FROM (SELECT symbol, date, row_number() {W} - 1 AS i, lead(close, 21) {W} AS f FROM bars) WHERE i >= 504 AND (i - 504) % 21 = 0 AND f IS NOT NULL")
def p7_sample_dates(t: Panels) -> DataFrame:
    from ..plans.backtest import sample_dates

    return sample_dates(t.bars, 21)


@query(f"SELECT {OWN}, {o.sma('close', 20)} AS sma20, {o.sma('close', 100)} AS sma100 FROM bars")
def w1_sma(t: Panels) -> DataFrame:
    return t.bars.select("symbol", "date", ind.sma("close", 20).alias("sma20"), ind.sma("close", 100).alias("sma100"))


@query(f"SELECT {OWN}, e12 AS ema12, e26 AS ema26 FROM smooth1", o.FRAGMENTS)
def w2_ema(t: Panels) -> DataFrame:
    return smooth.with_smoothed(t.bars, ["ema12", "ema26"]).select("symbol", "date", "ema12", "ema26")


@query(f"SELECT {OWN}, w14 AS wilder14 FROM smooth1", o.FRAGMENTS)
def w3_wilder(t: Panels) -> DataFrame:
    return smooth.with_smoothed(t.bars, ["wilder14"]).select("symbol", "date", "wilder14")


@query(f"SELECT {OWN}, rsi14, rsi2 FROM smooth2", o.FRAGMENTS)
def w4_rsi(t: Panels) -> DataFrame:
    return smooth.with_smoothed(t.bars, ["rsi14", "rsi2"]).select("symbol", "date", "rsi14", "rsi2")


@query(f"SELECT {OWN}, round(m12, 6) AS line, round(s12, 6) AS signal, round(m12 - s12, 6) AS histogram FROM ind", o.FRAGMENTS)
def w5_macd(t: Panels) -> DataFrame:
    rows = smooth.with_smoothed(t.bars, ["macd_12_26_9"])
    line, sig = c("macd_12_26_9_line"), c("macd_12_26_9_signal")
    # The two engines sum in another order, and differences of near values keep less than nine digits.
    return rows.select("symbol", "date", F.round(line, 6).alias("line"), F.round(sig, 6).alias("signal"), F.round(line - sig, 6).alias("histogram"))


@query(f"SELECT {OWN}, sma20 AS mid, up20 AS upper, lo20 AS lower FROM sig1", o.FRAGMENTS)
def w6_bollinger(t: Panels) -> DataFrame:
    mid, up, low = ind.bollinger("close")
    return t.bars.select("symbol", "date", mid.alias("mid"), up.alias("upper"), low.alias("lower"))


@query(f"SELECT {OWN}, tr AS true_range FROM moved", o.FRAGMENTS)
def w7_true_range(t: Panels) -> DataFrame:
    return t.bars.select("symbol", "date", ind.true_range().alias("true_range"))


@query(f"SELECT {OWN}, atr14 FROM smooth1", o.FRAGMENTS)
def w8_atr(t: Panels) -> DataFrame:
    return smooth.with_smoothed(t.bars, ["atr14"]).select("symbol", "date", "atr14")


@query(f"SELECT {OWN}, adx14 FROM ind", o.FRAGMENTS)
def w9_adx(t: Panels) -> DataFrame:
    return smooth.with_smoothed(t.bars, ["adx14"]).select("symbol", "date", "adx14")


@query(f"SELECT {OWN}, obv FROM smooth1", o.FRAGMENTS)
def w10_obv(t: Panels) -> DataFrame:
    return ind.with_obv(t.bars).select("symbol", "date", "obv")


@query(f"SELECT {OWN}, high20, low10 FROM sig0", o.FRAGMENTS)
def w11_donchian(t: Panels) -> DataFrame:
    high, low = ind.donchian(20, 10)
    return t.bars.select("symbol", "date", high.alias("high20"), low.alias("low10"))


@query(f"SELECT {OWN}, donchian_0 AS held FROM sig", o.FRAGMENTS)
def w12_hold_state(t: Panels) -> DataFrame:
    high, low = ind.donchian(20, 10)
    rows = t.bars.select("*", high.alias("h"), low.alias("l"))
    return rows.select("symbol", "date", ind.hold_state(c("close") > c("h"), c("close") < c("l")).alias("held"))


@query(f"SELECT {OWN}, coalesce(close > sma20 AND pc <= psma, false) AS crossed FROM (SELECT *, lag(sma20) {W} AS psma FROM sig0)", o.FRAGMENTS)
def w13_cross_above(t: Panels) -> DataFrame:
    rows = t.bars.select("symbol", "date", "close", ind.sma("close", 20).alias("avg"))
    return rows.select("symbol", "date", ind.crosses_above(c("close"), c("avg")).alias("crossed"))


CURVE = "SELECT symbol, date, product(1 + ret) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM pos_ret WHERE strategy = 'sma_cross' AND variant = 2"


def _curve(t: Panels) -> DataFrame:
    pos = st.stacked(st.wide_signals(t.bars, ["sma_cross"]), ["sma_cross"]).where("variant = 2")
    return ind.equity(acc.position_returns(pos), ["symbol"])


@query(f"SELECT symbol, date, round(equity, 9) AS equity, round(equity / max(equity) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 9) AS drawdown FROM ({CURVE})", o.FRAGMENTS)
def w14_equity(t: Panels) -> DataFrame:
    return _curve(t).select("symbol", "date", F.round("equity", 9).alias("equity"), F.round("drawdown", 9).alias("drawdown"))


@query("SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE i % greatest(1, n // 200) = 0 OR i = n - 1")
def w15_downsample(t: Panels) -> DataFrame:
    return ind.downsample(t.bars.select("symbol", "date", "close"), ["symbol"], 200)


@query(
    f"""WITH p AS (SELECT symbol, date, i, trend_filter_2 AS pos, lag(trend_filter_2) {W} AS was FROM sig),
    q AS (SELECT *, i - last_value(CASE WHEN pos <> was THEN i END IGNORE NULLS) {o.UP} AS since FROM p)
    SELECT symbol, date, pos, since, coalesce(since <= 2, false) AS fresh FROM q""",
    o.FRAGMENTS,
)
def w16_signal_age(t: Panels) -> DataFrame:
    rows = st.wide_signals(t.bars, ["trend_filter"]).select("symbol", "date", c("trend_filter_2").alias("pos"))
    return ind.signal_age(rows, ["symbol"])


@query("SELECT id, horizon, rank() OVER (PARTITION BY horizon ORDER BY confidence) + (count(*) OVER (PARTITION BY horizon, confidence) - 1) / 2.0 AS avg_rank FROM runs")
def w17_average_rank(t: Panels) -> DataFrame:
    from ..operators.ranks import with_average_ranks

    return with_average_ranks(t.runs.select("id", "horizon", "confidence"), ["horizon"], {"confidence": "avg_rank"}).drop("confidence")


@query(
    """WITH s AS (SELECT symbol, stmt, item, period_end, value, row_number() OVER (PARTITION BY symbol, stmt, item ORDER BY period_end DESC) - 1 AS i FROM statements)
    SELECT a.symbol, a.item, a.value, CASE WHEN a.value > 0 AND b.value > 0 THEN pow(a.value / b.value, 1.0 / 3) - 1 END AS cagr3
    FROM s a LEFT JOIN s b ON a.symbol = b.symbol AND a.stmt = b.stmt AND a.item = b.item AND b.i = 3 WHERE a.i = 0"""
)
def w18_cagr(t: Panels) -> DataFrame:
    from ..operators.fundamentals import growth

    return growth(t.statements, 3)


STATE = f"CASE WHEN sma200 IS NOT NULL AND mom63 IS NOT NULL AND rsi14 IS NOT NULL THEN CASE WHEN close > sma200 THEN 100 ELSE 0 END + CASE WHEN mom63 > 0 THEN 10 ELSE 0 END + CASE WHEN rsi14 < 30 THEN 0 WHEN rsi14 > 70 THEN 2 ELSE 1 END END"


@query(f"SELECT {OWN}, {STATE} AS state FROM sig0", o.FRAGMENTS)
def w19_market_state(t: Panels) -> DataFrame:
    rows = smooth.with_smoothed(t.bars, ["rsi14"])
    return rows.select("symbol", "date", ind.market_state(c("rsi14")).alias("state"))


LEVELS = f"""SELECT symbol, date, close, sma20, sma50, sma200, up20 AS bb_up, lo20 AS bb_low, max(high) {o.frame(20)} AS high20, min(low) {o.frame(20)} AS low20,
    max(close) {o.frame(252)} AS high52w, min(close) {o.frame(252)} AS low52w FROM (SELECT symbol, date, close, high, low, sma20, sma50, sma200, up20, lo20 FROM sig1)"""


@query(LEVELS, o.FRAGMENTS)
def w22_price_levels(t: Panels) -> DataFrame:
    return ind.price_levels(t.bars)


def _strategy_query(key: str, name: str) -> None:
    variants = [n for n in o.POSITION_NAMES if n.rsplit("_", 1)[0] == key]
    sql = f"SELECT symbol, date, strategy, variant, pos AS value FROM pos WHERE strategy = '{key}'" if variants else "SELECT symbol, date, strategy, variant, level AS value FROM brk0"

    def run(t: Panels) -> DataFrame:
        return st.stacked(st.wide_signals(t.bars, [key]), [key]).select("symbol", "date", "strategy", "variant", "value")

    run.__name__ = name
    query(sql, o.FRAGMENTS)(run)


for _n, _key in enumerate(("sma_cross", "macd", "rsi_cross", "bollinger", "obv", "combined", "donchian", "ts_momentum", "trend_filter", "rsi2", "vol_breakout"), 1):
    _strategy_query(_key, f"st{_n}_{_key}")


@query("SELECT strategy, variant, count(*) AS bars, sum(value) AS total FROM (SELECT symbol, date, strategy, variant, pos AS value FROM pos UNION ALL SELECT symbol, date, strategy, variant, NULL FROM brk0) GROUP BY 1, 2", o.FRAGMENTS)
def x2_run_strategies(t: Panels) -> DataFrame:
    rows = st.stacked(st.wide_signals(t.bars), list(st.STRATEGIES))
    value = F.when(c("strategy") != "vol_breakout", c("value"))
    return rows.groupBy("strategy", "variant").agg(F.count(F.lit(1)).alias("bars"), F.sum(value).alias("total"))


@query(f"SELECT {OWN}, CASE WHEN close > sma50 AND sma50 > sma200 THEN 1.0 ELSE 0.0 END AS value FROM sig0", o.FRAGMENTS)
def x1_own_strategy(t: Panels) -> DataFrame:
    def stacked_trend(p: dict) -> st.Rule:
        a, b = f"sma{p['fast']}", f"sma{p['slow']}"
        return st.Rule({a: ind.sma("close", p["fast"]), b: ind.sma("close", p["slow"])}, position=(c("close") > c(a)) & (c(a) > c(b)))

    st.register_strategy("own_stack", "trend", "position", ({"fast": 50, "slow": 200},), stacked_trend)
    try:
        rows = st.stacked(st.wide_signals(t.bars, ["own_stack"]), ["own_stack"])
    finally:
        del st.STRATEGIES["own_stack"]
    return rows.select("symbol", "date", "value")


@query("SELECT symbol, close, sma20, sma50, sma200, obv, rsi14 FROM sig0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1", o.FRAGMENTS)
def x3_signal_levels(t: Panels) -> DataFrame:
    rows = ind.with_obv(smooth.with_smoothed(t.bars, ["rsi14"]))
    rows = rows.select("symbol", "date", "close", *[ind.sma("close", n).alias(f"sma{n}") for n in (20, 50, 200)], "obv", "rsi14")
    return ind.newest(rows).drop("date")


def all_positions(t: Panels) -> DataFrame:
    return acc.position_returns(st.stacked(t.wide, st.position_keys()))


def all_breakouts(t: Panels) -> DataFrame:
    return st.stacked(t.wide, st.breakout_keys())


def all_returns(t: Panels) -> DataFrame:
    """Returns of all variants of all strategies."""
    keep = ["symbol", "date", "strategy", "variant", "open", "close", "held", "ret"]
    return all_positions(t).select(*keep).unionByName(acc.breakout_returns(all_breakouts(t)).select(*keep))


def all_trades(t: Panels) -> DataFrame:
    return acc.extract_trades(all_positions(t)).unionByName(acc.breakout_trades(all_breakouts(t)))


@query("SELECT symbol, date, strategy, variant, held, ret FROM pos_ret", o.FRAGMENTS)
def b1_position_returns(t: Panels) -> DataFrame:
    return all_positions(t).select("symbol", "date", "strategy", "variant", "held", "ret")


@query("SELECT symbol, date, strategy, variant, held, ret FROM brk_ret", o.FRAGMENTS)
def b2_breakout_returns(t: Panels) -> DataFrame:
    return acc.breakout_returns(all_breakouts(t)).select("symbol", "date", "strategy", "variant", "held", "ret")


@query("SELECT symbol, strategy, variant, entry, exit, entry_px, exit_px, days, is_open, exit_px * (1 - 0.0005) / (entry_px * (1 + 0.0005)) - 1 AS ret FROM pos_trades", o.FRAGMENTS)
def b3_extract_trades(t: Panels) -> DataFrame:
    return acc.extract_trades(all_positions(t))


@query("SELECT symbol, strategy, variant, entry, exit, entry_px, exit_px, days, is_open, ret FROM trades WHERE strategy = 'vol_breakout'", o.FRAGMENTS)
def b4_breakout_trades(t: Panels) -> DataFrame:
    return acc.breakout_trades(all_breakouts(t))


HOLD = f"""SELECT symbol, date, close, held, CASE WHEN pc IS NULL THEN 0.0 ELSE (1 + CASE WHEN i > 1 THEN open / pc - 1 ELSE 0 END) * (close / open) - 1 - CASE WHEN i = 1 THEN 0.0005 ELSE 0 END END AS ret
    FROM (SELECT *, CASE WHEN i = 0 THEN 0.0 ELSE 1.0 END AS held FROM moves)"""


@query(f"SELECT symbol, date, held, ret FROM ({HOLD})", o.FRAGMENTS)
def b5_buy_hold(t: Panels) -> DataFrame:
    return acc.buy_hold(t.bars).select("symbol", "date", "held", "ret")


APPROX = "SELECT symbol, date, strategy, variant, held, held * coalesce(close / pclose - 1, 0) + (1 - held) * 0.0001 - 0.0005 * abs(held - coalesce(lag(held) OVER (PARTITION BY symbol, strategy, variant ORDER BY date), held)) AS ret FROM held1"


@query(f"SELECT symbol, date, strategy, variant, ret FROM ({APPROX}) WHERE strategy = 'sma_cross'", o.FRAGMENTS)
def b6_approximate_returns(t: Panels) -> DataFrame:
    held = acc.position_returns(st.stacked(st.wide_signals(t.bars, ["sma_cross"]), ["sma_cross"])).drop("ret")
    return acc.approximate_returns(held).select("symbol", "date", "strategy", "variant", "ret")


KEYS = "symbol, strategy, variant"
SHARPE = "CASE WHEN count(ret) >= 20 AND stddev_samp(ret) > 0 THEN avg(ret - 0.0001) / stddev_samp(ret) * sqrt(252) ELSE 0 END"
PERIOD = "CASE WHEN stddev_samp(ret) > 0 THEN avg(ret - 0.0001) / stddev_samp(ret) ELSE 0 END"
METRICS = f"""WITH eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY {KEYS} ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM all_ret),
  dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY {KEYS} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq),
  g AS (SELECT {KEYS}, max_by(equity, date) AS e, count(*) AS n, stddev_samp(ret) AS sd, {SHARPE} AS sharpe, avg(ret - 0.0001) AS mean, sqrt(avg(pow(least(ret - 0.0001, 0), 2))) AS down,
    min(drawdown) AS max_drawdown, avg(held) AS exposure FROM dd GROUP BY {KEYS}),
  t AS (SELECT {KEYS}, count(*) AS trades, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, coalesce(sum(ret) FILTER (ret > 0), 0) AS won, coalesce(-sum(ret) FILTER (ret <= 0), 0) AS lost,
    coalesce(avg(ret) FILTER (ret > 0), 0) AS avg_win, coalesce(avg(ret) FILTER (ret <= 0), 0) AS avg_loss, avg(days) AS avg_days FROM trades WHERE NOT is_open GROUP BY {KEYS}),
  h AS (SELECT *, CASE WHEN e > 0 THEN pow(e, 1 / greatest(n / 252, 1 / 252)) - 1 ELSE -1 END AS cagr FROM g)
  SELECT h.symbol, h.strategy, h.variant, round(e - 1, 8) AS total_return, round(cagr, 8) AS cagr, round(coalesce(sd * sqrt(252), 0), 8) AS vol, round(sharpe, 8) AS sharpe,
    round(CASE WHEN down > 0 THEN mean / down * sqrt(252) ELSE 0 END, 8) AS sortino, round(max_drawdown, 8) AS max_drawdown, round(CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END, 8) AS calmar,
    round(exposure, 8) AS exposure, coalesce(trades, 0) AS trades, round(coalesce(win_rate, 0), 8) AS win_rate, round(coalesce(avg_win, 0), 8) AS avg_win, round(coalesce(avg_loss, 0), 8) AS avg_loss, round(coalesce(avg_days, 0), 8) AS avg_days,
    round(coalesce(CASE WHEN lost > 0 THEN least(won / lost, 99.0) WHEN won > 0 THEN 99.0 ELSE 0 END, 0), 6) AS profit_factor
  FROM h LEFT JOIN t ON h.symbol = t.symbol AND h.strategy = t.strategy AND h.variant = t.variant"""


@query(METRICS, o.FRAGMENTS)
def a5_metrics(t: Panels) -> DataFrame:
    out = met.performance(t.returns, t.trades, acc.KEYS)
    digits = {k: 6 if k == "profit_factor" else 8 for k, kind in out.dtypes if kind == "double"}
    return out.select(*[F.round(k, digits[k]).alias(k) if k in digits else c(k) for k in out.columns])


@query(f"SELECT {KEYS}, {SHARPE} AS sharpe FROM all_ret GROUP BY {KEYS}", o.FRAGMENTS)
def a6_sharpe(t: Panels) -> DataFrame:
    return t.returns.groupBy(*acc.KEYS).agg(met.sharpe().alias("sharpe"))


@query(f"SELECT {KEYS}, {PERIOD} AS sr FROM all_ret GROUP BY {KEYS}", o.FRAGMENTS)
def a7_period_sharpe(t: Panels) -> DataFrame:
    return t.returns.groupBy(*acc.KEYS).agg(met.period_sharpe().alias("sr"))


@query(
    f"""WITH m AS (SELECT {KEYS}, avg(ret - 0.0001) AS mean, stddev_samp(ret - 0.0001) AS sd FROM all_ret GROUP BY {KEYS})
    SELECT a.symbol, a.strategy, a.variant, count(*) AS n, round(avg(pow((ret - 0.0001 - mean) / sd, 3)), 6) AS skew, round(avg(pow((ret - 0.0001 - mean) / sd, 4)), 6) AS kurt
    FROM all_ret a JOIN m ON a.symbol = m.symbol AND a.strategy = m.strategy AND a.variant = m.variant WHERE sd > 0 GROUP BY 1, 2, 3""",
    o.FRAGMENTS,
)
def a8_moments(t: Panels) -> DataFrame:
    out = met.moments(t.returns, acc.KEYS).where("sd > 0")
    return out.select(*acc.KEYS, "n", F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"))
