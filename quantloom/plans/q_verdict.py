"""Queries of risk, analogs, module scores, verdicts, the engine back-test and tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HORIZON_BARS
from ..operators import analogs as an
from ..operators import indicators as ind
from ..operators import risk as rk
from ..operators import tuning as tu
from ..operators import verdict as vd
from ..operators.smooth import with_smoothed
from . import backtest as bt
from . import oracle as o
from .q_market import STATE
from .q_records import JOINED
from .registry import Panels, query

c = F.col
CLIP = "greatest({lo}, least({hi}, {x}))"


def clip(x: str, lo: float = -1, hi: float = 1) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


FR = dict(o.FRAGMENTS)
FR["joined"] = JOINED
FR["betas"] = "SELECT symbol, date, CASE WHEN count(r) OVER w >= 120 AND var_samp(x) OVER w > 0 THEN covar_samp(r, x) OVER w / var_samp(x) OVER w END AS beta FROM joined WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 503 PRECEDING)"
FR["idx"] = """SELECT date, value AS idx, row_number() OVER w AS idx_n, CASE WHEN row_number() OVER w >= 200 THEN avg(value) OVER (ORDER BY date ROWS 199 PRECEDING) END AS avg200,
  value / lag(value, 63) OVER w - 1 AS ret63, value / lag(value, 126) OVER w - 1 AS ret126 FROM series WHERE series_id = 'INDEX' WINDOW w AS (ORDER BY date)"""
FR["tech0"] = f"""SELECT s.symbol, s.date, s.i, s.close, s.rsi14, s.adx14, s.sma50, s.sma200, s.m12 - s.s12 AS hist, lag(s.m12 - s.s12, 3) {o.OVER} AS hist3, s.close - lag(s.close, 20) {o.OVER} AS p20,
  s.obv - lag(s.obv, 20) {o.OVER} AS o20, s.mom126 AS r6, CASE WHEN s.i >= 253 THEN lag(s.close, 21) {o.OVER} / lag(s.close, 252) {o.OVER} - 1 END AS r12, x.idx_n, x.ret126
  FROM sig0 s LEFT JOIN idx x ON s.date = x.date""".replace("PARTITION BY symbol ORDER BY date", "PARTITION BY s.symbol ORDER BY s.date")
_TREND = f"{clip('CASE WHEN close > sma200 AND close > sma50 THEN 1.0 WHEN close > sma200 THEN 0.25 WHEN close > sma50 THEN -0.25 ELSE -1.0 END + CASE WHEN sma50 > sma200 THEN 0.3 ELSE -0.3 END')}"
_TREND = f"({_TREND}) * CASE WHEN coalesce(adx14, 20) > 25 THEN 1.2 WHEN coalesce(adx14, 20) < 15 THEN 0.7 ELSE 1.0 END"
_PARTS = [
    (0.35, f"CASE WHEN sma200 IS NOT NULL THEN {clip(_TREND)} END"),
    (0.25, clip("(CASE WHEN r6 IS NOT NULL AND r12 IS NOT NULL THEN (r6 + r12) / 2 ELSE coalesce(r6, r12) END) / 0.3")),
    (0.15, clip("CASE WHEN idx_n > 127 THEN (r6 - ret126) / 0.2 END")),
    (0.10, "CASE WHEN rsi14 > 70 THEN -0.5 WHEN rsi14 < 30 THEN 0.5 WHEN rsi14 >= 50 THEN 0.25 ELSE -0.25 END"),
    (0.10, "CASE WHEN hist > 0 THEN CASE WHEN hist > coalesce(hist3, 0) THEN 0.5 ELSE 0.2 END ELSE CASE WHEN hist > coalesce(hist3, 0) THEN -0.2 ELSE -0.5 END END"),
    (0.05, "CASE WHEN p20 IS NOT NULL THEN CASE WHEN sign(p20) = sign(o20) AND p20 > 0 THEN 0.25 WHEN sign(p20) <> sign(o20) THEN -0.25 ELSE -0.1 END END"),
]
FR["tech1"] = "SELECT symbol, date, i, sma200, " + ", ".join(f"{x} AS t{k}" for k, (_, x) in enumerate(_PARTS)) + " FROM tech0"
_NUM = " + ".join(f"coalesce(t{k} * CAST({w} AS DOUBLE), 0)" for k, (w, _) in enumerate(_PARTS))
_DEN = " + ".join(f"CASE WHEN t{k} IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE 0 END" for k, (w, _) in enumerate(_PARTS))
FR["tech"] = f"SELECT symbol, date, i, i >= 59 AS available, CASE WHEN i >= 59 THEN round(({_NUM}) / ({_DEN}), 3) ELSE 0 END AS score, CASE WHEN i >= 59 THEN CASE WHEN sma200 IS NOT NULL THEN 0.9 ELSE 0.6 END ELSE 0 END AS confidence FROM tech1"
FR["mkt"] = """SELECT x.date, idx_n >= 210 AS available, CASE WHEN idx > avg200 THEN 0.5 ELSE -0.5 END + CASE WHEN ret63 > 0 THEN 0.25 ELSE -0.25 END
  + CASE WHEN v.value IS NULL THEN 0.0 WHEN v.value < 18 THEN 0.25 WHEN v.value < 25 THEN 0.0 WHEN v.value < 32 THEN -0.25 ELSE -0.5 END
  + CASE WHEN d.k > 64 THEN CASE WHEN d.dt > 0.5 THEN -0.25 WHEN d.dt < -0.5 THEN 0.15 ELSE 0 END ELSE 0 END AS s
  FROM idx x LEFT JOIN (SELECT date, value FROM series WHERE series_id = 'VOL') v ON x.date = v.date
  LEFT JOIN (SELECT date, value - lag(value, 63) OVER (ORDER BY date) AS dt, row_number() OVER (ORDER BY date) AS k FROM series WHERE series_id = 'Y10') d ON x.date = d.date"""
FR["sec"] = "SELECT series_id AS fund, date, CASE WHEN row_number() OVER w > 210 THEN CASE WHEN value > avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS 199 PRECEDING) THEN 0.25 ELSE -0.25 END END AS x FROM series WHERE series_id LIKE 'XL%' WINDOW w AS (PARTITION BY series_id ORDER BY date)"
FR["reg"] = f"""SELECT b.symbol, b.date, m.available, CASE WHEN m.available THEN round({clip("greatest(-1, least(1, m.s + coalesce(q.x, 0))) * coalesce(greatest(0.6, least(1.4, CAST(t.beta AS DOUBLE))) + 0 * t.beta, 1)")}, 3) ELSE 0 END AS score,
  CASE WHEN m.available THEN 0.8 ELSE 0 END AS confidence FROM bars b JOIN mkt m ON b.date = m.date LEFT JOIN betas t ON t.symbol = b.symbol AND t.date = b.date
  LEFT JOIN fnd f ON f.symbol = b.symbol AND f.date = b.date LEFT JOIN sec q ON q.date = b.date AND q.fund = f.fund"""
# The sector of a symbol as of each date, and its fund.
FR["fnd"] = """SELECT b.symbol, b.date, CASE s.sector WHEN 'Technology' THEN 'XLK' WHEN 'Financial Services' THEN 'XLF' WHEN 'Healthcare' THEN 'XLV' WHEN 'Consumer Cyclical' THEN 'XLY' WHEN 'Consumer Defensive' THEN 'XLP'
  WHEN 'Energy' THEN 'XLE' WHEN 'Industrials' THEN 'XLI' WHEN 'Basic Materials' THEN 'XLB' WHEN 'Utilities' THEN 'XLU' WHEN 'Real Estate' THEN 'XLRE' WHEN 'Communication Services' THEN 'XLC' END AS fund
  FROM bars b ASOF LEFT JOIN sectors s ON b.symbol = s.symbol AND b.date >= s.since"""
FR["states"] = f"SELECT symbol, date, i, close, {STATE} AS state FROM sig0"


def _figures(h: int) -> str:
    d = max(1.0, 2 * h / 3)
    t = f"CASE WHEN sd / sqrt(greatest(n / {d!r}, 1)) > 0 THEN (m - am) / (sd / sqrt(greatest(n / {d!r}, 1))) ELSE 0 END"
    ok = "an >= 250 AND n >= 20"
    given = lambda x: f"CASE WHEN {ok} THEN {x} END"
    return (
        f"coalesce({ok}, false) AS available, n, {given(f'n / {d!r}')} AS n_eff, {given('m')} AS mean, {given('am')} AS base_mean, {given(t)} AS t_stat, "
        f"{given(f'round(greatest(-1, least(1, ({t}) / 3)), 3)')} AS score, {given(f'round(least(1, n / {d!r} / 10), 3)')} AS confidence"
    )


for _k, _h in HORIZON_BARS.items():
    FR[f"fwd_{_k}"] = f"SELECT *, CASE WHEN state IS NOT NULL THEN lead(close, {_h}) {o.OVER} / close - 1 END AS fwd FROM states"
    FR[f"known_{_k}"] = f"""SELECT symbol, date, i, state, CASE WHEN state IS NOT NULL THEN count(fwd) OVER s ELSE 0 END AS n, avg(fwd) OVER s AS m, stddev_samp(fwd) OVER s AS sd, count(fwd) OVER e AS an, avg(fwd) OVER e AS am FROM fwd_{_k}
      WINDOW s AS (PARTITION BY symbol, state ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND {_h} PRECEDING), e AS (PARTITION BY symbol ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND {_h} PRECEDING)"""
    FR[f"ana_{_k}"] = f"SELECT symbol, date, i, {_figures(_h)} FROM known_{_k}"
FR["rets"] = f"SELECT *, close / lag(close) {o.OVER} - 1 AS r, row_number() {o.OVER} - 1 AS j FROM bars"
FR["vols"] = f"SELECT symbol, date, j, stddev_samp(r) {o.frame(252)} * sqrt(252) AS vol, {', '.join(f'lead(close, {h}) {o.OVER} / close - 1 AS ret_{k}' for k, h in HORIZON_BARS.items())} FROM rets"
FR["mods"] = " UNION ALL ".join(
    f"SELECT v.symbol, v.date, '{k}' AS horizon, v.vol, v.ret_{k} AS ret, '{m}' AS module, a.available, coalesce(a.score, 0) AS score, coalesce(a.confidence, 0) AS confidence FROM vols v JOIN {m_table} a ON a.symbol = v.symbol AND a.date = v.date WHERE v.j >= 504 AND (v.j - 504) % 21 = 0 AND v.ret_{k} IS NOT NULL"
    for k in HORIZON_BARS
    for m, m_table in (("technical", "tech"), ("regime", "reg"), ("analogs", f"ana_{k}"))
)
FR["wts"] = "SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{m}', CAST({w} AS DOUBLE))" for h, ws in vd.WEIGHTS.items() for m, w in zip(vd.MODULES, ws, strict=True)) + ") w(horizon, module, w)"
FR["comb"] = """SELECT m.symbol, m.date, m.horizon, any_value(m.ret) AS ret, sum(w) AS wsum, sum(w * confidence * score) AS num, sum(w * confidence) AS wc, sum(abs(w * confidence * score)) AS absum, max(vol) AS vol
  FROM mods m JOIN wts w ON w.horizon = m.horizon AND w.module = m.module WHERE m.available AND m.confidence > 0 GROUP BY 1, 2, 3"""
FR["verd"] = """SELECT symbol, date, horizon, ret, num / wsum AS score, CASE WHEN absum > 0 THEN abs(num) / absum ELSE 0 END AS agreement, wc / wsum AS coverage,
  wc / wsum * (0.5 + 0.5 * CASE WHEN absum > 0 THEN abs(num) / absum ELSE 0 END) * CASE WHEN vol > 0.6 THEN 0.9 ELSE 1 END AS confidence,
  CASE WHEN num / wsum >= 0.15 THEN 'buy' WHEN num / wsum <= -0.15 THEN 'sell' ELSE 'hold' END AS verdict FROM comb"""
FR["smp"] = "SELECT symbol, date, horizon, verdict, round(confidence, 3) AS conf, ret FROM verd"
_HIT = lambda v, r="ret": f"CASE {v} WHEN 'buy' THEN {r} > 0.02 WHEN 'sell' THEN {r} < -0.02 ELSE abs({r}) <= 0.05 END"
_MEAN = lambda x: f"avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END)"
FR["bases"] = " UNION ALL ".join(f"""SELECT horizon, '{v}' AS verdict, {_MEAN(_HIT(f"'{v}'"))} AS base FROM smp GROUP BY 1""" for v in ("buy", "hold", "sell"))
FR["byv"] = f"SELECT s.horizon, s.verdict, count(*) AS n, {_MEAN(_HIT('s.verdict'))} AS hit, any_value(b.base) AS base, avg(ret) AS avg_ret FROM smp s JOIN bases b ON b.horizon = s.horizon AND b.verdict = s.verdict GROUP BY 1, 2"


@query("SELECT symbol, date, beta FROM betas", FR)
def a2_beta(t: Panels) -> DataFrame:
    return rk.rolling_beta(rk.join_returns(t.bars, _index(t)))


def _index(t: Panels) -> DataFrame:
    return t.series.where("series_id = 'INDEX'").select("date", "value")


DRAWDOWN = "SELECT symbol, min(close / m - 1) AS drawdown FROM (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= {n})) GROUP BY 1"


@query(DRAWDOWN.format(n=252))
def a4_tail_drawdown(t: Panels) -> DataFrame:
    return rk.tail_drawdown(t.bars, 252)


@query(
    f"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM rets WHERE r IS NOT NULL),
    v AS (SELECT symbol, stddev_samp(r) FILTER (k <= 252) * sqrt(252) AS vol_1y, -quantile_cont(r, 0.05) FILTER (k <= 504) AS var95_1d FROM q GROUP BY 1),
    b AS (SELECT symbol, max_by(beta, date) AS beta FROM betas GROUP BY 1), a AS (SELECT symbol, max_by(atr14, date) AS atr, max_by(atr14 / close, date) AS atr_pct FROM smooth1 GROUP BY 1)
    SELECT v.symbol, vol_1y, var95_1d, beta, atr, atr_pct, d1.drawdown AS mdd_1y, d5.drawdown AS mdd_5y, CASE WHEN vol_1y < 0.2 THEN 'low' WHEN vol_1y < 0.35 THEN 'medium' WHEN vol_1y < 0.6 THEN 'high' ELSE 'very high' END AS level
    FROM v JOIN b ON b.symbol = v.symbol JOIN a ON a.symbol = v.symbol JOIN ({DRAWDOWN.format(n=252)}) d1 ON d1.symbol = v.symbol JOIN ({DRAWDOWN.format(n=1260)}) d5 ON d5.symbol = v.symbol""",
    FR,
)
def a3_risk_profile(t: Panels) -> DataFrame:
    return rk.risk_profile(t.bars, _index(t))


@query("SELECT horizon, sum(confidence * score) / sum(confidence) AS mean_score FROM runs GROUP BY 1 HAVING sum(confidence) > 0")
def a9_weighted_mean(t: Panels) -> DataFrame:
    return t.runs.groupBy("horizon").agg(F.try_divide(F.sum(c("confidence") * c("score")), F.sum("confidence")).alias("mean_score"))


@query("SELECT symbol, date, available, score, confidence FROM tech", FR)
def n5_technical(t: Panels) -> DataFrame:
    return vd.technical(t.bars, _index(t)).drop("i")


@query("SELECT symbol, date, available, score, confidence FROM reg", FR)
def n6_regime(t: Panels) -> DataFrame:
    bars, index = t.stored_bars, t.stored_series.where("series_id = 'INDEX'").select("date", "value")
    betas = bars.select("symbol", "date").join(rk.rolling_beta(rk.join_returns(bars, index)), ["symbol", "date"], "left")
    return vd.regime(bt.with_fund(betas, t.sectors), t.stored_series)


ANALOG = f"""WITH z AS (SELECT symbol, max_by(state, date) AS now FROM (SELECT symbol, date, coalesce(state, -1) AS state FROM states) GROUP BY 1),
    v AS (SELECT f.*, z.now FROM fwd_short f JOIN z ON z.symbol = f.symbol WHERE state IS NOT NULL AND fwd IS NOT NULL),
    g AS (SELECT symbol, count(*) AS an, avg(fwd) AS am, count(*) FILTER (state = now) AS n, avg(fwd) FILTER (state = now) AS m, stddev_samp(fwd) FILTER (state = now) AS sd,
      quantile_cont(fwd, 0.5) FILTER (state = now) AS median, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) FILTER (state = now) AS hit_rate, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) AS base_hit_rate FROM v GROUP BY 1)
    SELECT symbol, {_figures(21)}, median, hit_rate, base_hit_rate FROM g"""


@query(ANALOG, FR)
def r6_analogs(t: Panels) -> DataFrame:
    return an.analogs(t.bars, "short")


@query("SELECT symbol, date, i, available, n, n_eff, mean, base_mean, t_stat, score, confidence FROM ana_mid", FR)
def r7_analogs_asof(t: Panels) -> DataFrame:
    return an.analogs_asof(an.with_state(t.bars), "mid")


@query(
    f"""SELECT symbol, CAST(least(floor(24 * (greatest(-0.6, least(0.6, f)) + 0.6) / 1.2), 23) AS INT) AS bin, count(*) AS n FROM (SELECT symbol, lead(close, 63) {o.OVER} / close - 1 AS f FROM bars) WHERE f IS NOT NULL GROUP BY 1, 2"""
)
def a15_histogram(t: Panels) -> DataFrame:
    return an.histogram(t.bars.select("symbol", ind.forward_return(63).alias("f")), ["symbol"], "f")


@query("SELECT symbol, date, horizon, verdict, score, confidence, agreement, coverage FROM verd", FR)
def n7_combine(t: Panels) -> DataFrame:
    rows = t.modules
    return vd.combine(rows, vd.weight_table(t.spark), ["symbol", "date", "horizon"]).drop("strong", "contributions")


@query("SELECT symbol, date, horizon, verdict, conf, ret FROM smp", FR)
def e2_engine_samples(t: Panels) -> DataFrame:
    return t.samples.drop("x")


@query("SELECT horizon, symbol, count(*) AS n, sum(ret) AS total FROM smp GROUP BY 1, 2", FR)
def e3_universe(t: Panels) -> DataFrame:
    return t.samples.groupBy("horizon", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))


@query("SELECT horizon, verdict, n, hit, base, avg_ret FROM byv", FR)
def a10_hit_rates(t: Panels) -> DataFrame:
    return bt.summarize_verdicts(t.samples)


@query(f"SELECT s.horizon, CASE WHEN conf < 0.6 THEN 0 WHEN conf < 0.8 THEN 1 ELSE 2 END AS bin, count(*) AS n, {_MEAN(_HIT('s.verdict'))} AS hit, avg(b.base) AS base FROM smp s JOIN bases b ON b.horizon = s.horizon AND b.verdict = s.verdict GROUP BY 1, 2", FR)
def a11_hit_rates_by_confidence(t: Panels) -> DataFrame:
    return bt.summarize_conf(t.samples)


@query("SELECT horizon, verdict, n, hit - base AS lift, CASE WHEN hit - base >= 0.03 THEN 'better' ELSE 'worse' END AS finding FROM byv WHERE abs(hit - base) >= 0.03", FR)
def a20_findings(t: Panels) -> DataFrame:
    return bt.findings(bt.summarize_verdicts(t.samples))


@query(
    f"""WITH s AS (SELECT m.horizon, max(b.avg_ret) AS sell, any_value(m.avg_ret) AS every FROM (SELECT horizon, avg(ret) AS avg_ret FROM smp GROUP BY 1) m LEFT JOIN byv b ON b.horizon = m.horizon AND b.verdict = 'sell' GROUP BY 1),
    k AS (SELECT s.horizon, CASE WHEN conf < 0.6 THEN 0 WHEN conf < 0.8 THEN 1 ELSE 2 END AS bin, {_MEAN(_HIT('s.verdict'))} - avg(b.base) AS lift FROM smp s JOIN bases b ON b.horizon = s.horizon AND b.verdict = s.verdict GROUP BY 1, 2),
    e AS (SELECT horizon, count(*) AS bins, min_by(lift, bin) AS low, max_by(lift, bin) AS high FROM k GROUP BY 1)
    SELECT bool_and(coalesce(sell, -1) > every) AS sells_rise, (SELECT bool_and(bins > 1 AND high <= low) FROM e) AS confidence_tells_nothing FROM s""",
    FR,
)
def a20_conclusions(t: Panels) -> DataFrame:
    return bt.conclusions(t.samples)


SHARE = "CASE horizon " + " ".join(f"WHEN '{h}' THEN {round(sum(v for m, v in zip(vd.MODULES, w, strict=True) if m in bt.TESTED), 2)}" for h, w in vd.WEIGHTS.items()) + " END"


@query(f"SELECT horizon, count(*) AS n, avg(ret) AS avg_ret, min(date) AS start, max(date) AS \"end\", count(DISTINCT symbol) AS symbols, CAST({SHARE} AS DOUBLE) AS weight_share FROM smp GROUP BY 1", FR)
def e9_engine_report(t: Panels) -> DataFrame:
    return bt.engine_report(t.samples)


CONTRIB = "SELECT m.symbol, m.date, m.horizon, m.module, w.w * m.confidence * m.score / k.wsum AS value FROM mods m JOIN wts w ON w.horizon = m.horizon AND w.module = m.module JOIN comb k ON k.symbol = m.symbol AND k.date = m.date AND k.horizon = m.horizon WHERE m.available AND m.confidence > 0"


def _verdicts(t: Panels) -> DataFrame:
    return vd.combine(t.modules, vd.weight_table(t.spark), ["symbol", "date", "horizon"])


@query(f"SELECT *, row_number() OVER (PARTITION BY symbol, date, horizon ORDER BY abs(value) DESC, module) AS rank FROM ({CONTRIB})", FR)
def t3_rank_contributions(t: Panels) -> DataFrame:
    return vd.rank_contributions(_verdicts(t), ["symbol", "date", "horizon"])


@query(f"SELECT *, \"to\" - value AS \"from\" FROM (SELECT *, row_number() OVER w AS step, sum(value) OVER (PARTITION BY symbol, date, horizon ORDER BY value < 0, value DESC, module ROWS UNBOUNDED PRECEDING) AS \"to\" FROM ({CONTRIB}) WINDOW w AS (PARTITION BY symbol, date, horizon ORDER BY value < 0, value DESC, module))", FR)
def w21_waterfall(t: Panels) -> DataFrame:
    keys = ["symbol", "date", "horizon"]
    return vd.waterfall(_verdicts(t).select(*keys, F.explode("contributions").alias("module", "value")), keys)


@query(
    "SELECT symbol, date, horizon, array_to_string(list_sort(list_filter(['technical', 'strategies', 'analogs', 'sentiment', 'consensus', 'valuation', 'quality', 'personas', 'regime'], lambda m: NOT list_contains(u, m))), ',') AS missing FROM (SELECT symbol, date, horizon, list(module) FILTER (available AND confidence > 0) AS u FROM mods GROUP BY 1, 2, 3)",
    FR,
)
def u4_missing_modules(t: Panels) -> DataFrame:
    out = vd.missing_modules(t.modules, ["symbol", "date", "horizon"], vd.MODULES)
    return out.withColumn("missing", F.array_join("missing", ","))


@query("SELECT symbol, date, horizon, module, available, CASE WHEN NOT available THEN '-' WHEN score >= 0.4 THEN 'A' WHEN score >= 0.15 THEN 'B' WHEN score > -0.15 THEN 'C' WHEN score > -0.4 THEN 'D' ELSE 'F' END AS grade FROM mods", FR)
def n11_module_cards(t: Panels) -> DataFrame:
    from ..functions.scalars import letter

    rows = t.modules
    return rows.select("symbol", "date", "horizon", "module", "available", F.when(c("available"), letter(c("score"))).otherwise("-").alias("grade"))


@query("SELECT symbol, date, horizon, CASE WHEN module = 'technical' THEN 'timing' WHEN module = 'regime' THEN 'timing' ELSE 'company' END AS part, sum(confidence * score) / sum(confidence) AS score FROM mods WHERE available GROUP BY 1, 2, 3, 4", FR)
def a18_group_scores(t: Panels) -> DataFrame:
    return vd.group_scores(t.modules, ["symbol", "date", "horizon"], ("analogs",))


REASON = "SELECT *, CASE WHEN score > 0.1 THEN 'bull' WHEN score < -0.1 THEN 'bear' END AS side FROM mods WHERE available"


@query(f"SELECT symbol, date, horizon, side, module, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date, horizon, side ORDER BY CASE WHEN side = 'bull' THEN -score * confidence ELSE score * confidence END, module) AS r FROM ({REASON}) WHERE side IS NOT NULL) WHERE r <= 3", FR)
def n9_top_reasons(t: Panels) -> DataFrame:
    return vd.top_reasons(t.modules, ["symbol", "date", "horizon"])


LEVEL_NAMES = ["sma20", "sma50", "sma200", "bb_up", "bb_low", "high20", "low20", "high52w", "low52w"]
FR["lev"] = f"""SELECT symbol, date, close, sma20, sma50, sma200, up20 AS bb_up, lo20 AS bb_low, max(high) {o.frame(20)} AS high20, min(low) {o.frame(20)} AS low20,
    max(close) {o.frame(252)} AS high52w, min(close) {o.frame(252)} AS low52w FROM sig1"""
FR["cells"] = " UNION ALL ".join(f"SELECT symbol, date, close, '{n}' AS name, {n} AS v FROM lev" for n in LEVEL_NAMES)
FR["near"] = """SELECT l.symbol, l.date, l.close, min(v) FILTER (v > l.close * 1.0001) AS above, max(v) FILTER (v < l.close * 0.9999) AS below FROM lev l JOIN cells k ON k.symbol = l.symbol AND k.date = l.date GROUP BY 1, 2, 3"""


@query("SELECT symbol, date, close, above, below FROM near", FR)
def t5_nearest_levels(t: Panels) -> DataFrame:
    return vd.nearest_levels(ind.price_levels(t.bars), LEVEL_NAMES).drop("above_name", "below_name")


@query("SELECT symbol, date, name, v AS level, v / close - 1 AS distance, row_number() OVER (PARTITION BY symbol, date ORDER BY v DESC, name) AS rank FROM cells WHERE v IS NOT NULL", FR)
def t6_price_ladder(t: Panels) -> DataFrame:
    return vd.price_ladder(ind.price_levels(t.bars), LEVEL_NAMES)


@query(
    """SELECT n.symbol, n.date, v.horizon, v.verdict, CASE WHEN above IS NOT NULL THEN CASE verdict WHEN 'buy' THEN 'buy_stronger' WHEN 'hold' THEN 'towards_buy' ELSE 'towards_hold' END END AS if_above,
    CASE WHEN below IS NOT NULL THEN CASE verdict WHEN 'buy' THEN 'towards_hold' WHEN 'hold' THEN 'towards_sell' ELSE 'sell_stronger' END END AS if_below FROM near n JOIN verd v ON v.symbol = n.symbol AND v.date = n.date""",
    FR,
)
def n10_price_triggers(t: Panels) -> DataFrame:
    near = vd.nearest_levels(ind.price_levels(t.bars), LEVEL_NAMES)
    rows = near.join(_verdicts(t).select("symbol", "date", "horizon", "verdict"), ["symbol", "date"])
    return vd.price_triggers(rows).select("symbol", "date", "horizon", "verdict", "if_above", "if_below")


@query(
    """WITH p AS (SELECT symbol, date, max(verdict) FILTER (horizon = 'short') AS s, max(verdict) FILTER (horizon = 'mid') AS m, max(verdict) FILTER (horizon = 'long') AS l FROM verd GROUP BY 1, 2),
    q AS (SELECT v.symbol, v.date, v.horizon, v.verdict, p.s, p.m, p.l, CASE v.verdict WHEN 'buy' THEN 'sell' WHEN 'sell' THEN 'buy' END AS o FROM verd v JOIN p ON p.symbol = v.symbol AND p.date = v.date),
    r AS (SELECT *, CASE WHEN horizon = 'mid' AND s = o THEN 'short' WHEN horizon = 'long' AND s = o THEN 'short' WHEN horizon = 'long' AND m = o THEN 'mid' END AS shorter,
      CASE WHEN horizon = 'short' AND m = o THEN 'mid' WHEN horizon = 'short' AND l = o THEN 'long' WHEN horizon = 'mid' AND l = o THEN 'long' END AS longer, symbol IN ('AF', 'RO') AS held FROM q)
    SELECT symbol, date, horizon, verdict, shorter, longer, CASE WHEN verdict = 'buy' THEN CASE WHEN held THEN 'keep' WHEN shorter IS NOT NULL THEN 'buy_in_parts' WHEN longer IS NOT NULL THEN 'buy_briefly' ELSE 'consider_buying' END
      WHEN verdict = 'sell' THEN CASE WHEN held THEN 'reduce' ELSE 'do_not_buy' END WHEN held THEN 'keep' ELSE 'watch' END AS action FROM r""",
    FR,
)
def n8_advice(t: Panels) -> DataFrame:
    return vd.advice(_verdicts(t), c("symbol").isin("AF", "RO"))


@query(f"SELECT symbol, date, close AS price, close / lag(close) {o.OVER} - 1 AS change, max(high) {o.frame(260)} AS high52, min(low) {o.frame(260)} AS low52, {o.sma('close', 50)} AS sma50, {o.sma('close', 200)} AS sma200 FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
def n12_quotes(t: Panels) -> DataFrame:
    return vd.quotes(t.bars)


# Tuning over the samples.
FR["sx"] = "SELECT m.symbol, m.date, m.horizon, m.ret, m.module, round(m.score * m.confidence + 1e-9, 4) AS v FROM mods m WHERE m.available"
_RANK = lambda x, keys: f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"
_DAYS = "CASE horizon WHEN 'short' THEN 30 WHEN 'mid' THEN 91 ELSE 365 END"


def _ic(source: str, x: str, keys: str) -> str:
    return f"SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= 30 AND stddev_samp(ra) > 0 AND stddev_samp(rb) > 0 THEN covar_samp(ra, rb) / (stddev_samp(ra) * stddev_samp(rb)) END AS ic FROM (SELECT {keys}, {_RANK(x, keys)} AS ra, {_RANK('ret', keys)} AS rb FROM {source} WHERE {x} IS NOT NULL) GROUP BY {keys}"


def _module_ic(source: str) -> str:
    return f"""SELECT a.horizon, a.module, a.ic, b.n_eff FROM ({_ic(source, 'v', 'horizon, module')}) a JOIN
      (SELECT horizon, module, count(DISTINCT (symbol, (date - DATE '1970-01-01' + 719163) // {_DAYS})) AS n_eff FROM {source} GROUP BY 1, 2) b ON a.horizon = b.horizon AND a.module = b.module"""


def _propose(ics: str) -> str:
    return f"""SELECT horizon, module, round(nw * CASE WHEN max(CASE WHEN ok THEN 1 ELSE 0 END) OVER h = 1 THEN mass / sum(nw) OVER h ELSE 1 END, 3) AS w FROM (
      SELECT *, CASE WHEN ok THEN least((1 - n_eff / (n_eff + 500)) * w0 + n_eff / (n_eff + 500) * CASE WHEN tot > 0 THEN mass * p / tot ELSE 0 END, 2 * w0) ELSE w0 END AS nw FROM (
      SELECT *, sum(w0) OVER h AS mass, sum(p) OVER h AS tot FROM (
      SELECT w.horizon, w.module, w.w AS w0, i.n_eff, coalesce(i.ic IS NOT NULL AND i.n_eff >= 30, false) AS ok, CASE WHEN i.ic IS NOT NULL AND i.n_eff >= 30 THEN greatest(i.ic, 0) ELSE 0 END AS p
      FROM (SELECT * FROM wts WHERE module IN ('technical', 'analogs', 'regime')) w LEFT JOIN ({ics}) i ON i.horizon = w.horizon AND i.module = w.module) WINDOW h AS (PARTITION BY horizon))) WINDOW h AS (PARTITION BY horizon)"""


def _score(source: str, weights: str) -> str:
    return f"SELECT s.symbol, s.date, s.horizon, any_value(s.ret) AS ret, round(sum(w.w * s.v) / sum(w.w), 9) AS s FROM {source} s JOIN {weights} w ON w.horizon = s.horizon AND w.module = s.module WHERE w.w > 0 GROUP BY 1, 2, 3"


@query(_ic("runs2", "confidence", "horizon"), {"runs2": "SELECT horizon, confidence, score AS ret FROM runs"})
def e4_spearman(t: Panels) -> DataFrame:
    return tu.spearman(t.runs, ["horizon"], "confidence", "score")


@query(_module_ic("sx"), FR)
def e5_module_ic(t: Panels) -> DataFrame:
    return tu.module_ic(t.samples, bt.TESTED)


@query(_ic(f"({_score('sx', 'wts')})", "s", "horizon"), FR)
def e5_combined_ic(t: Panels) -> DataFrame:
    return tu.combined_ic(t.samples, vd.weight_table(t.spark))


@query(_propose(_module_ic("sx")), FR)
def e6_propose(t: Panels) -> DataFrame:
    return tu.propose(tu.module_ic(t.samples, bt.TESTED), vd.weight_table(t.spark, bt.TESTED))


FR["cut"] = "SELECT horizon, min(date) FILTER (k = kk) AS cut FROM (SELECT horizon, date, row_number() OVER (PARTITION BY horizon ORDER BY date) - 1 AS k, floor(count(*) OVER (PARTITION BY horizon) * 0.7) AS kk FROM smp) GROUP BY 1"
FR["sx_train"] = "SELECT x.* FROM sx x JOIN cut k ON k.horizon = x.horizon WHERE x.date < k.cut"
FR["sx_test"] = "SELECT x.* FROM sx x JOIN cut k ON k.horizon = x.horizon WHERE x.date >= k.cut"
FR["w_new"] = _propose(_module_ic("sx_train"))
FR["w_old"] = "SELECT * FROM wts WHERE module IN ('technical', 'analogs', 'regime')"


@query(
    f"""SELECT a.horizon, a.ic AS ic_prior, b.ic AS ic_new, coalesce(b.ic >= a.ic + 0.01, false) AS adopted FROM ({_ic(f"({_score('sx_test', 'w_old')})", 's', 'horizon')}) a
    FULL JOIN ({_ic(f"({_score('sx_test', 'w_new')})", 's', 'horizon')}) b ON a.horizon = b.horizon""",
    FR,
)
def e7_tune(t: Panels) -> DataFrame:
    return tu.tune(t.samples, vd.weight_table(t.spark, bt.TESTED), bt.TESTED)


FR["w_fin"] = _propose(_module_ic("sx"))
FR["judged"] = f"""SELECT a.horizon, a.ic AS ic_prior, b.ic AS ic_new FROM ({_ic(f"({_score('sx_test', 'w_old')})", 's', 'horizon')}) a FULL JOIN ({_ic(f"({_score('sx_test', 'w_new')})", 's', 'horizon')}) b ON a.horizon = b.horizon"""


@query(
    f"""WITH n AS (SELECT horizon, count(*) AS n, count(DISTINCT (symbol, (date - DATE '1970-01-01' + 719163) // {_DAYS})) AS n_eff FROM smp GROUP BY 1),
    r AS (SELECT w.*, coalesce(f.w, w.w) AS final, n, n_eff, ic_prior, ic_new FROM wts w LEFT JOIN w_fin f ON f.horizon = w.horizon AND f.module = w.module JOIN n ON n.horizon = w.horizon JOIN judged j ON j.horizon = w.horizon),
    a AS (SELECT *, bool_or(final <> w) OVER (PARTITION BY horizon) AND n >= 60 AND coalesce(ic_new >= ic_prior + 0.01, false) AS adopted FROM r)
    SELECT horizon, module, CASE WHEN adopted THEN final ELSE w END AS w, 'backtest' AS mode, n, n_eff, 0::BIGINT AS n_live, ic_prior, ic_new, adopted FROM a""",
    FR,
)
def e7_tuned_weights(t: Panels) -> DataFrame:
    samples = t.samples
    return tu.tuned_weights(samples, vd.weight_table(t.spark), vd.MODULES, bt.TESTED)


# Every run is a sample of each horizon; its cards' values are those that the JSON of its result holds.
_CARD = lambda k, n: f"CASE WHEN id % 17 <> 0 AND {k} THEN round({n}, 4) END"
LIVE = f"""WITH r AS (SELECT runs.*, h AS hz, CAST(created + CASE h WHEN 'short' THEN 30 WHEN 'mid' THEN 91 ELSE 365 END AS DATE) AS due FROM runs, (VALUES ('short'), ('mid'), ('long')) z(h)),
    p AS (SELECT r.*, b.close AS price FROM r ASOF LEFT JOIN bars b ON r.symbol = b.symbol AND r.created >= b.date), e AS (SELECT p.*, b.close AS end_price FROM p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.due <= b.date),
    n AS (SELECT *, (id * 7 % 201 - 100) / 100.0 AS sa, (id * 11 % 201 - 100) / 100.0 AS sb, (id * 13 % 201 - 100) / 100.0 AS sd, id % 100 / 100.0 AS k FROM e)
    SELECT hz AS horizon, created AS date, symbol, end_price / price - 1 AS ret, {_CARD('id % 5 <> 0', 'sa * k')} AS technical, {_CARD('id % 3 <> 0', 'sb * 0.5')} AS sentiment, {_CARD('id % 7 <> 0', 'sd * k')} AS mood,
    {_CARD("(hz = 'short' OR hz = 'mid' AND id % 2 = 0)", "CASE hz WHEN 'short' THEN sd * 0.25 ELSE sb END")} AS analogs
    FROM n WHERE price IS NOT NULL AND end_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, created, hz ORDER BY id DESC) = 1"""


def _live(t: Panels) -> DataFrame:
    from ..operators.track import with_price

    runs = t.runs.join(t.results, "id").select("id", "symbol", "created", "result")
    return tu.live_samples(with_price(runs, t.stored_bars), t.stored_bars)


@query(LIVE)
def e8_live_samples(t: Panels) -> DataFrame:
    return _live(t).select("horizon", "date", "symbol", "ret", *[F.try_element_at("x", F.lit(m)).alias(m) for m in ("technical", "sentiment", "mood", "analogs")])


@query(f"SELECT horizon, date, symbol, count(*) AS n FROM ({LIVE}) GROUP BY 1, 2, 3")
def u3_dedup_live(t: Panels) -> DataFrame:
    return _live(t).groupBy("horizon", "date", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'bt' AS src, horizon, count(*) AS n, avg(ret) AS avg_ret FROM smp GROUP BY 1, 2 UNION ALL SELECT 'live', horizon, count(*), avg(ret) FROM ({LIVE}) GROUP BY 1, 2", FR)
def u2_all_samples(t: Panels) -> DataFrame:
    rows = tu.all_samples(t.samples, _live(t))
    return rows.groupBy("src", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("avg_ret"))
