"""Queries of strategy validation and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HORIZON_BARS
from ..operators import accounting as acc
from ..operators import indicators as ind
from ..operators import metrics as met
from ..operators import resample as rs
from ..operators import strategies as st
from ..operators import validation as va
from ..operators.risk import tail
from ..operators.smooth import with_smoothed
from ..session import written
from . import oracle as o
from .q_market import KEYS, METRICS, PERIOD, SHARPE
from .registry import SQL, Panels, query

c = F.col
FR = dict(o.FRAGMENTS)
FR["szs"] = "SELECT symbol, count(*) AS n, least(252, count(*) // 5) AS w FROM bars GROUP BY 1"
FR["folds"] = """SELECT symbol, 0 AS fold, n, w AS a0, w + CAST(floor((n - w) * 0.6) AS BIGINT) AS a, n AS b FROM szs WHERE n - w >= 250 AND n - w < 1008
  UNION ALL SELECT symbol, k AS fold, n, w + k * 252, w + k * 252 + 756, least(w + k * 252 + 1008, n) FROM szs, LATERAL (SELECT unnest(range(0, (n - w - 757) // 252 + 1)) AS k) WHERE n - w >= 1008"""
FR["isr"] = f"SELECT r.symbol, r.strategy, f.fold, r.variant, round({SHARPE}, 9) AS is_sharpe FROM all_ret r JOIN folds f ON f.symbol = r.symbol AND r.i >= f.a0 AND r.i < f.a GROUP BY 1, 2, 3, 4"
FR["chosen"] = "SELECT * FROM isr QUALIFY row_number() OVER (PARTITION BY symbol, strategy, fold ORDER BY is_sharpe DESC, variant) = 1"
FR["oos"] = "SELECT r.*, f.fold FROM all_ret r JOIN folds f ON f.symbol = r.symbol AND r.i >= f.a AND r.i < f.b JOIN chosen k ON k.symbol = r.symbol AND k.strategy = r.strategy AND k.variant = r.variant AND k.fold = f.fold"


def _draw(seed: int, *parts: str) -> str:
    h = str(seed)
    for p in parts:
        h = f"((({h})::BIGINT * 1103515245 + ({p})::BIGINT * 12345 + 1013904223) % 2147483647 * 48271) % 2147483647"
    return f"({h})"


@query("SELECT symbol, fold, n, a0, a, b FROM folds", FR)
def v1_folds(t: Panels) -> DataFrame:
    return va.folds(t.bars)


@query("SELECT symbol, strategy, fold, variant, is_sharpe FROM chosen", FR)
def t4_argmax_variant(t: Panels) -> DataFrame:
    return t.chosen


@query(f"SELECT symbol, strategy, fold, count(*) AS bars, {SHARPE} AS oos_sharpe, sum(ret) AS total FROM oos GROUP BY 1, 2, 3", FR)
def v2_walk_forward(t: Panels) -> DataFrame:
    rows = t.oos
    return rows.groupBy("symbol", "strategy", "fold").agg(F.count(F.lit(1)).alias("bars"), met.sharpe().alias("oos_sharpe"), F.sum("ret").alias("total"))


FR["otr"] = """SELECT t.symbol, t.strategy, f.fold, t.variant, t.entry, t.ret FROM trades t JOIN moves m ON m.symbol = t.symbol AND m.date = t.entry JOIN folds f ON f.symbol = t.symbol AND m.i >= f.a AND m.i < f.b
  JOIN chosen k ON k.symbol = t.symbol AND k.strategy = t.strategy AND k.variant = t.variant AND k.fold = f.fold WHERE NOT is_open"""


@query("SELECT symbol, strategy, fold, count(*) AS trades, sum(ret) AS total FROM otr GROUP BY 1, 2, 3", FR)
def v3_oos_trades(t: Panels) -> DataFrame:
    rows = va.oos_trades(t.trades, t.stored_bars, va.folds(t.stored_bars), t.chosen)
    return rows.groupBy("symbol", "strategy", "fold").agg(F.count(F.lit(1)).alias("trades"), F.sum("ret").alias("total"))


@query(
    f"""WITH s AS (SELECT symbol, strategy, fold, {SHARPE} AS x FROM oos GROUP BY 1, 2, 3) SELECT k.symbol, k.strategy, avg(is_sharpe) AS is_mean, avg(x) AS oos_mean, CASE WHEN avg(is_sharpe) > 0 THEN avg(x) / avg(is_sharpe) END AS efficiency
    FROM chosen k JOIN s ON s.symbol = k.symbol AND s.strategy = k.strategy AND s.fold = k.fold GROUP BY 1, 2""",
    FR,
)
def v4_wf_efficiency(t: Panels) -> DataFrame:
    return va.wf_efficiency(t.returns, va.folds(t.stored_bars), t.chosen, t.oos)


N_PERM = 1000
FR["pos_oos"] = "SELECT symbol, strategy, held, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY symbol, strategy) AS n, coalesce(close / lag(close) OVER w - 1, 0) AS mkt FROM oos WHERE strategy <> 'vol_breakout' WINDOW w AS (PARTITION BY symbol, strategy ORDER BY i)"
FR["able"] = "SELECT symbol, strategy, any_value(n) AS n FROM pos_oos GROUP BY 1, 2 HAVING any_value(n) >= 120 AND min(held) <> max(held)"
FR["shifts"] = f"SELECT symbol, strategy, n, k, CASE WHEN k = 0 THEN 0 ELSE 20 + {_draw(7, 'k')} % (n - 40) END AS s FROM able, LATERAL (SELECT unnest(range(0, {N_PERM + 1})) AS k)"
FR["moved_held"] = """SELECT a.symbol, a.strategy, a.k, a.n, p.j, p.mkt, h.held FROM shifts a JOIN pos_oos p ON p.symbol = a.symbol AND p.strategy = a.strategy JOIN pos_oos h ON h.symbol = a.symbol AND h.strategy = a.strategy AND h.j = (p.j - a.s + a.n) % a.n"""
FR["sims"] = """SELECT symbol, strategy, k, CASE WHEN var_samp(r) > 0 THEN round((avg(r) - 0.0001) / stddev_samp(r), 9) ELSE 0 END AS sr FROM
  (SELECT symbol, strategy, k, held * mkt + (1 - held) * 0.0001 - 0.0005 * abs(held - coalesce(lag(held) OVER (PARTITION BY symbol, strategy, k ORDER BY j), held)) AS r FROM moved_held) GROUP BY 1, 2, 3"""


def _held_oos(t: Panels) -> DataFrame:
    return t.oos.where("strategy <> 'vol_breakout'")


def _oos_trades(t: Panels) -> DataFrame:
    return va.oos_trades(t.trades, t.stored_bars, va.folds(t.stored_bars), t.chosen)


def _random_days(t: Panels) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample trades of the day strategy and the open-to-open returns of all days that they could have been."""
    fee = acc.FEE
    o2o = t.bars.select("symbol", ind.bar_index().alias("i"), (F.lead("open").over(ind.history()) * (1 - fee) / (c("open") * (1 + fee)) - 1).alias("ret"))
    return _oos_trades(t).where("strategy = 'vol_breakout'"), va._in_fold(o2o, va.folds(t.bars), "a", "b")


FR["perm_p"] = f"""WITH p AS (SELECT x.symbol, x.strategy, (1 + count(*) FILTER (x.sr >= a.sr)) / {N_PERM + 1} AS p FROM sims x JOIN sims a ON a.symbol = x.symbol AND a.strategy = x.strategy AND a.k = 0 WHERE x.k > 0 GROUP BY 1, 2)
    SELECT q.symbol, q.strategy, p.p FROM (SELECT DISTINCT symbol, strategy FROM pos_oos) q LEFT JOIN p ON p.symbol = q.symbol AND p.strategy = q.strategy"""


@query("SELECT * FROM perm_p", FR)
def v5_permutation_p(t: Panels) -> DataFrame:
    return va.permutation_p(_held_oos(t), N_PERM)


@query()
def v5_permutation_p_full(t: Panels) -> DataFrame:
    return va.permutation_p(_held_oos(t))


N_DRAWS = 1000
FR["otrb"] = "SELECT symbol, strategy, count(*) AS n, avg(ret) AS actual FROM otr WHERE strategy = 'vol_breakout' GROUP BY 1, 2"
FR["o2o"] = "SELECT m.symbol, m.i, lead(m.open) OVER (PARTITION BY m.symbol ORDER BY m.i) * (1 - 0.0005) / (m.open * (1 + 0.0005)) - 1 AS ret FROM moves m"
FR["pool"] = "SELECT p.symbol, p.ret AS r, row_number() OVER (PARTITION BY p.symbol ORDER BY p.i) - 1 AS pick, count(*) OVER (PARTITION BY p.symbol) AS pool FROM o2o p JOIN folds f ON f.symbol = p.symbol AND p.i >= f.a AND p.i < f.b WHERE p.ret IS NOT NULL"


FR["day_p"] = f"""WITH g AS (SELECT t.*, z.pool FROM otrb t JOIN (SELECT symbol, any_value(pool) AS pool FROM pool GROUP BY 1) z ON z.symbol = t.symbol WHERE n >= 10 AND z.pool >= 30),
    d AS (SELECT g.*, draw, place, {_draw(7, 'draw', 'place')} % g.pool AS pick FROM g, LATERAL (SELECT unnest(range(1, {N_DRAWS + 1})) AS draw), LATERAL (SELECT unnest(range(1, n + 1)) AS place)),
    s AS (SELECT d.symbol, d.strategy, d.draw, avg(p.r) AS sim, any_value(actual) AS actual FROM d JOIN pool p ON p.symbol = d.symbol AND p.pick = d.pick GROUP BY 1, 2, 3)
    SELECT symbol, strategy, (1 + count(*) FILTER (round(sim, 12) >= round(actual, 12))) / {N_DRAWS + 1} AS p FROM s GROUP BY 1, 2"""


@query("SELECT * FROM day_p", FR)
def v6_random_day_p(t: Panels) -> DataFrame:
    return va.random_day_p(*_random_days(t), N_DRAWS)


@query()
def v6_random_day_p_full(t: Panels) -> DataFrame:
    return va.random_day_p(*_random_days(t))


FR["boot"] = f"""WITH b AS (SELECT symbol, strategy, ret AS r, row_number() OVER (PARTITION BY symbol, strategy ORDER BY entry, variant) - 1 AS pick, count(*) OVER (PARTITION BY symbol, strategy) AS n FROM otr),
    g AS (SELECT DISTINCT symbol, strategy, n FROM b WHERE n >= 5),
    d AS (SELECT g.*, draw, place, {_draw(7, 'draw', 'place')} % n AS pick FROM g, LATERAL (SELECT unnest(range(1, {N_DRAWS + 1})) AS draw), LATERAL (SELECT unnest(range(1, n + 1)) AS place)),
    e AS (SELECT d.symbol, d.strategy, d.draw, d.place, product(1 + b.r) OVER (PARTITION BY d.symbol, d.strategy, d.draw ORDER BY d.place ROWS UNBOUNDED PRECEDING) AS eq FROM d JOIN b ON b.symbol = d.symbol AND b.strategy = d.strategy AND b.pick = d.pick),
    m AS (SELECT *, eq / greatest(max(eq) OVER (PARTITION BY symbol, strategy, draw ORDER BY place ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM e),
    x AS (SELECT symbol, strategy, draw, max_by(eq, place) - 1 AS final, min(dd) AS mdd FROM m GROUP BY 1, 2, 3)
    SELECT symbol, strategy, quantile_cont(final, 0.05) AS ret_p5, quantile_cont(final, 0.5) AS ret_p50, quantile_cont(final, 0.95) AS ret_p95, quantile_cont(mdd, 0.05) AS mdd_p5, quantile_cont(mdd, 0.5) AS mdd_p50 FROM x GROUP BY 1, 2"""


@query("SELECT * FROM boot", FR)
def v7_trade_bootstrap(t: Panels) -> DataFrame:
    return va.trade_bootstrap(_oos_trades(t), N_DRAWS)


@query()
def v7_trade_bootstrap_full(t: Panels) -> DataFrame:
    return va.trade_bootstrap(_oos_trades(t))


FR["mom"] = f"""SELECT a.symbol, a.strategy, a.variant, count(*) AS n, any_value(m.mean) AS mean, any_value(m.sd) AS sd, avg(pow((ret - 0.0001 - m.mean) / m.sd, 3)) AS skew, avg(pow((ret - 0.0001 - m.mean) / m.sd, 4)) AS kurt
  FROM all_ret a JOIN (SELECT {KEYS}, avg(ret - 0.0001) AS mean, stddev_samp(ret - 0.0001) AS sd FROM all_ret GROUP BY {KEYS}) m ON a.symbol = m.symbol AND a.strategy = m.strategy AND a.variant = m.variant WHERE m.sd > 0 GROUP BY 1, 2, 3"""


def _psr(star: str) -> str:
    sr, room = "(mean / sd)", "(1 - skew * mean / sd + (kurt - 1) / 4 * (mean / sd) * (mean / sd))"
    return f"coalesce({o.normal_cdf('z')}, 0)", f"CASE WHEN n >= 30 AND sd > 0 AND {room} > 0 THEN ({sr} - {star}) * sqrt(n - 1) / sqrt({room}) END"


@query(f"SELECT {', '.join('k.' + x for x in KEYS.split(', '))}, round(coalesce({_psr('0')[0]}, 0), 6) AS psr FROM (SELECT DISTINCT {KEYS} FROM all_ret) k LEFT JOIN (SELECT *, {_psr('0')[1]} AS z FROM mom) m ON m.symbol = k.symbol AND m.strategy = k.strategy AND m.variant = k.variant", FR)
def v8_probabilistic_sharpe(t: Panels) -> DataFrame:
    return va.psr(met.moments(t.returns, acc.KEYS)).select(*acc.KEYS, F.round("psr", 6).alias("psr"))


@query(f"SELECT symbol, sqrt(var_samp(sr)) * 2.0733923079499466 AS sr0 FROM (SELECT {KEYS}, {PERIOD} AS sr FROM all_ret GROUP BY {KEYS}) GROUP BY 1", FR)
def v9_expected_max_sharpe(t: Panels) -> DataFrame:
    return va.expected_max_sr(t.returns, 30)


FR["best"] = f"SELECT * FROM (SELECT {KEYS}, round({SHARPE}, 3) AS s FROM all_ret GROUP BY {KEYS}) QUALIFY row_number() OVER (PARTITION BY symbol, strategy ORDER BY s DESC, variant) = 1"
FR["sr0"] = f"SELECT symbol, sqrt(var_samp(sr)) * 2.0733923079499466 AS sr0 FROM (SELECT {KEYS}, {PERIOD} AS sr FROM all_ret GROUP BY {KEYS}) GROUP BY 1"


FR["deflated"] = f"""SELECT b.symbol, b.strategy, b.variant, round(coalesce({_psr('sr0')[0]}, 0), 3) AS dsr FROM best b LEFT JOIN
    (SELECT mom.*, {_psr('sr0')[1]} AS z FROM mom JOIN sr0 ON sr0.symbol = mom.symbol) m ON m.symbol = b.symbol AND m.strategy = b.strategy AND m.variant = b.variant"""


@query("SELECT * FROM deflated", FR)
def v10_deflated_sharpe(t: Panels) -> DataFrame:
    return va.deflated_sharpe(t.returns, 30)


GRADED = """SELECT id, symbol, horizon, CASE WHEN id % 2 = 0 THEN 'trend' ELSE 'day' END AS family, score AS vote0, CASE WHEN id % 9 = 0 THEN NULL ELSE confidence / 3 END AS p, score * 2 AS oos_sharpe, id % 30 AS oos_trades, 1 - confidence / 2 AS dsr FROM runs"""
GRADE = """CASE WHEN p <= 0.05 AND oos_trades >= 15 AND oos_sharpe >= 0.5 AND dsr >= 0.8 THEN 'A' WHEN p <= 0.1 AND oos_trades >= 8 AND oos_sharpe >= 0.3 AND dsr >= 0.5 THEN 'B' WHEN p <= 0.25 AND oos_trades >= 5 AND oos_sharpe > 0 THEN 'C' ELSE 'F' END"""
FR["grd0"] = f"SELECT *, {GRADE} AS grade FROM ({GRADED})"
FR["grd"] = "SELECT *, CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.6 WHEN 'C' THEN 0.25 ELSE 0 END AS weight, sign(vote0) AS vote FROM grd0"


def _graded(t: Panels) -> DataFrame:
    """Run records read as validation rows: their confidence and score stand for p, Sharpe and the deflated ratio."""
    rows = t.runs.select(
        "id", "symbol", "horizon", F.when(c("id") % 2 == 0, "trend").otherwise("day").alias("family"), F.signum("score").alias("vote"), F.when(c("id") % 9 != 0, c("confidence") / 3).alias("p"),
        (c("score") * 2).alias("oos_sharpe"), (c("id") % 30).alias("oos_trades"), (1 - c("confidence") / 2).alias("dsr"),
    )
    return va.graded(rows)


@query("SELECT id, grade, weight FROM grd", FR)
def v11_grade_strategies(t: Panels) -> DataFrame:
    return _graded(t).select("id", "grade", "weight")


@query("SELECT symbol, sum(weight * vote) / sum(weight) AS score, least(1, sum(weight) / 2) AS confidence FROM grd WHERE weight > 0 AND family <> 'day' GROUP BY 1", FR)
def v13_strategy_score(t: Panels) -> DataFrame:
    return va.strategy_score(_graded(t))


@query("SELECT symbol, CAST(vote AS INT) AS side, sum(weight) AS weight FROM grd WHERE weight > 0 AND family <> 'day' GROUP BY 1, 2", FR)
def a19_vote_weights(t: Panels) -> DataFrame:
    return va.vote_weights(_graded(t))


@query("SELECT id, symbol, row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, coalesce(oos_sharpe, -9) DESC, id) AS rank FROM grd", FR)
def t7_rank_strategies(t: Panels) -> DataFrame:
    return va.rank_strategies(_graded(t).withColumn("strategy", c("id"))).select("id", "symbol", "rank")


@query("SELECT symbol, id, weight FROM grd WHERE grade IN ('A', 'B') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, id) = 1", FR)
def t9_kelly_source(t: Panels) -> DataFrame:
    rows = _graded(t).where("grade in ('A', 'B')").withColumn("variant", c("id"))
    return va.argmax_variant(rows, ["symbol"], "weight").select("symbol", "id", "weight")


_FAMILY = "CASE WHEN strategy = 'vol_breakout' THEN 'day' WHEN strategy IN ('rsi_cross', 'bollinger', 'rsi2') THEN 'reversion' ELSE 'trend' END"


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY date DESC) AS k FROM all_ret WHERE strategy <> 'vol_breakout'),
    s AS (SELECT {KEYS}, round({SHARPE}, 9) AS s FROM r WHERE k <= 756 GROUP BY {KEYS}), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol, strategy ORDER BY s DESC, variant) = 1),
    n AS (SELECT {KEYS}, max_by(pos, date) AS decision FROM pos GROUP BY {KEYS})
    SELECT b.symbol, b.strategy, b.variant, n.decision, CASE WHEN n.decision >= 0.5 THEN 1.0 WHEN {_FAMILY.replace('strategy', 'b.strategy')} = 'trend' THEN -1.0 ELSE 0.0 END AS vote
    FROM b JOIN n ON n.symbol = b.symbol AND n.strategy = b.strategy AND n.variant = b.variant""",
    FR,
)
def v12_current_signal(t: Panels) -> DataFrame:
    positions = st.stacked(t.wide, st.position_keys())
    families = st.strategy_grid(t.spark).select("strategy", "family").distinct()
    return va.current_signal(t.returns.where("strategy <> 'vol_breakout'"), positions, families)


@query(
    f"""WITH h AS (SELECT symbol, i, CASE WHEN pc IS NULL THEN 0.0 ELSE (1 + CASE WHEN i > 1 THEN open / pc - 1 ELSE 0 END) * (close / open) - 1 - CASE WHEN i = 1 THEN 0.0005 ELSE 0 END END AS ret FROM moves),
    o AS (SELECT h.symbol, {SHARPE} AS oos_sharpe FROM h JOIN folds f ON f.symbol = h.symbol AND h.i >= f.a AND h.i < f.b GROUP BY 1),
    g AS (SELECT symbol, {SHARPE} AS full_sharpe, count(*) AS bars FROM h GROUP BY 1), n AS (SELECT symbol, count(*) AS folds FROM folds GROUP BY 1), d AS (SELECT symbol, min(date) AS start, max(date) AS "end" FROM bars GROUP BY 1)
    SELECT g.symbol, full_sharpe, oos_sharpe, bars, n.folds, d.start, d."end" FROM g JOIN o ON o.symbol = g.symbol JOIN n ON n.symbol = g.symbol JOIN d ON d.symbol = g.symbol""",
    FR,
)
def v14_validation_report(t: Panels) -> DataFrame:
    f = va.folds(t.bars)
    hold = va.numbered(acc.buy_hold(t.bars))
    full = hold.groupBy("symbol").agg(met.sharpe().alias("full_sharpe"), F.count(F.lit(1)).alias("bars"), F.min("date").alias("start"), F.max("date").alias("end"))
    oos = va._in_fold(hold, f, "a", "b").groupBy("symbol").agg(met.sharpe().alias("oos_sharpe"))
    return full.join(oos, "symbol").join(f.groupBy("symbol").agg(F.count(F.lit(1)).alias("folds")), "symbol")


def _report(t: Panels, **sizes) -> DataFrame:
    """The chain of validation over all strategies, from tables that are written once."""
    returns, trades = t.returns, t.trades
    fee = acc.FEE
    o2o = t.stored_bars.select("symbol", ind.bar_index().alias("i"), (F.lead("open").over(ind.history()) * (1 - fee) / (c("open") * (1 + fee)) - 1).alias("ret"))
    positions = st.stacked(t.wide, st.position_keys()).unionByName(st.stacked(t.wide, st.breakout_keys()).withColumn("value", F.lit(0.0)))
    since = F.to_date(F.lit("2000-06-01"))
    return va.strategy_report(returns, trades, t.stored_bars, positions, st.strategy_grid(t.spark), o2o, 30, marks_since=since, chosen=t.chosen, oos=t.oos, **sizes)


MARK = """WITH r AS (SELECT * FROM trades WHERE entry >= DATE '2000-06-01'), m AS (SELECT symbol, strategy, variant, entry, entry AS time, 'buy' AS side, entry_px AS price FROM r UNION ALL SELECT symbol, strategy, variant, entry, exit, 'sell', exit_px FROM r WHERE NOT is_open)
    SELECT symbol, strategy, variant, time, side, price FROM m QUALIFY row_number() OVER (PARTITION BY symbol, strategy, variant ORDER BY entry DESC, side DESC) <= 60"""
FR["signal"] = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY date DESC) AS k FROM all_ret),
    s AS (SELECT {KEYS}, round({SHARPE}, 9) AS s FROM r WHERE k <= 756 GROUP BY {KEYS}), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol, strategy ORDER BY s DESC, variant) = 1),
    n AS (SELECT {KEYS}, max_by(pos, date) AS pos FROM pos GROUP BY {KEYS}), d AS (SELECT b.symbol, b.strategy, b.variant, CASE WHEN b.strategy = 'vol_breakout' THEN 0.0 ELSE n.pos END AS decision
    FROM b LEFT JOIN n ON n.symbol = b.symbol AND n.strategy = b.strategy AND n.variant = b.variant)
    SELECT symbol, strategy, variant, decision, {_FAMILY} AS family, CASE WHEN decision >= 0.5 THEN 1.0 WHEN {_FAMILY} = 'trend' THEN -1.0 ELSE 0.0 END AS vote FROM d"""
FR["marks"] = MARK
FR["chain"] = f"""WITH x AS (SELECT symbol, strategy, {SHARPE} AS oos_sharpe, product(1 + ret) - 1 AS oos_return, avg(held) AS oos_exposure FROM oos GROUP BY 1, 2),
    y AS (SELECT symbol, strategy, fold, {SHARPE} AS x FROM oos GROUP BY 1, 2, 3), w AS (SELECT symbol, strategy, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS oos_win_rate, count(*) AS n FROM otr GROUP BY 1, 2),
    e AS (SELECT k.symbol, k.strategy, count(*) AS folds, avg(is_sharpe) AS is_mean, avg(x) AS oos_mean FROM chosen k JOIN y ON y.symbol = k.symbol AND y.strategy = k.strategy AND y.fold = k.fold GROUP BY 1, 2),
    q AS (SELECT symbol, strategy, p FROM perm_p UNION ALL SELECT symbol, strategy, p FROM day_p),
    h AS (SELECT symbol, strategy, variant, count(*) AS markers FROM marks GROUP BY 1, 2, 3),
    j AS (SELECT x.*, folds, is_mean, oos_mean, CASE WHEN is_mean > 0 THEN oos_mean / is_mean END AS efficiency, p, coalesce(w.n, 0) AS oos_trades, oos_win_rate, ret_p5, ret_p50, ret_p95, mdd_p5, mdd_p50,
      dsr, d.variant AS best_variant, g.variant AS current_variant, decision, vote, family, coalesce(markers, 0) AS markers
    FROM x JOIN e ON e.symbol = x.symbol AND e.strategy = x.strategy LEFT JOIN q ON q.symbol = x.symbol AND q.strategy = x.strategy LEFT JOIN w ON w.symbol = x.symbol AND w.strategy = x.strategy
    LEFT JOIN boot ON boot.symbol = x.symbol AND boot.strategy = x.strategy LEFT JOIN deflated d ON d.symbol = x.symbol AND d.strategy = x.strategy
    LEFT JOIN signal g ON g.symbol = x.symbol AND g.strategy = x.strategy LEFT JOIN h ON h.symbol = g.symbol AND h.strategy = g.strategy AND h.variant = g.variant)
    SELECT *, {GRADE} AS grade, CASE {GRADE} WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.6 WHEN 'C' THEN 0.25 ELSE 0.0 END AS weight FROM j"""


@query("SELECT * FROM chain", FR)
def v14_strategy_report(t: Panels) -> DataFrame:
    return _report(t)


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, coalesce(oos_sharpe, -9) DESC, strategy) AS k FROM chain),
    u AS (SELECT symbol, sum(weight * vote) / sum(weight) AS score, least(1, sum(weight) / 2) AS confidence, sum(weight) FILTER (vote > 0) AS "for", sum(weight) FILTER (vote = 0) AS flat, sum(weight) FILTER (vote < 0) AS against
      FROM chain WHERE weight > 0 AND family <> 'day' GROUP BY 1),
    z AS (SELECT symbol, strategy AS kelly_source FROM chain WHERE grade IN ('A', 'B') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, strategy) = 1)
    SELECT r.symbol, ranked, score, confidence, "for", flat, against, kelly_source FROM (SELECT symbol, string_agg(strategy, ',' ORDER BY k) AS ranked FROM o GROUP BY 1) r
    LEFT JOIN u ON u.symbol = r.symbol LEFT JOIN z ON z.symbol = r.symbol""",
    FR,
)
def v13_validated_votes(t: Panels) -> DataFrame:
    """Score, votes, ranks and the Kelly source of each symbol from its validated strategies."""
    rows = written(_report(t), "report")
    ranks = va.rank_strategies(rows).groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "strategy"))), lambda x: x["strategy"]), ",").alias("ranked"))
    weights = va.vote_weights(rows).groupBy("symbol").agg(*[F.sum(F.when(c("side") == k, c("weight"))).alias(n) for n, k in (("for", 1), ("flat", 0), ("against", -1))])
    kelly = va.argmax_variant(rows.where("grade in ('A', 'B')").withColumn("variant", c("strategy")), ["symbol"], "weight").select("symbol", c("strategy").alias("kelly_source"))
    return ranks.join(va.strategy_score(rows), "symbol", "left").join(weights, "symbol", "left").join(kelly, "symbol", "left")


@query(MARK, FR)
def t8_markers(t: Panels) -> DataFrame:
    return va.markers(t.trades, F.to_date(F.lit("2000-06-01")))


# Resampling: the same draws in both engines. The queries named _full are older names of the same rows.
PATHS, ALL_PATHS, STEPS = 2000, 2000, 252
FR["lr"] = f"SELECT symbol, date, ln(close) - ln(lag(close) {o.OVER}) AS r FROM bars"
FR["lr3"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM lr WHERE r IS NOT NULL) WHERE k <= 756"
# The salt of a symbol is the CRC-32 of its bytes, a fold over bytes and their bits.
_BITS = "list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_SALT = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(symbol, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: {_BITS}), 4294967295)"
FR["lrs"] = f"SELECT *, {_SALT} AS salt FROM (SELECT symbol, count(r) AS n, avg(r) AS mean, var_samp(r) AS v FROM lr3 GROUP BY 1)"
FR["lrp"] = f"SELECT l.symbol, row_number() OVER (PARTITION BY l.symbol ORDER BY l.date) - 1 AS pick, l.r - s.mean + ln(1 + 0.03 + 0.045) / {STEPS} - s.v / 2 AS x FROM lr3 l JOIN lrs s ON s.symbol = l.symbol"
FR["bb0"] = f"""SELECT symbol, n, path, step, CASE WHEN step = 0 OR {_draw(11, 'salt', 'path', 'step', '1')} % 10 = 0 THEN step END AS s0, {_draw(11, 'salt', 'path', 'step', '2')} % n AS p0
  FROM lrs, LATERAL (SELECT unnest(range(0, {PATHS})) AS path), LATERAL (SELECT unnest(range(0, {STEPS})) AS step)"""
FR["bb"] = """SELECT symbol, path, step, (last_value(CASE WHEN s0 IS NOT NULL THEN p0 END IGNORE NULLS) OVER w + step - last_value(s0 IGNORE NULLS) OVER w) % n AS pick FROM bb0
  WINDOW w AS (PARTITION BY symbol, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
FR["fp"] = "SELECT b.symbol, b.path, b.step, exp(sum(p.x) OVER (PARTITION BY b.symbol, b.path ORDER BY b.step ROWS UNBOUNDED PRECEDING)) AS growth FROM bb b JOIN lrp p ON p.symbol = b.symbol AND p.pick = b.pick"


def _sizes(t: Panels) -> DataFrame:
    r = tail(t.stored_bars.select("symbol", "date", ind.log_return().alias("r")).where("r is not null"), 3 * STEPS)
    return r.groupBy("symbol").agg(F.count("r").alias("n"))


def _paths(t: Panels, n_paths: int = PATHS, make=rs.path_arrays) -> DataFrame:
    drifts = rs.drift(t.stored_bars.select("symbol").distinct().select("symbol", F.lit(0.03).alias("rf"), F.lit(1.0).alias("beta")))
    return make(t.stored_bars, drifts, n_paths, STEPS)


@query("SELECT symbol, path, step, pick FROM bb", FR)
def r1_block_bootstrap(t: Panels) -> DataFrame:
    return rs.block_bootstrap(_sizes(t), PATHS, STEPS)


@query()
def r1_block_bootstrap_full(t: Panels) -> DataFrame:
    return rs.block_bootstrap(_sizes(t), ALL_PATHS, STEPS)


@query("SELECT symbol, path, step, growth FROM fp", FR)
def r2_forward_paths(t: Panels) -> DataFrame:
    return _paths(t, make=rs.forward_paths)


@query()
def r2_forward_paths_full(t: Panels) -> DataFrame:
    return _paths(t, ALL_PATHS, rs.forward_paths)


@query("SELECT id, confidence AS rf, score AS beta, confidence + greatest(0, least(2.5, score)) * 0.045 AS drift FROM runs")
def r3_drift(t: Panels) -> DataFrame:
    return rs.drift(t.runs.select("id", c("confidence").alias("rf"), c("score").alias("beta")))


_ENDS = " UNION ALL ".join(f"SELECT symbol, '{k}' AS horizon, growth - 1 AS f FROM fp WHERE step = {h - 1}" for k, h in HORIZON_BARS.items())
_Q = lambda x: ", ".join(f"quantile_cont({x}, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95))


@query(f"SELECT symbol, horizon, avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END) AS p_up, {_Q('f')}, -avg(f) FILTER (r <= greatest(1, k // 20)) AS cvar95 FROM (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY f) AS r, count(*) OVER (PARTITION BY symbol, horizon) AS k FROM ({_ENDS})) GROUP BY 1, 2", FR)
def a16_path_summary(t: Panels) -> DataFrame:
    return rs.summarize_paths(_paths(t))


@query()
def a16_path_summary_full(t: Panels) -> DataFrame:
    return rs.summarize_paths(_paths(t, ALL_PATHS))


@query(f"SELECT symbol, step + 1 AS day, {_Q('growth')} FROM fp WHERE (step + 1) % 4 = 0 GROUP BY 1, 2", FR)
def a17_path_fan(t: Panels) -> DataFrame:
    return _paths(t, make=rs.forward_fan)


@query()
def a17_path_fan_full(t: Panels) -> DataFrame:
    return _paths(t, ALL_PATHS, rs.forward_fan)


PLAN = """SELECT symbol, max_by(close, date) AS price, max_by(atr14, date) AS atr FROM smooth1 GROUP BY 1"""
FR["plan"] = f"SELECT symbol, price, atr, greatest(price - 3 * atr, price * 0.5) AS stop, price + 6 * atr AS target FROM ({PLAN})"


def _plan(t: Panels) -> DataFrame:
    now = ind.newest(with_smoothed(t.bars, ["atr14"])).select("symbol", c("close").alias("price"), c("atr14").alias("atr"))
    return rs.trade_plan(now.select("*", F.lit(0.55).alias("win_rate"), F.lit(0.04).alias("avg_win"), F.lit(-0.03).alias("avg_loss")), "mid")


@query(
    """SELECT symbol, 'mid' AS horizon, price, atr, stop, target, CAST(0.55 AS DOUBLE) AS win_rate, CAST(0.04 AS DOUBLE) AS avg_win, CAST(-0.03 AS DOUBLE) AS avg_loss, (target - price) / (price - stop) AS reward_risk,
    least(0.01 / ((price - stop) / price), 0.25) AS max_weight, least(greatest((0.55 - 0.45 / (0.04 / 0.03)) / 2, 0), 0.25) AS kelly_half FROM plan""",
    FR,
)
def r5_trade_plan(t: Panels) -> DataFrame:
    return _plan(t)


@query(
    """WITH x AS (SELECT f.symbol, f.path, min(step) FILTER (growth * price >= target) AS t, min(step) FILTER (growth * price <= stop) AS s, max_by(growth, step) - 1 AS e, any_value(target / price - 1) AS up, any_value(stop / price - 1) AS down
      FROM fp f JOIN plan p ON p.symbol = f.symbol WHERE step < 63 GROUP BY 1, 2),
    g AS (SELECT symbol, avg(CASE WHEN coalesce(t, 64) < coalesce(s, 64) THEN 1.0 ELSE 0.0 END) AS pt, avg(CASE WHEN coalesce(s, 64) < coalesce(t, 64) THEN 1.0 ELSE 0.0 END) AS ps,
      avg(CASE WHEN t IS NULL AND s IS NULL THEN 1.0 ELSE 0.0 END) AS pn, coalesce(avg(e) FILTER (t IS NULL AND s IS NULL), 0) AS rest, any_value(up) AS up, any_value(down) AS down FROM x GROUP BY 1)
    SELECT symbol, pt AS p_target_first, ps AS p_stop_first, pn AS p_neither, pt * up + ps * down + pn * rest AS expected_return FROM g""",
    FR,
)
def r4_first_touch(t: Panels) -> DataFrame:
    return rs.first_touch(_paths(t), _plan(t), HORIZON_BARS["mid"])


@query()
def r4_first_touch_full(t: Panels) -> DataFrame:
    return rs.first_touch(_paths(t, ALL_PATHS), _plan(t), HORIZON_BARS["mid"])


# The older names have the same rows.
SQL.update({f"{n}_full": SQL[n] for n in ("v5_permutation_p", "v6_random_day_p", "v7_trade_bootstrap", "r1_block_bootstrap", "r2_forward_paths", "a16_path_summary", "a17_path_fan", "r4_first_touch")})
