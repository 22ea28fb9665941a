"""Queries of company quality, value, consensus and checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fundamentals as fu
from .oracle import normal_cdf
from .registry import Panels, query

c = F.col
RF = 0.04
_ITEMS = {
    "revenue": "Total Revenue", "gross": "Gross Profit", "ebit": "EBIT", "net_income": "Net Income", "interest": "Interest Expense", "assets": "Total Assets", "current_assets": "Current Assets",
    "current_liabilities": "Current Liabilities", "lt_debt": "Long Term Debt", "liabilities": "Total Liabilities Net Minority Interest", "equity": "Stockholders Equity", "retained": "Retained Earnings",
    "shares": "Ordinary Shares Number", "cfo": "Operating Cash Flow", "capex": "Capital Expenditure", "sbc": "Stock Based Compensation",
}
INFO = {
    "sector": "CASE WHEN CAST(substring(symbol, 2) AS INT) % 5 = 0 THEN 'Financial Services' ELSE 'Technology' END", "market_cap": "revenue_0 * 2", "price": "revenue_0 * 2 / shares_0",
    "ev": "revenue_0 * 2 + lt_debt_0", "beta": "0.5 + CAST(substring(symbol, 2) AS INT) % 10 / 5.0", "total_debt": "lt_debt_0", "total_cash": "current_assets_0 * 0.1", "trailing_eps": "net_income_0 / shares_0",
    "forward_eps": "net_income_0 / shares_0 * 1.1", "book_value": "equity_0 / shares_0", "op_margin": "ebit_0 / revenue_0", "peg": "1.0 + CAST(substring(symbol, 2) AS INT) % 4 / 2.0",
    "pe": "revenue_0 * 2 / net_income_0", "pb": "revenue_0 * 2 / equity_0", "ev_ebitda": "10 + CAST(substring(symbol, 2) AS INT) % 9 * 2.0", "dividend_rate": "revenue_0 * 0.02 / shares_0",
}
FR = {"st": "SELECT *, dense_rank() OVER (PARTITION BY symbol, stmt ORDER BY period_end DESC) - 1 AS i FROM statements"}
FR["piv"] = "SELECT symbol, " + ", ".join(f"max(value) FILTER (item = '{n}' AND i = {i}) AS {k}_{i}" for k, n in _ITEMS.items() for i in range(4)) + ", " + ", ".join(f"list(value ORDER BY i) FILTER (item = '{_ITEMS[k]}') AS {k}_hist" for k in ("revenue", "net_income", "equity")) + ", max(i) FILTER (stmt = 'income') + 1 AS years FROM st GROUP BY 1"
FR["inf"] = "SELECT *, " + ", ".join(f"CAST({v} AS {'VARCHAR' if k == 'sector' else 'DOUBLE'}) AS {k}" for k, v in INFO.items()) + " FROM piv"


def _clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


def _band(x: str, edges: list[tuple[float, float]], default: float) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL " + " ".join(f"WHEN {x} >= {e} THEN {s}" for e, s in edges) + f" ELSE {default} END"


def _mean(parts: list[tuple[float, str]]) -> tuple[str, str]:
    den = " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE 0 END" for w, x in parts)
    num = " + ".join(f"coalesce(CAST({w} AS DOUBLE) * ({x}), 0)" for w, x in parts)
    return f"(({num}) / nullif({den}, 0))", f"({den})"


FR["met1"] = """SELECT *, sector = 'Financial Services' AS financial, 0.21::DOUBLE AS tax_rate, current_assets_0 - current_liabilities_0 AS m_working,
  CASE WHEN revenue_1 IS NOT NULL THEN pow(revenue_0 / coalesce(revenue_3, revenue_2, revenue_1), 1.0 / (CASE WHEN revenue_3 IS NOT NULL THEN 3 WHEN revenue_2 IS NOT NULL THEN 2 ELSE 1 END)) - 1 END AS rev_cagr_3y,
  revenue_0 / revenue_1 - 1 AS rev_growth_yoy, CASE WHEN len(revenue_hist) >= 3 THEN len(list_filter(range(1, len(revenue_hist)), lambda k: revenue_hist[k] > revenue_hist[k + 1])) = len(revenue_hist) - 1 END AS rev_all_up,
  gross_0 / revenue_0 AS gross_margin, net_income_0 / equity_0 AS m_roe, ebit_0 / nullif(abs(interest_0), 0) AS interest_coverage, current_assets_0 / nullif(current_liabilities_0, 0) AS current_ratio, abs(capex_0) / revenue_0 AS capex_ratio, sbc_0 / revenue_0 AS sbc_ratio,
  CASE WHEN net_income_0 > 0 THEN cfo_0 / net_income_0 END AS cfo_to_ni, shares_0 / shares_1 - 1 AS share_change, dividend_rate / price AS dividend_yield, CASE WHEN ev > 0 THEN ebit_0 / ev END AS earnings_yield,
  (coalesce(ebit_0, 0) + coalesce(ebit_1, 0) + coalesce(ebit_2, 0)) / ((ebit_0 IS NOT NULL)::INT + (ebit_1 IS NOT NULL)::INT + (ebit_2 IS NOT NULL)::INT) AS ebit_norm, lt_debt_0 / equity_0 AS debt_to_equity,
  list_filter(list_transform(range(1, len(net_income_hist) + 1), lambda k: net_income_hist[k] / equity_hist[k]), lambda x: x IS NOT NULL) AS roe_hist, total_cash - total_debt AS net_cash FROM inf"""
_BASE = lambda i: f"coalesce(assets_{i + 1}, assets_{i})"
_CHECKS = [
    f"net_income_0 / {_BASE(0)} > 0", "cfo_0 > 0", f"net_income_0 / {_BASE(0)} > net_income_1 / {_BASE(1)}", f"cfo_0 / {_BASE(0)} > net_income_0 / {_BASE(0)}",
    "CASE WHEN coalesce(lt_debt_0, 0) / assets_0 = 0 THEN true ELSE coalesce(lt_debt_0, 0) / assets_0 < coalesce(lt_debt_1, 0) / assets_1 END",
    "current_assets_0 / nullif(current_liabilities_0, 0) > current_assets_1 / nullif(current_liabilities_1, 0)", "shares_0 <= shares_1 * 1.005", "gross_0 / revenue_0 > gross_1 / revenue_1", f"revenue_0 / {_BASE(0)} > revenue_1 / {_BASE(1)}",
]
_N = " + ".join(f"(({x}) IS NOT NULL)::INT" for x in _CHECKS)
_P = " + ".join(f"coalesce(({x})::INT, 0)" for x in _CHECKS)
FR["met2"] = f"SELECT *, CASE WHEN {_N} >= 6 AND years >= 2 THEN {_P} END AS f_score, CASE WHEN {_N} >= 6 AND years >= 2 THEN {_N} END AS f_max FROM met1"
FR["met3"] = """SELECT *, CASE WHEN NOT financial AND assets_0 > 0 AND liabilities_0 > 0 THEN 1.2 * m_working / assets_0 + 1.4 * coalesce(retained_0, 0) / assets_0 + 3.3 * coalesce(ebit_0, 0) / assets_0
  + 0.6 * market_cap / liabilities_0 + coalesce(revenue_0, 0) / assets_0 END AS z, greatest(-0.05, least(0.3, CAST(rev_cagr_3y AS DOUBLE))) + 0 * rev_cagr_3y AS g1,
  0.04 + (greatest(0.3, least(3, beta)) * 0.67 + 0.33) * 0.045 AS cost_of_equity, CASE WHEN interest_0 IS NOT NULL AND total_debt > 0 THEN greatest(0.02, least(0.1, abs(interest_0) / total_debt)) ELSE 0.055 END AS cost_of_debt,
  CASE WHEN NOT financial THEN (coalesce(cfo_0 + abs(coalesce(interest_0, 0)) * (1 - tax_rate) - abs(capex_0) - coalesce(sbc_0, 0), 0) + coalesce(cfo_1 + abs(coalesce(interest_1, 0)) * (1 - tax_rate) - abs(capex_1) - coalesce(sbc_1, 0), 0))
    / nullif((cfo_0 IS NOT NULL AND capex_0 IS NOT NULL)::INT + (cfo_1 IS NOT NULL AND capex_1 IS NOT NULL)::INT, 0) END AS fcff0 FROM met2"""
FR["met4"] = "SELECT *, greatest(0.06, least(0.15, (market_cap * cost_of_equity + total_debt * cost_of_debt * (1 - tax_rate)) / (market_cap + total_debt))) AS wacc FROM met3"


def _dcf(g: str, w: str, terminal: str) -> str:
    """Closed list form: the growth factors of ten years multiplied up."""
    factors = [f"(1 + CASE WHEN {t} <= 5 THEN ({g}) ELSE ({g}) + ({terminal} - ({g})) * ({t} - 5) / 5.0 END)" for t in range(1, 11)]
    cash, pv = "fcff0", []
    for t, f in enumerate(factors, 1):
        cash = f"({cash} * {f})"
        pv.append(f"{cash} / pow(1 + ({w}), {t} - 0.5)")
    tail = f"{cash} * (1 + {terminal}) / (({w}) - {terminal}) / pow(1 + ({w}), 10)"
    return f"(({' + '.join(pv)} + {tail} - total_debt + total_cash) / shares_0)"


_ABLE = "fcff0 > 0 AND shares_0 > 0 AND g1 IS NOT NULL AND market_cap IS NOT NULL"
FR["met5"] = f"""SELECT *, CASE WHEN {_ABLE} THEN {_dcf('g1', 'wacc', '0.025')} END AS dcf, CASE WHEN forward_eps > 0 AND g1 >= 0.03 THEN greatest(8, least(30, g1 * 100)) * forward_eps END AS peg_value,
  CASE WHEN ebit_norm > 0 AND NOT financial THEN (ebit_norm * (1 - tax_rate) / wacc - total_debt + total_cash) / shares_0 END AS epv,
  CASE WHEN trailing_eps > 0 AND g1 IS NOT NULL THEN trailing_eps * (8.5 + 2 * greatest(0, least(10, g1 * 100))) * 4.4 / 4.8 END AS graham,
  CASE WHEN trailing_eps > 0 AND book_value > 0 THEN sqrt(22.5 * trailing_eps * book_value) END AS graham_number FROM met4"""
_FAIR, _ = _mean([(0.5, "CASE WHEN dcf > 0 THEN dcf END"), (0.3, "CASE WHEN peg_value > 0 THEN peg_value END"), (0.2, "CASE WHEN graham > 0 THEN graham END")])


def _info(pivot: DataFrame) -> DataFrame:
    return pivot.select("symbol", *[F.expr(f"CAST({v} AS {'STRING' if k == 'sector' else 'DOUBLE'})").alias(k) for k, v in INFO.items()])


def _metrics(t: Panels) -> DataFrame:
    pivot = fu.stmt_pivot(t.statements)
    return fu.build_metrics(pivot, _info(pivot))


def _valued(t: Panels) -> DataFrame:
    m = fu.altman_z(fu.piotroski(_metrics(t)))
    return fu.fcff_base(fu.wacc(fu.plausible_growth(m), RF))


METRIC_NAMES = ["rev_cagr_3y", "rev_growth_yoy", "gross_margin", "m_roe", "interest_coverage", "current_ratio", "capex_ratio", "sbc_ratio", "cfo_to_ni", "share_change", "dividend_yield", "earnings_yield", "ebit_norm", "debt_to_equity", "net_cash", "m_working"]


@query("SELECT symbol, revenue_0, revenue_1, net_income_0, net_income_3, assets_1, cfo_2, years FROM piv", FR)
def j10_statement_pivot(t: Panels) -> DataFrame:
    return fu.stmt_pivot(t.statements).select("symbol", "revenue_0", "revenue_1", "net_income_0", "net_income_3", "assets_1", "cfo_2", "years")


@query(f"SELECT symbol, rev_all_up, {', '.join(METRIC_NAMES)} FROM met1", FR)
def g1_metrics(t: Panels) -> DataFrame:
    return _metrics(t).select("symbol", "rev_all_up", *METRIC_NAMES)


@query("SELECT symbol, f_score, f_max FROM met2", FR)
def g2_piotroski(t: Panels) -> DataFrame:
    return fu.piotroski(_metrics(t)).select("symbol", "f_score", "f_max")


@query("SELECT symbol, z FROM met3", FR)
def g3_altman_z(t: Panels) -> DataFrame:
    return fu.altman_z(_metrics(t)).select("symbol", "z")


_P1 = _mean([(1, _band("m_roe", [(0.2, 1), (0.12, 0.5), (0.0, -0.1)], -1)), (1, _band("op_margin", [(0.2, 1), (0.1, 0.4), (0.0, -0.2)], -1))])
_P2 = _mean([(1, _band("rev_cagr_3y", [(0.15, 1), (0.05, 0.5), (0.0, -0.1)], -0.8))])
_PL = lambda x: f"CASE WHEN NOT financial THEN {x} END"
_P3 = _mean([(1, _PL(_band("-debt_to_equity", [(-0.5, 1), (-1.0, 0.4), (-2.0, -0.3)], -0.8))), (1, _PL(_band("interest_coverage", [(10, 1), (4, 0.4), (1.5, -0.4)], -1))), (1, _PL(_band("current_ratio", [(1.5, 0.6), (1.0, 0.1)], -0.6))), (1, "CASE WHEN z > 2.99 THEN 1.0 WHEN z > 1.81 THEN 0.0 WHEN z IS NOT NULL THEN -1.0 END")])
_P4 = _mean([(1, _band("cfo_to_ni", [(1.1, 0.6), (0.8, 0.1)], -0.6)), (1, "(f_score - f_max / 2.0) / (f_max / 2.0)")])
_Q, _ = _mean([(1, p[0]) for p in (_P1, _P2, _P3, _P4)])


@query(f"SELECT symbol, {_Q} AS quality_score, least(1, ({_P1[1]} + {_P2[1]} + {_P3[1]} + {_P4[1]}) / 10) AS quality_confidence FROM met3", FR)
def g4_quality(t: Panels) -> DataFrame:
    return fu.quality(fu.altman_z(fu.piotroski(_metrics(t)))).select("symbol", "quality_score", "quality_confidence")


@query("SELECT symbol, g1 FROM met3", FR)
def g5_plausible_growth(t: Panels) -> DataFrame:
    return fu.plausible_growth(_metrics(t)).select("symbol", "g1")


@query("SELECT symbol, wacc, cost_of_equity, cost_of_debt FROM met4", FR)
def g6_wacc(t: Panels) -> DataFrame:
    return fu.wacc(_metrics(t), RF).select("symbol", "wacc", "cost_of_equity", "cost_of_debt")


@query("SELECT symbol, fcff0 FROM met3", FR)
def g7_fcff_base(t: Panels) -> DataFrame:
    return fu.fcff_base(_metrics(t)).select("symbol", "fcff0")


@query("SELECT symbol, dcf FROM met5", FR)
def g8_dcf(t: Panels) -> DataFrame:
    return fu.valuation_models(_valued(t), RF).select("symbol", "dcf")


_GRID = " UNION ALL ".join(f"SELECT symbol, CAST({dw} AS DOUBLE) AS dw, CAST({dg} AS DOUBLE) AS dg, {_dcf('g1', f'wacc + {dw}', f'(0.025 + {dg})')} AS value FROM met4 WHERE {_ABLE}" for dw in (-0.01, 0.0, 0.01) for dg in (-0.005, 0.0, 0.005))


@query(_GRID, FR)
def g9_dcf_grid(t: Panels) -> DataFrame:
    return fu.dcf_grid(_valued(t))


# The value rises with growth: from the middle of -0.3 to 0.8 in 60 steps, each half of the one before.
_STEP = f"CASE WHEN {_dcf('x', 'wacc', '0.025')} < price THEN x + s ELSE x - s END"
_IMPLIED = f"CASE WHEN {_dcf('0.8', 'wacc', '0.025')} < price THEN 0.8 WHEN {_dcf('(-0.3)', 'wacc', '0.025')} > price THEN -0.3 ELSE list_reduce(list_prepend(0.25, list_transform(range(2, 62), lambda k: 1.1 / pow(2, k))), lambda x, s: {_STEP}) END"
FR["imp"] = f"SELECT *, CASE WHEN {_ABLE} THEN {_IMPLIED} END AS implied_g FROM met5"


@query(f"SELECT symbol, price, implied_g, {_dcf('implied_g', 'wacc', '0.025')} AS value FROM imp WHERE implied_g IS NOT NULL", FR)
def g10_implied_growth(t: Panels) -> DataFrame:
    """Growth that the price implies, with the value at it, which is the price inside the bounds."""
    m = fu.implied_growth(_valued(t))
    return m.where("implied_g is not null").select("symbol", "price", "implied_g", fu.dcf_value(c("implied_g"), c("wacc")).alias("value"))


@query("SELECT symbol, peg_value, epv, graham, graham_number FROM met5", FR)
def g11_valuation_models(t: Panels) -> DataFrame:
    return fu.valuation_models(_valued(t), RF).select("symbol", "peg_value", "epv", "graham", "graham_number")


@query(f"SELECT symbol, {_FAIR} AS fair_value, {_FAIR} / price - 1 AS upside FROM met5", FR)
def g12_fair_value(t: Panels) -> DataFrame:
    return fu.fair_value(fu.valuation_models(_valued(t), RF)).select("symbol", "fair_value", "upside")


_VS, _VW = _mean(
    [
        (0.3, _clip("(dcf / price - 1) / 0.4", -1, 1)), (0.25, f"CASE WHEN dcf IS NOT NULL THEN {_clip('(g1 - implied_g) / 0.1', -1, 1)} END"), (0.2, f"CASE WHEN peg > 0 THEN {_band('-peg', [(-1.0, 1), (-1.5, 0.5), (-2.5, 0.0), (-4.0, -0.5)], -1)} END"),
        (0.15, f"CASE WHEN NOT financial AND ev_ebitda > 0 THEN {_band('-ev_ebitda', [(-8, 1), (-12, 0.5), (-18, 0.0), (-25, -0.5)], -1)} END"), (0.4, f"CASE WHEN financial AND pb > 0 THEN {_clip('m_roe / 0.1 - pb', -1, 1)} END"),
    ]
)


# The panel has no free cash flow, so its yield takes no part.
@query(f"SELECT symbol, {_VS} AS value_score, CASE WHEN {_VS} IS NOT NULL THEN least(1, {_VW} / 0.8) END AS value_confidence FROM imp", FR)
def g13_valuation_score(t: Panels) -> DataFrame:
    m = fu.implied_growth(fu.valuation_models(_valued(t), RF))
    return fu.valuation_score(m, RF).select("symbol", "value_score", "value_confidence")


_FIELD = [("peg", "peg_value * 0.8", "peg_value", "peg_value * 1.2"), ("graham_number", *["graham_number"] * 3), ("dcf", *["dcf"] * 3), ("epv", *["epv"] * 3)]


@query(" UNION ALL ".join(f"SELECT symbol, '{n}' AS method, {a} AS low, {b} AS mid, {d} AS high FROM met5 WHERE {b} IS NOT NULL" for n, a, b, d in _FIELD), FR)
def g14_football_field(t: Panels) -> DataFrame:
    return fu.football_field(fu.valuation_models(_valued(t), RF))


CONS = """SELECT symbol, CAST(substring(symbol, 2) AS INT) % 15 AS analysts, CAST(1.5 + CAST(substring(symbol, 2) AS INT) % 7 / 3e0 AS DOUBLE) AS rec_mean, price * (0.9 + CAST(substring(symbol, 2) AS INT) % 5 / 1e1) AS target_mean, price,
  CAST(substring(symbol, 2) AS INT) % 6 AS up_0y, CAST(substring(symbol, 2) AS INT) % 4 AS down_0y, CAST(substring(symbol, 2) AS INT) % 3 AS up_1y, CAST(substring(symbol, 2) AS INT) % 5 AS down_1y, CAST(substring(symbol, 2) AS INT) % 8 AS up, CAST(substring(symbol, 2) AS INT) % 3 AS down FROM """
_REV, _ = _mean([(1, "CASE WHEN up_0y + down_0y > 0 THEN (up_0y - down_0y) / CAST(up_0y + down_0y AS DOUBLE) END"), (1, "CASE WHEN up_1y + down_1y > 0 THEN (up_1y - down_1y) / CAST(up_1y + down_1y AS DOUBLE) END")])
_CS, _CW = _mean([(0.25, f"CASE WHEN analysts > 0 THEN {_clip('2.6 - rec_mean', -1, 1)} END"), (0.25, _clip("(target_mean / price - 1 - 0.08) / 0.2", -1, 1)), (0.35, _REV), (0.15, "CASE WHEN up + down > 0 THEN (up - down) / CAST(up + down + 1 AS DOUBLE) END")])


@query(f"SELECT symbol, {_CS} AS score, least(1, analysts / 10.0) * least(1, {_CW} / 0.6) AS confidence FROM ({CONS}inf)", FR)
def g15_consensus(t: Panels) -> DataFrame:
    rows = t.spark.sql(CONS + "{inf}", inf=_info(fu.stmt_pivot(t.statements)))
    return fu.consensus(rows).select("symbol", "score", "confidence")


@query(" UNION ALL ".join(f"SELECT symbol, '{n}' AS name, CAST({n} AS DOUBLE) AS value FROM met1 WHERE {n} IS NOT NULL" for n in METRIC_NAMES), FR)
def g16_facts(t: Panels) -> DataFrame:
    return fu.facts(_metrics(t), METRIC_NAMES)


_RULES = {
    "buffett": ["CASE WHEN len(roe_hist) >= 3 THEN len(list_filter(roe_hist, lambda r: r >= 0.15)) / len(roe_hist) >= 0.8 ELSE m_roe >= 0.15 END", "op_margin >= 0.15", "CASE WHEN NOT financial THEN debt_to_equity < 0.5 END", "share_change <= 0.005", "dcf >= price * 1.1"],
    "graham": ["pe <= 15", "pe * pb <= 22.5", "CASE WHEN NOT financial THEN current_ratio >= 2 END", "CASE WHEN NOT financial THEN lt_debt_0 <= m_working END", "coalesce(dividend_yield, 0) > 0", "price <= graham_number"],
    "lynch": ["CASE WHEN peg > 0 THEN peg <= 1.2 END", "CASE WHEN NOT financial THEN debt_to_equity <= 0.8 END", "net_cash > 0"],
    "munger": ["CASE WHEN NOT financial THEN gross_margin >= 0.4 END", "rev_all_up", "capex_ratio <= 0.07", "sbc_ratio <= 0.05"],
    "wood": ["greatest(rev_growth_yoy, rev_cagr_3y) >= 0.2", "CASE WHEN NOT financial THEN gross_margin >= 0.5 END", "sector IN ('Technology', 'Communication Services', 'Healthcare')"],
    "druckenmiller": [],
}
FR["chk"] = " UNION ALL ".join(f"SELECT symbol, '{p}' AS persona, ({r}) AS passed FROM met5" for p, rs in _RULES.items() for r in rs)
FR["who"] = "SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in _RULES) + ") w(persona)"
FR["rsc"] = """SELECT m.symbol, w.persona, count(*) FILTER (k.passed) AS passed, count(k.passed) AS available, CASE WHEN count(k.passed) >= 3 THEN avg(CASE WHEN k.passed THEN 1.0 WHEN NOT k.passed THEN -1.0 END) END AS rule_score
  FROM (SELECT symbol FROM met1) m CROSS JOIN who w LEFT JOIN chk k ON k.symbol = m.symbol AND k.persona = w.persona GROUP BY 1, 2"""


def _checks(t: Panels) -> DataFrame:
    return fu.checklists(fu.valuation_models(_valued(t), RF), RF)


@query("SELECT symbol, persona, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM chk GROUP BY 1, 2", FR)
def n2_checklists(t: Panels) -> DataFrame:
    g = _checks(t).groupBy("symbol", "persona").agg(F.count_if(c("passed")).alias("passed"), F.count_if(~c("passed")).alias("failed"))
    return g.where("persona <> 'druckenmiller'")


@query("SELECT symbol, persona, rule_score FROM rsc", FR)
def n3_rule_scores(t: Panels) -> DataFrame:
    return fu.rule_scores(_checks(t)).select("symbol", "persona", "rule_score")


@query("SELECT symbol, persona, passed, available FROM rsc", FR)
def a21_checklist_counts(t: Panels) -> DataFrame:
    return fu.rule_scores(_checks(t)).select("symbol", "persona", "passed", "available")


@query("SELECT symbol, avg(rule_score) AS score, least(1, count(rule_score) / 6.0) AS confidence, array_to_string(list_sort(list(persona) FILTER (rule_score > 0.2)), ',') AS bulls, array_to_string(list_sort(list(persona) FILTER (rule_score < -0.2)), ',') AS bears FROM rsc GROUP BY 1 HAVING count(rule_score) > 0", FR)
def n4_panel(t: Panels) -> DataFrame:
    out = fu.panel(fu.rule_scores(_checks(t)))
    text = lambda x: F.nullif(F.array_join(x, ","), F.lit("")).alias(x)
    return out.select("symbol", "score", "confidence", text("bulls"), text("bears"))


@query(f"SELECT id, {normal_cdf('x')} AS cdf FROM (SELECT id, score * 8 AS x FROM runs)")
def f15_normal_cdf(t: Panels) -> DataFrame:
    from ..operators import validation as va

    return t.runs.select("id", va.normal_cdf(c("score") * 8).alias("cdf"))
