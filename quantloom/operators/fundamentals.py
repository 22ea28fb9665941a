"""Company quality and value, one row for each symbol, as column expressions over a pivoted statement table.

The long statement table (symbol, stmt, item, period_end, value) becomes one column for
each item and period index, `<item>_<i>` with i = 0 for the newest; missing figures are null
and every rule passes nulls on or leaves them out.  The edges, weights and coefficients of
the scores, models and checklists below are fixed values of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import band, clip, ratio, weighted
from ..sources.tables import with_period_index

PREMIUM, TERMINAL = 0.045, 0.025
# Statement items, the first that a company reports counts.
ITEMS = {
    "revenue": ("Total Revenue", "Operating Revenue"), "gross": ("Gross Profit",), "op_income": ("Operating Income",), "ebit": ("EBIT", "Operating Income"), "net_income": ("Net Income",),
    "eps": ("Diluted EPS", "Basic EPS"), "interest": ("Interest Expense", "Interest Expense Non Operating"), "tax": ("Tax Rate For Calcs",), "rd": ("Research And Development",),
    "assets": ("Total Assets",), "current_assets": ("Current Assets",), "current_liabilities": ("Current Liabilities",), "lt_debt": ("Long Term Debt", "Long Term Debt And Capital Lease Obligation"),
    "debt": ("Total Debt",), "equity": ("Stockholders Equity", "Common Stock Equity"), "retained": ("Retained Earnings",), "liabilities": ("Total Liabilities Net Minority Interest",),
    "shares": ("Ordinary Shares Number", "Share Issued"), "working": ("Working Capital",), "invested": ("Invested Capital",), "cash": ("Cash Cash Equivalents And Short Term Investments", "Cash And Cash Equivalents"),
    "cfo": ("Operating Cash Flow",), "capex": ("Capital Expenditure",), "fcf": ("Free Cash Flow",), "sbc": ("Stock Based Compensation",), "da": ("Depreciation And Amortization", "Depreciation Amortization Depletion"),
    "buyback": ("Repurchase Of Capital Stock",), "dividends": ("Cash Dividends Paid", "Common Stock Dividend Paid"), "wc_change": ("Change In Working Capital",),
}
SHOWN = 4  # newest periods that get columns of their own; `periods` holds all
INFO = ("sector", "market_cap", "ev", "price", "beta", "total_debt", "total_cash", "trailing_eps", "forward_eps", "book_value", "roe", "op_margin", "peg", "pe", "pb", "ev_ebitda", "dividend_rate")
c = F.col


def growth(statements: DataFrame, years: int) -> DataFrame:
    """(symbol, item, value, cagr<years>) from the newest period and the one `years` earlier; null unless both are positive."""
    rows = with_period_index(statements)
    keys = ["symbol", "stmt", "item"]
    now, then = rows.where("i = 0"), rows.where(c("i") == years).select(*keys, c("value").alias("old"))
    rate = F.when((c("value") > 0) & (c("old") > 0), F.pow(c("value") / c("old"), F.lit(1.0 / years)) - 1)
    return now.join(then, keys, "left").select("symbol", "item", "value", rate.alias(f"cagr{years}"))


def stmt_pivot(statements: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(symbol, <item>_<i> …, periods, years): the newest periods as columns and all as an array of structs from the
    newest; of the names of an item the first reported counts; years are the dates of the income statement."""
    pick = lambda name: F.max(F.when(c("item") == name, c("value")))
    by_period = with_period_index(statements).groupBy("symbol", "i").agg(*[F.coalesce(*map(pick, names)).alias(k) for k, names in ITEMS.items()], F.max(F.when(c("stmt") == "income", c("i"))).alias("income"))
    rows = by_period.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("i", *ITEMS))).alias("periods"), F.coalesce(F.max("income") + 1, F.lit(0)).alias("years"))
    # The dates of each statement are numbered without gaps, so period i stands at place i + 1.
    cells = [F.try_element_at("periods", F.lit(i + 1))[k].alias(f"{k}_{i}") for k in ITEMS for i in range(shown)]
    return rows.select("symbol", *cells, "periods", "years")


def _each(name: str, newest: int | None = None) -> Column:
    periods = c("periods") if newest is None else F.slice("periods", 1, newest)
    return F.filter(F.transform(periods, lambda p: p[name]), lambda x: x.isNotNull())


def _ratios(a: str, b: str) -> Column:
    """a / b of every period that has it, from the newest."""
    return F.filter(F.transform("periods", lambda p: ratio(p[a], p[b])), lambda x: x.isNotNull())


def _cagr(new: Column, old: Column, years: Column | int) -> Column:
    return F.when((new > 0) & (old > 0), F.pow(new / old, 1 / (F.lit(years) if isinstance(years, int) else years)) - 1)


def build_metrics(pivot: DataFrame, info: DataFrame) -> DataFrame:
    """Company figures from pivoted statements and info(symbol, INFO…); columns that info lacks are null."""
    kinds = {"sector": "string"}
    given = [c(k) if k in info.columns else F.lit(None).cast(kinds.get(k, "double")).alias(k) for k in INFO]
    m = pivot.join(info.select("symbol", *given), "symbol")
    last = F.least(F.lit(3), F.size(_each("revenue")) - 1)
    rev_old = F.element_at(_each("revenue"), F.greatest(last + 1, F.lit(1)))
    eps_last = F.least(F.lit(3), F.size(_each("eps")) - 1)
    margins = _ratios("op_income", "revenue")
    mean = F.aggregate(margins, F.lit(0.0), lambda a, x: a + x) / F.size(margins)
    tax = F.coalesce(clip(c("tax_0"), 0, 0.35), F.lit(0.21))
    steps = F.greatest(F.size(_each("revenue")) - 1, F.lit(0))
    ups = F.forall(F.zip_with(F.slice(_each("revenue"), 1, steps), F.slice(_each("revenue"), 2, steps), lambda a, b: a > b), lambda x: x)
    m = m.select(
        "*", (c("sector") == "Financial Services").alias("financial"), tax.alias("tax_rate"), F.coalesce("total_debt", "debt_0").alias("m_debt"), F.coalesce("total_cash", "cash_0").alias("m_cash"),
        F.coalesce("working_0", c("current_assets_0") - c("current_liabilities_0")).alias("m_working"), F.when(last >= 1, _cagr(c("revenue_0"), rev_old, last)).alias("rev_cagr_3y"),
        (ratio(c("revenue_0"), c("revenue_1")) - 1).alias("rev_growth_yoy"), F.when(F.size(_each("revenue")) >= 3, ups).alias("rev_all_up"),
        F.when(eps_last >= 1, _cagr(c("eps_0"), F.element_at(_each("eps"), F.greatest(eps_last + 1, F.lit(1))), eps_last)).alias("eps_cagr_3y"),
        F.when(F.size(_each("eps")) >= 2, F.forall(_each("eps"), lambda x: x > 0)).alias("eps_all_positive"),
        margins.alias("op_margin_hist"), F.when(F.size(margins) >= 3, F.sqrt(F.aggregate(margins, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(margins))).alias("op_margin_std"),
        ratio(c("gross_0"), c("revenue_0")).alias("gross_margin"), ratio(c("net_income_0"), c("revenue_0")).alias("net_margin"), ratio(c("net_income_0"), c("equity_0")).alias("roe_stmt"),
        _ratios("net_income", "equity").alias("roe_hist"),
        ratio(c("ebit_0") * (1 - tax), c("invested_0")).alias("roic"), ratio(c("ebit_0"), F.abs("interest_0")).alias("interest_coverage"), ratio(c("current_assets_0"), c("current_liabilities_0")).alias("current_ratio"),
        F.aggregate(_each("ebit", 3), F.lit(0.0), lambda a, x: a + x).alias("_ebits"), F.size(_each("ebit", 3)).alias("_n_ebit"), ratio(F.abs("capex_0"), c("revenue_0")).alias("capex_ratio"),
        ratio(c("sbc_0"), c("revenue_0")).alias("sbc_ratio"), ratio(c("rd_0"), c("revenue_0")).alias("rd_ratio"), ratio(c("fcf_0"), c("revenue_0")).alias("fcf_margin"), ratio(c("fcf_0"), c("market_cap")).alias("fcf_yield"),
        F.when(F.size(_each("fcf")) >= 2, F.forall(_each("fcf"), lambda x: x > 0)).alias("fcf_all_positive"), F.when(c("ev") > 0, ratio(c("ebit_0"), c("ev"))).alias("earnings_yield"),
        F.when(c("net_income_0") > 0, ratio(c("cfo_0"), c("net_income_0"))).alias("cfo_to_ni"), (ratio(c("shares_0"), c("shares_1")) - 1).alias("share_change"),
        (c("net_income_0") + c("da_0") - F.abs("capex_0") + F.coalesce("wc_change_0", F.lit(0.0))).alias("owner_earnings"), ratio(c("dividend_rate"), c("price")).alias("dividend_yield"),
    )
    m = m.withColumn("ebit_norm", F.when(c("_n_ebit") > 0, c("_ebits") / c("_n_ebit"))).drop("_ebits", "_n_ebit").withColumn("debt_to_equity", ratio(c("m_debt"), c("equity_0")))
    return m.withColumn("owner_yield", ratio(c("owner_earnings"), c("market_cap"))).withColumn("m_roe", F.coalesce("roe", "roe_stmt")).withColumn("net_cash", c("m_cash") - c("m_debt"))


def piotroski_checks() -> dict[str, Column]:
    """Nine nullable booleans."""
    base = lambda i: F.coalesce(c(f"assets_{i + 1}"), c(f"assets_{i}"))
    roa = lambda i: ratio(c(f"net_income_{i}"), base(i))
    lev = lambda i: ratio(F.coalesce(c(f"lt_debt_{i}"), F.lit(0.0)), c(f"assets_{i}"))
    current = lambda i: ratio(c(f"current_assets_{i}"), c(f"current_liabilities_{i}"))
    gross = lambda i: ratio(c(f"gross_{i}"), c(f"revenue_{i}"))
    turn = lambda i: ratio(c(f"revenue_{i}"), base(i))
    return {
        "roa_positive": roa(0) > 0, "cfo_positive": c("cfo_0") > 0, "roa_up": roa(0) > roa(1), "cash_beats_income": ratio(c("cfo_0"), base(0)) > roa(0),
        "leverage_down": F.when(lev(0) == 0, F.lit(True)).otherwise(lev(0) < lev(1)), "liquidity_up": current(0) > current(1), "no_dilution": c("shares_0") <= c("shares_1") * 1.005,
        "margin_up": gross(0) > gross(1), "turnover_up": turn(0) > turn(1),
    }


def piotroski(m: DataFrame) -> DataFrame:
    """m with f_score and f_max, null below six available checks or two years."""
    checks = F.array(*[x for x in piotroski_checks().values()])
    n, passed = F.size(F.filter(checks, lambda x: x.isNotNull())), F.size(F.filter(checks, lambda x: F.coalesce(x, F.lit(False))))
    ok = (n >= 6) & (c("years") >= 2)
    return m.withColumn("f_score", F.when(ok, passed)).withColumn("f_max", F.when(ok, n))


def altman_z(m: DataFrame) -> DataFrame:
    ok = ~F.coalesce("financial", F.lit(False)) & (c("assets_0") > 0) & (c("liabilities_0") > 0)
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    z = 1.2 * c("m_working") / c("assets_0") + 1.4 * zero("retained_0") / c("assets_0") + 3.3 * zero("ebit_0") / c("assets_0") + 0.6 * c("market_cap") / c("liabilities_0") + zero("revenue_0") / c("assets_0")
    return m.withColumn("z", F.when(ok, z))


def quality(m: DataFrame) -> DataFrame:
    """m(with f_score and z) with quality_score and quality_confidence: the mean of four groups' means."""
    plain = lambda x: F.when(~F.coalesce("financial", F.lit(False)), x)
    groups = [
        [band(c("m_roe"), [(0.2, 1), (0.12, 0.5), (0.0, -0.1)], -1), band(c("roic"), [(0.15, 1), (0.08, 0.4), (0.0, -0.3)], -1), band(c("op_margin"), [(0.2, 1), (0.1, 0.4), (0.0, -0.2)], -1)],
        [band(c("rev_cagr_3y"), [(0.15, 1), (0.05, 0.5), (0.0, -0.1)], -0.8), band(c("eps_cagr_3y"), [(0.15, 1), (0.05, 0.4), (0.0, -0.2)], -0.8)],
        [plain(band(-c("debt_to_equity"), [(-0.5, 1), (-1.0, 0.4), (-2.0, -0.3)], -0.8)), plain(band(c("interest_coverage"), [(10, 1), (4, 0.4), (1.5, -0.4)], -1)),
         plain(band(c("current_ratio"), [(1.5, 0.6), (1.0, 0.1)], -0.6)), F.when(c("z") > 2.99, 1.0).when(c("z") > 1.81, 0.0).when(c("z").isNotNull(), -1.0)],
        [band(c("fcf_margin"), [(0.15, 1), (0.05, 0.4), (0.0, -0.2)], -1), band(c("cfo_to_ni"), [(1.1, 0.6), (0.8, 0.1)], -0.6), (c("f_score") - c("f_max") / 2) / (c("f_max") / 2)],
    ]
    means = [weighted([(1.0, x) for x in g]) for g in groups]
    score, _ = weighted([(1.0, mean) for mean, _ in means])
    n = sum((count for _, count in means), F.lit(0.0))
    return m.withColumn("quality_score", score).withColumn("quality_confidence", F.when(score.isNotNull(), F.least(F.lit(1.0), n / 10)))


def plausible_growth(m: DataFrame, candidates: tuple[str, ...] = ("rev_cagr_3y", "eps_cagr_3y")) -> DataFrame:
    """m with g1: the median of the candidate growth rates, between -5 % and 30 %."""
    xs = F.array_sort(F.array_compact(F.array(*[c(x) for x in candidates])))
    n = F.size(xs)
    mid = (F.try_element_at(xs, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(xs, F.floor((n + 2) / 2).cast("int"))) / 2
    return m.withColumn("g1", clip(F.when(n > 0, mid), -0.05, 0.30))


def wacc(m: DataFrame, rf: float) -> DataFrame:
    """m with wacc, cost_of_equity and cost_of_debt."""
    b = F.coalesce(clip(c("beta"), 0.3, 3), F.lit(1.0)) * 0.67 + 0.33
    m = m.withColumn("cost_of_equity", rf + b * PREMIUM)
    debt, cap = F.coalesce("m_debt", F.lit(0.0)), F.coalesce("market_cap", F.lit(0.0))
    rd = F.when(c("interest_0").isNotNull() & (debt > 0), clip(F.try_divide(F.abs("interest_0"), debt), 0.02, 0.10)).otherwise(rf + 0.015)
    m = m.withColumn("cost_of_debt", rd)
    mixed = F.when(cap + debt > 0, F.try_divide(cap * c("cost_of_equity") + debt * c("cost_of_debt") * (1 - c("tax_rate")), cap + debt)).otherwise(c("cost_of_equity"))
    return m.withColumn("wacc", clip(mixed, 0.06, 0.15))


def fcff_base(m: DataFrame) -> DataFrame:
    """m with fcff0: two-year mean of operating cash plus interest after tax less investment and stock pay; null for financials."""
    one = lambda i: c(f"cfo_{i}") + F.abs(F.coalesce(c(f"interest_{i}"), F.lit(0.0))) * (1 - c("tax_rate")) - F.abs(c(f"capex_{i}")) - F.coalesce(c(f"sbc_{i}"), F.lit(0.0))
    mean, _ = weighted([(1.0, one(0)), (1.0, one(1))])
    return m.withColumn("fcff0", F.when(~F.coalesce("financial", F.lit(False)), mean))


def dcf_value(g1: Column, w: Column, terminal: float = TERMINAL) -> Column:
    """Value of a share: five years of g1, five of fading growth, a perpetuity; flows at mid-year."""

    def year(a: Column, t: Column) -> Column:
        g = F.when(t <= 5, g1).otherwise(g1 + (F.lit(terminal) - g1) * (t - 5) / 5)
        cash = a["f"] * (1 + g)
        return F.struct((a["pv"] + cash / F.pow(1 + w, t - 0.5)).alias("pv"), cash.alias("f"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.struct(F.lit(0.0).alias("pv"), c("fcff0").alias("f")), year)
    tail = out["f"] * (1 + terminal) / (w - terminal) / F.pow(1 + w, F.lit(10))
    return (out["pv"] + tail - F.coalesce("m_debt", F.lit(0.0)) + F.coalesce("m_cash", F.lit(0.0))) / c("shares_0")


def _can_discount() -> Column:
    return (c("fcff0") > 0) & (c("shares_0") > 0) & c("g1").isNotNull() & c("market_cap").isNotNull()


def dcf_grid(m: DataFrame) -> DataFrame:
    """(symbol, dw, dg, value): nine cells of discount rate and terminal growth."""
    cells = [F.struct(F.lit(dw).alias("dw"), F.lit(dg).alias("dg"), dcf_value(c("g1"), c("wacc") + dw, TERMINAL + dg).alias("value")) for dw in (-0.01, 0.0, 0.01) for dg in (-0.005, 0.0, 0.005)]
    return m.where(_can_discount()).select("symbol", F.explode(F.array(*cells)).alias("x")).select("symbol", "x.dw", "x.dg", "x.value")


def implied_growth(m: DataFrame, lo: float = -0.3, hi: float = 0.8, rounds: int = 60) -> DataFrame:
    """m with implied_g: the growth at which the value equals the price, by halving; the bound if it lies outside."""
    m = m.withColumn("_lo", dcf_value(F.lit(lo), c("wacc"))).withColumn("_hi", dcf_value(F.lit(hi), c("wacc")))

    def halve(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        low = dcf_value(mid, c("wacc")) < c("price")
        return F.struct(F.when(low, mid).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")), halve)
    value = F.when(c("_hi") < c("price"), F.lit(hi)).when(c("_lo") > c("price"), F.lit(lo)).otherwise((end["lo"] + end["hi"]) / 2)
    return m.withColumn("implied_g", F.when(_can_discount(), value)).drop("_lo", "_hi")


def valuation_models(m: DataFrame, rf: float) -> DataFrame:
    """m with dcf, peg_value, epv, graham and graham_number."""
    epv = (c("ebit_norm") * (1 - c("tax_rate")) / c("wacc") - F.coalesce("m_debt", F.lit(0.0)) + F.coalesce("m_cash", F.lit(0.0))) / c("shares_0")
    graham = c("trailing_eps") * (8.5 + 2 * clip(c("g1") * 100, 0, 10)) * 4.4 / ((rf + 0.008) * 100)
    plain = ~F.coalesce("financial", F.lit(False))
    return m.select(
        "*", F.when(_can_discount(), dcf_value(c("g1"), c("wacc"))).alias("dcf"), F.when((c("forward_eps") > 0) & (c("g1") >= 0.03), clip(c("g1") * 100, 8, 30) * c("forward_eps")).alias("peg_value"),
        F.when((c("ebit_norm") > 0) & plain, epv).alias("epv"), F.when((c("trailing_eps") > 0) & c("g1").isNotNull(), graham).alias("graham"),
        F.when((c("trailing_eps") > 0) & (c("book_value") > 0), F.sqrt(22.5 * c("trailing_eps") * c("book_value"))).alias("graham_number"),
    )


def fair_value(m: DataFrame) -> DataFrame:
    positive = lambda x: F.when(c(x) > 0, c(x))
    fair, _ = weighted([(0.5, positive("dcf")), (0.3, positive("peg_value")), (0.2, positive("graham"))])
    return m.withColumn("fair_value", fair).withColumn("upside", fair / c("price") - 1)


def valuation_score(m: DataFrame, rf: float) -> DataFrame:
    """m(with dcf and implied_g) with value_score and value_confidence."""
    fin = F.coalesce("financial", F.lit(False))
    parts = [
        (0.3, clip((c("dcf") / c("price") - 1) / 0.4, -1, 1)), (0.25, F.when(c("dcf").isNotNull(), clip((c("g1") - c("implied_g")) / 0.10, -1, 1))),
        (0.2, F.when(c("peg") > 0, band(-c("peg"), [(-1.0, 1), (-1.5, 0.5), (-2.5, 0.0), (-4.0, -0.5)], -1))), (0.1, F.when(~fin, band(c("fcf_yield") - rf, [(0.02, 1), (0.0, 0.5), (-0.02, 0.0), (-0.035, -0.5)], -1))),
        (0.15, F.when(~fin & (c("ev_ebitda") > 0), band(-c("ev_ebitda"), [(-8, 1), (-12, 0.5), (-18, 0.0), (-25, -0.5)], -1))), (0.4, F.when(fin & (c("pb") > 0), clip(c("m_roe") / 0.10 - c("pb"), -1, 1))),
    ]
    score, total = weighted(parts)
    return m.withColumn("value_score", score).withColumn("value_confidence", F.when(score.isNotNull(), F.least(F.lit(1.0), total / 0.8)))


def football_field(m: DataFrame) -> DataFrame:
    """(symbol, method, low, mid, high) of the models that apply."""
    row = lambda name, lo, mid, hi: F.when(mid.isNotNull(), F.struct(F.lit(name).alias("method"), lo.alias("low"), mid.alias("mid"), hi.alias("high")))
    rows = [row("peg", c("peg_value") * 0.8, c("peg_value"), c("peg_value") * 1.2), row("graham_number", c("graham_number"), c("graham_number"), c("graham_number")), row("dcf", c("dcf") * 1.0, c("dcf"), c("dcf") * 1.0), row("epv", c("epv"), c("epv"), c("epv"))]
    return m.select("symbol", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("symbol", "x.*")


def consensus(rows: DataFrame) -> DataFrame:
    """rows(symbol, analysts, rec_mean, target_mean, price, up_0y, down_0y, up_1y, down_1y, up, down) with score and confidence."""
    n = F.coalesce("analysts", F.lit(0))
    net = lambda k: F.when(c(f"up_{k}") + c(f"down_{k}") > 0, F.try_divide(c(f"up_{k}") - c(f"down_{k}"), c(f"up_{k}") + c(f"down_{k}")))
    revision, _ = weighted([(1.0, net("0y")), (1.0, net("1y"))])
    parts = [
        (0.25, F.when(n > 0, clip(2.6 - c("rec_mean"), -1, 1))), (0.25, F.when(c("price") > 0, clip((F.try_divide(c("target_mean"), c("price")) - 1 - 0.08) / 0.20, -1, 1))),
        (0.35, revision), (0.15, F.when(c("up") + c("down") > 0, (c("up") - c("down")) / (c("up") + c("down") + 1))),
    ]
    score, total = weighted(parts)
    return rows.withColumn("score", score).withColumn("confidence", F.when(score.isNotNull(), F.least(F.lit(1.0), n / 10) * F.least(F.lit(1.0), total / 0.6)))


def facts(m: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, name, value) of the named figures that are present."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), c(n).cast("double").alias("value")) for n in names])
    return m.select("symbol", F.explode(cells).alias("x")).select("symbol", "x.name", "x.value").where("value is not null")


def checklists(m: DataFrame, rf: float) -> DataFrame:
    """(symbol, persona, rule, passed): nullable rules of six investors over figures, models, trend and plan columns where m has them."""
    have = lambda x, kind="double": c(x) if x in m.columns else F.lit(None).cast(kind)
    plain = lambda x: F.when(~F.coalesce("financial", F.lit(False)), x)
    share = F.when(F.size("roe_hist") >= 3, F.size(F.filter("roe_hist", lambda r: r >= 0.15)) / F.size("roe_hist") >= 0.8).otherwise(c("m_roe") >= 0.15)
    rules = {
        "buffett": {"steady_roe": share, "margin": (c("op_margin") >= 0.15) & (F.coalesce("op_margin_std", F.lit(0.0)) <= 0.05), "low_debt": plain(c("debt_to_equity") < 0.5), "cash_each_year": c("fcf_all_positive"),
                    "no_dilution": c("share_change") <= 0.005, "owner_yield": c("owner_yield") >= rf, "below_value": have("dcf") >= c("price") * 1.1},
        "graham": {"pe": c("pe") <= 15, "pe_pb": c("pe") * c("pb") <= 22.5, "liquid": plain(c("current_ratio") >= 2), "debt_covered": plain(c("lt_debt_0") <= c("m_working")), "earnings": c("eps_all_positive"),
                   "dividend": F.coalesce("dividend_yield", F.lit(0.0)) > 0, "below_number": c("price") <= have("graham_number")},
        "lynch": {"peg": F.when(c("peg") > 0, c("peg") <= 1.2), "growth": c("eps_cagr_3y").between(0.10, 0.40), "debt": plain(c("debt_to_equity") <= 0.8), "net_cash": c("net_cash") > 0,
                  "pe_below_growth": c("pe") < c("eps_cagr_3y") * 100 + F.coalesce("dividend_yield", F.lit(0.0)) * 100},
        "munger": {"roic": c("roic") >= 0.15, "pricing": plain(c("gross_margin") >= 0.40), "sales_rise": c("rev_all_up"), "light": c("capex_ratio") <= 0.07, "stock_pay": c("sbc_ratio") <= 0.05,
                   "fcf_yield": plain(c("fcf_yield") >= 0.03), "steady": c("op_margin_std") <= 0.05},
        "wood": {"sales": F.greatest("rev_growth_yoy", "rev_cagr_3y") >= 0.20, "research": c("rd_ratio") >= 0.10, "margin": plain(c("gross_margin") >= 0.5),
                 "margin_up": F.when(F.size("op_margin_hist") >= 2, c("op_margin_hist")[0] > c("op_margin_hist")[1]), "eps_growth": have("eps_growth_fwd") >= 0.15,
                 "sector": F.coalesce(c("sector").isin("Technology", "Communication Services", "Healthcare"), F.lit(False))},
        "druckenmiller": {"trend": F.when(have("above_200", "boolean").isNotNull(), have("above_200", "boolean") & (F.coalesce(have("ret_6m"), F.lit(0.0)) > 0)), "strength": have("rel_strength_6m") > 0, "revisions": have("eps_revision_net") > 0,
                          "market": have("market_above_200", "boolean"), "odds": have("p_target_first") >= have("p_stop_first")},
    }
    cells = [F.struct(F.lit(p).alias("persona"), F.lit(r).alias("rule"), x.cast("boolean").alias("passed")) for p, rs in rules.items() for r, x in rs.items()]
    return m.select("symbol", F.explode(F.array(*cells)).alias("x")).select("symbol", "x.*")


def rule_scores(checks: DataFrame) -> DataFrame:
    """(symbol, persona, passed, available, rule_score): mean of ±1 over known rules, null below three."""
    g = checks.groupBy("symbol", "persona").agg(F.count_if(c("passed")).alias("passed"), F.count("passed").alias("available"), F.avg(F.when(c("passed"), 1.0).when(~c("passed"), -1.0)).alias("_s"))
    return g.withColumn("rule_score", F.when(c("available") >= 3, c("_s"))).drop("_s")


def panel(scores: DataFrame, opinions: DataFrame | None = None) -> DataFrame:
    """(symbol, score, confidence, bulls, bears): mean of the personas' scores, half each of rules and opinion where both exist."""
    if opinions is not None:
        scores = scores.join(opinions, ["symbol", "persona"], "left")
        value, _ = weighted([(0.5, c("rule_score")), (0.5, c("opinion"))])
    else:
        value = c("rule_score")
    rows = scores.withColumn("_s", value)
    g = rows.groupBy("symbol").agg(
        F.avg("_s").alias("score"), F.count("_s").alias("_n"), F.array_sort(F.collect_list(F.when(c("_s") > 0.2, c("persona")))).alias("bulls"), F.array_sort(F.collect_list(F.when(c("_s") < -0.2, c("persona")))).alias("bears")
    )
    return g.where("_n > 0").select("symbol", "score", F.least(F.lit(1.0), c("_n") / 6).alias("confidence"), "bulls", "bears")
