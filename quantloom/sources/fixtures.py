"""Panels derived from the star-schema tables, as SQL that Spark and DuckDB both run.

A symbol is a return flag, a line status and a band of 100 suppliers, so that symbols
grow with the tables while the bars of each keep their number; runs (1,500 customers) and
news (1,000 documents) have like bands, and the first band has no number.  Prices are a
bounded random walk made from discounts and taxes.  Each text is written once and
rendered for either engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_KEY = "l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice"
_SIX = "CASE {x} % 6 WHEN 0 THEN 'AF' WHEN 1 THEN 'AO' WHEN 2 THEN 'NF' WHEN 3 THEN 'NO' WHEN 4 THEN 'RF' ELSE 'RO' END"
_BAND = "CASE WHEN {x} >= {n} THEN concat('', CAST(floor({x} / {n}) AS INT)) ELSE '' END"
#: Share of the day's first discount in each sector fund's return, the rest is that of the last.
_FUNDS = {"XLK": 1.0, "XLE": 0.0, "XLF": 0.1, "XLV": 0.2, "XLY": 0.3, "XLP": 0.4, "XLI": 0.5, "XLB": 0.6, "XLU": 0.7, "XLRE": 0.8, "XLC": 0.9}
_SECTORS = ["Technology", "Energy", "Financial Services", "Healthcare", "Consumer Cyclical", "Consumer Defensive", "Industrials", "Basic Materials", "Utilities", "Real Estate", "Communication Services"]
_STATEMENTS = (
    ("income", "Total Revenue", "e"), ("income", "Gross Profit", "0.5 * e - ed"), ("income", "EBIT", "0.25 * e - ed"),
    ("income", "Net Income", "0.2 * e - ed"), ("income", "Interest Expense", "0.1 * et"),
    ("balance", "Total Assets", "2 * e"), ("balance", "Current Assets", "0.8 * e"), ("balance", "Current Liabilities", "0.4 * e + et"),
    ("balance", "Long Term Debt", "0.3 * e + ed"), ("balance", "Total Liabilities Net Minority Interest", "0.9 * e"),
    ("balance", "Stockholders Equity", "1.1 * e"), ("balance", "Retained Earnings", "0.6 * e"), ("balance", "Ordinary Shares Number", "1000 + q"),
    ("cashflow", "Operating Cash Flow", "0.25 * e - et"), ("cashflow", "Capital Expenditure", "-et"), ("cashflow", "Stock Based Compensation", "0.02 * e"),
)
_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

PANELS = {
    "bars": f"""
WITH day AS (
  <BARS>),
r AS (SELECT *, CAST(0.3 * ((d0 + d1) / 2 - 0.05) AS DOUBLE) AS ret, CAST(0.1 * (x1 - 0.04) AS DOUBLE) AS gap FROM day),
c AS (SELECT *, round(100 * exp(sum(ret) OVER (PARTITION BY symbol ORDER BY date {_RUN})), 6) AS close FROM r),
o AS (SELECT *, round(coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), CAST(100 AS DOUBLE)) * exp(gap), 6) AS open FROM c)
SELECT symbol, date, open, round(greatest(open, close) * (1 + q1 / 5000), 6) AS high,
       round(least(open, close) * (1 - q1 / 5000), 6) AS low, close, volume FROM o""",
    "series": f"""
WITH d AS (<DAYS>),
i AS (SELECT date, ad, tx, round(100 * exp(sum(CAST(0.2 * ((d0 + d1) / 2 - 0.05) AS DOUBLE)) OVER (ORDER BY date {_RUN})), 6) AS idx,
  {", ".join(f"round({50 + 3 * k} * exp(sum(CAST(0.2 * ({w} * d0 + {round(1 - w, 1)} * d1 - 0.05) AS DOUBLE)) OVER (ORDER BY date {_RUN})), 6) AS {f.lower()}" for k, (f, w) in enumerate(_FUNDS.items()))} FROM d),
k AS (SELECT *, unnest_ids AS series_id FROM i CROSS JOIN (<ROWS:'INDEX','VOL','Y10','Y13W',{",".join(f"'{f}'" for f in _FUNDS)}>) AS n(unnest_ids))
SELECT series_id, date, CASE series_id WHEN 'INDEX' THEN idx WHEN 'VOL' THEN round(10 + 250 * ad, 6) WHEN 'Y10' THEN round(100 * tx, 6) WHEN 'Y13W' THEN round(75 * tx, 6) {" ".join(f"WHEN '{f}' THEN {f.lower()}" for f in _FUNDS)} END AS value FROM k""",
    "sectors": f"""
WITH s AS (SELECT concat(l_returnflag, l_linestatus, {_BAND.format(x="l_suppkey", n=100)}) AS symbol, CAST(min(floor(l_suppkey / 100)) AS INT) + ascii(min(l_returnflag)) + 3 * ascii(min(l_linestatus)) AS h FROM lineitem GROUP BY 1)
SELECT symbol, CAST(<DAY:DATE '1993-06-01':CAST(n * (700 + 13 * (h % 7)) AS INT)> AS DATE) AS since,
  CASE (h + 5 * n) % 11 {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SECTORS))} END AS sector
FROM s CROSS JOIN (<ROWS:0,1,2>) AS t(n)""",
    "statements": """
WITH a AS (SELECT concat('S', l_suppkey) AS symbol, year(l_shipdate) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS e,
  CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS ed, CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS et, sum(l_quantity) AS q
  FROM lineitem GROUP BY 1, 2)
SELECT symbol, stmt, item, period_end, value FROM (<STATEMENTS>) AS t""",
    "news": f"""
SELECT d.doc_id AS id, concat({_SIX.format(x="d.doc_id")}, {_BAND.format(x="d.doc_id", n=1000)}) AS symbol, replace(d.text, chr(10), ' ') AS title, d.source AS source,
  CAST(<DAY:DATE '2001-10-01':CAST(d.doc_id % 30 AS INT)> AS DATE) AS published,
  CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(0.5 + 0.5 * l.quality AS DOUBLE) END AS relevance,
  CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(0.6 * l.quality - 1.2 * l.toxic AS DOUBLE) END AS sentiment,
  CASE d.doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS impact,
  CASE d.doc_id % 5 WHEN 0 THEN 'earnings' WHEN 1 THEN 'legal' WHEN 2 THEN 'product' WHEN 3 THEN 'price_move' ELSE 'other' END AS event
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # Snapshots as JSON: nested, with fields that are missing, null or of a wrong type, and payloads that are no JSON.
    "snapshots": """
WITH n AS (SELECT c_custkey AS id, CAST(c_custkey % 9 AS STRING) AS a, CAST(c_custkey % 5 AS STRING) AS b, CAST(c_custkey % 20 + 10 AS STRING) AS d, CAST(c_custkey % 1000 AS STRING) AS e FROM customer)
SELECT id, CASE WHEN id % 29 = 0 THEN '{"info":' WHEN id % 23 = 0 THEN '[1,2]' ELSE concat('{"info":{"sector":', CASE WHEN id % 4 = 0 THEN 'null' ELSE concat('"s', a, '"') END, ',"beta":', CASE WHEN id % 6 = 0 THEN '"high"' ELSE concat('1.', a) END,
  CASE WHEN id % 7 = 0 THEN '' ELSE concat(',"currentPrice":', d, '.5') END, ',"sharesOutstanding":', e, ',"other":{"x":[', a, ',', b, ']}},"analyst":',
  CASE WHEN id % 11 = 0 THEN 'null}' ELSE concat('{"targets":', CASE WHEN id % 8 = 0 THEN '[]' ELSE concat('{"mean":', d, ',"high":', CASE WHEN id % 3 = 0 THEN 'null' ELSE concat(d, '.25') END, '}') END,
    ',"updown":{"up":', a, ',"down":', b, '},"eps_revisions":{"0q":{"up":', a, ',"down":', b, '},"+1y":{"up":', b, CASE WHEN id % 2 = 0 THEN '}' ELSE concat(',"down":', a, '}') END, '},"growth":{"0y":0.', a, ',"+1y":-0.', b, '},"calendar":',
    CASE WHEN id % 13 = 0 THEN '["soon"]' ELSE concat('["2001-07-', d, '"]') END, '}}') END) END AS payload FROM n""",
    # Results of runs as JSON: two known modules and one that the engine has not, with holes, and analogs by horizon.
    "results": """
WITH v AS (SELECT o_orderkey AS id, concat(CAST(CAST((o_orderkey * 7 % 201 - 100) / 100.0 AS DECIMAL(6,2)) AS STRING), '') AS a, concat(CAST(CAST((o_orderkey * 11 % 201 - 100) / 100.0 AS DECIMAL(6,2)) AS STRING), '') AS b,
  concat(CAST(CAST((o_orderkey * 13 % 201 - 100) / 100.0 AS DECIMAL(6,2)) AS STRING), '') AS d, concat(CAST(CAST(o_orderkey % 100 / 100.0 AS DECIMAL(6,2)) AS STRING), '') AS k FROM orders)
SELECT id, CASE WHEN id % 17 = 0 THEN 'not json' ELSE concat('{"modules":[{"key":"technical","available":', CASE WHEN id % 5 = 0 THEN 'false' ELSE 'true' END, ',"score":', a, ',"confidence":', k, ',"note":{"deep":[1,2]}}',
  CASE WHEN id % 3 = 0 THEN '' ELSE concat(',{"key":"sentiment","available":true,"score":', b, ',"confidence":0.5}') END, ',{"key":"mood","available":true,"score":', CASE WHEN id % 7 = 0 THEN 'null' ELSE d END, ',"confidence":', k,
  '},{"key":"analogs","available":true,"score":1,"confidence":1}],"analogs":{"short":{"available":true,"score":', d, ',"confidence":0.25},"mid":{"available":', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END, ',"score":', b, ',"confidence":1}}}') END AS result FROM v""",
    "runs": f"""
SELECT o_orderkey AS id, concat({_SIX.format(x="o_custkey")}, {_BAND.format(x="o_custkey", n=1500)}) AS symbol, CAST(o_orderdate AS DATE) AS created,
  CASE o_orderkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' ELSE 'long' END AS horizon,
  CASE o_orderstatus WHEN 'F' THEN 'buy' WHEN 'O' THEN 'sell' ELSE 'hold' END AS verdict,
  CAST(o_totalprice / 250000.0 - 1 AS DOUBLE) AS score, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence FROM orders""",
}
BASE_TABLES = ("lineitem", "orders", "customer", "documents", "labels", "events")


def _statements(spark: bool) -> str:
    """One row for each item of a symbol and year: stacked in one pass, or a union of selects."""
    end = "make_date(CAST(y AS INT), 12, 31) AS period_end"
    if spark:
        return f"SELECT symbol, {end}, stack({len(_STATEMENTS)}, {', '.join(f"'{s}', '{i}', CAST({v} AS DOUBLE)" for s, i, v in _STATEMENTS)}) AS (stmt, item, value) FROM a"
    return " UNION ALL ".join(f"SELECT symbol, '{s}' AS stmt, '{i}' AS item, {end}, CAST({v} AS DOUBLE) AS value FROM a" for s, i, v in _STATEMENTS)


def _symbol_days(spark: bool) -> str:
    """A row for each symbol and day. Spark sorts rows for a least or greatest struct, and few of them share a symbol and day, so rows are dealt out first and sorted
    once, by a number before the text: its comparisons need not look into the rows."""
    keys = f"""concat(l_returnflag, l_linestatus, {_BAND.format(x="l_suppkey", n=100)}) AS symbol, CAST(l_shipdate AS DATE) AS date"""
    ends = """min_by(l_discount, <K>) AS d0, max_by(l_discount, <K>) AS d1, max_by(l_tax, <K>) AS x1,
         max_by(l_quantity, <K>) AS q1, sum(l_quantity) AS volume"""
    if not spark:
        return f"SELECT {keys},\n         {ends}\n  FROM lineitem GROUP BY 1, 2"
    return f"""SELECT symbol, date, {ends} FROM (SELECT /*+ REPARTITION(symbol, date) */ *, xxhash64(symbol, date) AS place FROM (SELECT {keys}, {_KEY}, l_discount, l_tax FROM lineitem))
  GROUP BY place, symbol, date"""


#: A number to four places as a whole number of the last one. Spark makes decimals from text; only numbers near the middle between two need that.
_SCALED = "CASE WHEN abs({x}) < 1e9 AND abs({x} * 1e4 - rint({x} * 1e4)) < 0.4 THEN CAST(rint({x} * 1e4) AS BIGINT) ELSE CAST(CAST({x} AS DECIMAL(18,4)) * 10000 AS BIGINT) END"


def _days(spark: bool) -> str:
    """A row for each day: the discounts of its first and last row by key, and two means. Spark keeps groups of numbers in a hash table but sorts all rows
    for a least or greatest struct, so only rows of the least and greatest order of their day (or of none) are compared by it."""
    date, ends = "CAST(l_shipdate AS DATE) AS date", "min_by(l_discount, <K>) AS d0, max_by(l_discount, <K>) AS d1"
    means = "CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS ad, CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS tx"
    if spark:
        means = re.sub(r"sum\(CAST\((\w+) AS DECIMAL\(18,4\)\)\)", lambda m: f"sum({_SCALED.format(x=m.group(1))}) * 0.0001", means)
    if not spark:
        return f"SELECT {date}, {ends},\n           {means} FROM lineitem GROUP BY 1"
    return f"""SELECT /*+ BROADCAST(b) */ l.date, {ends}, any_value(b.ad) AS ad, any_value(b.tx) AS tx FROM (SELECT *, {date} FROM lineitem) l
  JOIN (SELECT {date}, min(l_orderkey) AS lo, max(l_orderkey) AS hi, {means} FROM lineitem GROUP BY 1) b ON l.date <=> b.date AND (l_orderkey IS NULL OR l_orderkey = lo OR l_orderkey = hi) GROUP BY 1"""


def _ends(text: str) -> str:
    """min_by and max_by of the rows' key as fields of one least and one greatest row: Spark keeps and compares two structs a group instead of one for each column."""
    for kind in ("min", "max"):
        found = dict.fromkeys(re.findall(rf"{kind}_by\((\w+), <K>\)", text))
        row = f"{kind}(struct({', '.join([_KEY, *(f'{x} AS _{x}' for x in found)])}))"
        text = re.sub(rf"{kind}_by\((\w+), <K>\)", lambda m, row=row: f"{row}._{m.group(1)}", text)
    return text


def render(text: str, spark: bool) -> str:
    text = text.replace("<STATEMENTS>", _statements(spark)).replace("<DAYS>", _days(spark)).replace("<BARS>", _symbol_days(spark))
    # The least text has the least first character; Spark sorts all rows for a least text, not for a least number.
    text = re.sub(r"ascii\(min\((\w+)\)\)", r"min(ascii(\1))", text) if spark else text
    text = _ends(text) if spark else text
    text = text.replace("<K>", f"struct({_KEY})" if spark else f"({_KEY})")
    text = re.sub(r"<ROWS:([^>]*)>", lambda m: "VALUES " + ", ".join(f"({x})" for x in m.group(1).split(",")), text)
    return re.sub(r"<DAY:([^:>]*):([^>]*)>", r"date_add(\1, \2)" if spark else r"(\1 + \2)", text)


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of PANELS over the Parquet tables in sf_dir."""
    text = render(PANELS[name], True).replace("{", "{{").replace("}", "}}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES if f" {t}" in text}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **tables)
