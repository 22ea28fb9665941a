"""SQL fragments that the oracle queries share."""

from __future__ import annotations

import math

ORDER = "PARTITION BY symbol ORDER BY date"


def frame(n: int, end: str = "CURRENT ROW", part: str = ORDER) -> str:
    return f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND {end})"


UP = f"OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
OVER = f"OVER ({ORDER})"


def sma(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {frame(n)} = {n} THEN avg({c}) {frame(n)} END"


def fold(x: str, alpha: float, need: int) -> str:
    """Recursive smoothing over a frame so long that what lies before it weighs under 1e-17."""
    span = math.ceil(math.log(1e-17) / math.log(1 - alpha))
    values = f"list({x}) FILTER ({x} IS NOT NULL) {frame(span)}"
    return f"CASE WHEN count({x}) {UP} >= {need} THEN list_reduce({values}, lambda a, b: a * (1 - {alpha!r}) + b * {alpha!r}) END"


def ema(x: str, n: int) -> str:
    return fold(x, 2 / (n + 1), n)


def wilder(x: str, n: int) -> str:
    return fold(x, 1 / n, n)


def _rsi(n: int) -> str:
    return f"CASE WHEN g{n} IS NULL THEN NULL WHEN l{n} = 0 THEN 100.0 ELSE 100 - 100 / (1 + g{n} / l{n}) END AS rsi{n}"


def normal_cdf(x: str) -> str:
    """The published rational approximation of the normal distribution, its factors written out here again."""
    z = f"abs({x})"
    top, bottom = "0.0352624965998911", "0.0883883476483184"
    for f in ("0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376"):
        top = f"({top} * {z} + {f})"
    for f in ("1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752"):
        bottom = f"({bottom} * {z} + {f})"
    far = f"({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65)))))"
    tail = f"CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 THEN exp(-{z} * {z} / 2) * {top} / {bottom} ELSE exp(-{z} * {z} / 2) / ({far} * sqrt(2 * pi())) END"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END"


FRAGMENTS = {
    "moves": f"""SELECT *, row_number() {OVER} - 1 AS i, lag(close) {OVER} AS pc, lag(high) {OVER} AS ph, lag(low) {OVER} AS pl FROM bars""",
    "moved": """SELECT *, close - pc AS d, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
      CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END AS obv_step,
      CASE WHEN close - pc > 0 THEN close - pc WHEN pc IS NOT NULL THEN 0 END AS gain,
      CASE WHEN close - pc < 0 THEN pc - close WHEN pc IS NOT NULL THEN 0 END AS loss,
      CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS plus_dm,
      CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS minus_dm FROM moves""",
    "smooth1": f"""SELECT *, {ema("close", 12)} AS e12, {ema("close", 26)} AS e26, {ema("close", 8)} AS e8, {ema("close", 17)} AS e17,
      {ema("close", 5)} AS e5, {ema("close", 35)} AS e35, {wilder("close", 14)} AS w14, {wilder("gain", 14)} AS g14, {wilder("loss", 14)} AS l14,
      {wilder("gain", 2)} AS g2, {wilder("loss", 2)} AS l2, {wilder("tr", 14)} AS atr14, {wilder("plus_dm", 14)} AS pdm, {wilder("minus_dm", 14)} AS mdm,
      sum(obv_step) {UP} AS obv FROM moved""",
    "smooth2": f"""SELECT *, {_rsi(14)}, {_rsi(2)}, e12 - e26 AS m12, e8 - e17 AS m8, e5 - e35 AS m5,
      CASE WHEN pdm + mdm <> 0 THEN 100 * abs(100 * pdm / atr14 - 100 * mdm / atr14) / (100 * pdm / atr14 + 100 * mdm / atr14) END AS dx FROM smooth1""",
    "ind": f"""SELECT *, {ema("m12", 9)} AS s12, {ema("m8", 12)} AS s8, {ema("m5", 5)} AS s5, {wilder("dx", 14)} AS adx14 FROM smooth2""",
    "sig0": f"""SELECT *, {", ".join(f"{sma('close', n)} AS sma{n}" for n in (3, 5, 10, 15, 20, 50, 100, 150, 200))},
      CASE WHEN count(close) {frame(20)} = 20 THEN stddev_pop(close) {frame(20)} END AS sd20,
      {", ".join(f"{sma('obv', n)} AS obv_sma{n}" for n in (10, 20, 50))},
      {", ".join(f"CASE WHEN count(high) OVER ({ORDER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN max(high) OVER ({ORDER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS high{n}" for n in (20, 55))},
      {", ".join(f"CASE WHEN count(low) OVER ({ORDER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN min(low) OVER ({ORDER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS low{n}" for n in (10, 20))},
      {", ".join(f"close / lag(close, {n}) {OVER} - 1 AS mom{n}" for n in (63, 126, 252))},
      lag(high - low) {OVER} AS range1, lag(rsi14) {OVER} AS prsi FROM ind""",
    "sig1": f"""SELECT *, sma20 + 2.0 * sd20 AS up20, sma20 - 2.0 * sd20 AS lo20, sma20 + 2.5 * sd20 AS up25, sma20 - 2.5 * sd20 AS lo25,
      lag(sma20 + 2.0 * sd20) {OVER} AS pup20, lag(sma20 - 2.0 * sd20) {OVER} AS plo20, lag(sma20 + 2.5 * sd20) {OVER} AS pup25, lag(sma20 - 2.5 * sd20) {OVER} AS plo25 FROM sig0""",
}


def _yes(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


def _hold(entry: str, exit_: str) -> str:
    event = f"CASE WHEN {exit_} THEN 0.0 WHEN {entry} THEN 1.0 END"
    return f"coalesce(last_value({event} IGNORE NULLS) {UP}, 0.0)"


_POSITIONS = {
    **{f"sma_cross_{k}": _yes(f"sma{a} > sma{b}") for k, (a, b) in enumerate(((3, 15), (10, 50), (20, 100), (50, 200)))},
    **{f"macd_{k}": _yes(f"m{a} > s{a}") for k, a in enumerate((8, 12, 5))},
    **{f"rsi_cross_{k}": _hold(f"rsi14 > {a} AND prsi <= {a}", f"rsi14 < {b} AND prsi >= {b}") for k, (a, b) in enumerate(((45, 65), (30, 70)))},
    **{f"bollinger_{k}": _hold(f"close > lo{a} AND pc < plo{a}", f"close < up{a} AND pc > pup{a}") for k, a in enumerate((20, 25))},
    **{f"obv_{k}": _yes(f"obv > obv_sma{n}") for k, n in enumerate((10, 20, 50))},
    **{f"donchian_{k}": _hold(f"close > high{a}", f"close < low{b}") for k, (a, b) in enumerate(((20, 10), (55, 20)))},
    **{f"ts_momentum_{k}": _yes(f"mom{n} > 0") for k, n in enumerate((63, 126, 252))},
    **{f"trend_filter_{k}": _yes(f"close > sma{n}") for k, n in enumerate((100, 150, 200))},
    **{f"rsi2_{k}": _hold(f"rsi2 < {th} AND close > sma200", "close > sma5") for k, th in enumerate((5, 10, 20))},
}
_VOTES = "sma_cross_0 + macd_0 + rsi_cross_0 + bollinger_0 + obv_0"
FRAGMENTS["sig2"] = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _POSITIONS.items()) + " FROM sig1"
FRAGMENTS["sig"] = f"SELECT *, {_yes(f'{_VOTES} >= 3')} AS combined_0, {_yes(f'{_VOTES} >= 4')} AS combined_1 FROM sig2"
POSITION_NAMES = [*_POSITIONS, "combined_0", "combined_1"]
FRAGMENTS["pos"] = " UNION ALL ".join(
    f"SELECT symbol, date, open, high, low, close, i, '{n.rsplit('_', 1)[0]}' AS strategy, {n.rsplit('_', 1)[1]} AS variant, {n} AS pos FROM sig" for n in POSITION_NAMES
)
_KEYED = "PARTITION BY symbol, strategy, variant ORDER BY date"
FRAGMENTS["held0"] = f"SELECT *, coalesce(lag(pos) OVER ({_KEYED}), 0.0) AS held, coalesce(lag(pos, 2) OVER ({_KEYED}), 0.0) AS gap_held, lag(close) OVER ({_KEYED}) AS pclose FROM pos"
FRAGMENTS["held1"] = f"SELECT *, coalesce(lag(held) OVER ({_KEYED}), 0.0) AS was FROM held0"
FRAGMENTS["pos_ret"] = """SELECT symbol, date, strategy, variant, i, open, close, held, CASE WHEN pclose IS NULL THEN 0.0 ELSE
      (1 + gap_held * (open / pclose - 1)) * (1 + held * (close / open - 1)) - 1 - 0.0005 * abs(held - was) + (1 - held) * 0.0001 END AS ret FROM held1"""
FRAGMENTS["brk0"] = " UNION ALL ".join(
    f"SELECT symbol, date, i, open, high, low, close, 'vol_breakout' AS strategy, {k} AS variant, open + {x} * range1 AS level FROM sig0" for k, x in enumerate((0.4, 0.5, 0.6))
)
FRAGMENTS["brk1"] = f"SELECT *, (high >= level AND lead(open) OVER ({_KEYED}) IS NOT NULL) IS TRUE AS hit, lead(open) OVER ({_KEYED}) AS next_open, lead(date) OVER ({_KEYED}) AS next_date, lag(close) OVER ({_KEYED}) AS pclose FROM brk0"
FRAGMENTS["brk_ret"] = f"""SELECT symbol, date, strategy, variant, i, open, close, CASE WHEN hit THEN 1.0 ELSE 0.0 END AS held, CASE WHEN pclose IS NULL THEN 0.0 ELSE
      (1 + CASE WHEN lag(hit) OVER ({_KEYED}) THEN open * (1 - 0.0005) / pclose - 1 ELSE 0 END) * (1 + CASE WHEN hit THEN close / (greatest(level, open) * (1 + 0.0005)) - 1 ELSE 0 END)
      - 1 + CASE WHEN hit THEN 0 ELSE 0.0001 END END AS ret FROM brk1"""
FRAGMENTS["all_ret"] = "SELECT symbol, date, strategy, variant, i, open, close, held, ret FROM pos_ret UNION ALL SELECT symbol, date, strategy, variant, i, open, close, held, ret FROM brk_ret"
FRAGMENTS["isl0"] = f"SELECT *, sum(CASE WHEN held > 0 AND was = 0 THEN 1 ELSE 0 END) OVER ({_KEYED} ROWS UNBOUNDED PRECEDING) AS island, lead(open) OVER ({_KEYED}) AS next_open, lead(date) OVER ({_KEYED}) AS next_date FROM held1"
FRAGMENTS["pos_trades"] = """SELECT a.symbol, a.strategy, a.variant, a.entry, coalesce(z.next_date, a.last) AS exit, a.entry_px, coalesce(z.next_open, z.close) AS exit_px, a.days, z.next_date IS NULL AS is_open
      FROM (SELECT symbol, strategy, variant, island, min(date) AS entry, max(date) AS last, min_by(open, date) AS entry_px, count(*) AS days FROM isl0 WHERE held > 0 GROUP BY 1, 2, 3, 4) a
      JOIN isl0 z ON z.symbol = a.symbol AND z.strategy = a.strategy AND z.variant = a.variant AND z.date = a.last"""
FRAGMENTS["trades"] = """SELECT *, exit_px * (1 - 0.0005) / (entry_px * (1 + 0.0005)) - 1 AS ret FROM pos_trades
      UNION ALL SELECT symbol, strategy, variant, date, next_date, greatest(level, open), next_open, 1, false, next_open * (1 - 0.0005) / (greatest(level, open) * (1 + 0.0005)) - 1 FROM brk1 WHERE hit"""
