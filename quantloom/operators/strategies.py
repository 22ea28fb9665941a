"""Strategy library: each variant is a rule over columns of the bars panel.

A rule names the input columns it needs and says when to be in the market: a
position decided at the close, entry and exit events, or an intraday level to buy
at.  All variants of all strategies become columns of one wide table, made by one
window stage per symbol, and are then stacked to rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import indicators as ind
from .smooth import with_smoothed


@dataclass
class Rule:
    """inputs are windows over bars; smoothed names columns of `with_smoothed`; before lists columns whose previous value the events need (as prev_<name>)."""

    inputs: dict[str, Column] = field(default_factory=dict)
    before: tuple[str, ...] = ()
    smoothed: tuple[str, ...] = ()
    position: Column | None = None
    entry: Column | None = None
    exit: Column | None = None
    level: Column | None = None
    votes: tuple[int, tuple[str, ...]] | None = None


@dataclass(frozen=True)
class Strategy:
    """family: trend (flat votes -1), reversion (flat votes 0) or day (no vote); kind: position or breakout."""

    key: str
    family: str
    kind: str
    grid: tuple[dict, ...]
    rule: Callable[[dict], Rule]


STRATEGIES: dict[str, Strategy] = {}


def register_strategy(key: str, family: str, kind: str, grid: tuple[dict, ...], rule: Callable[[dict], Rule]) -> Strategy:
    """Add a strategy whose rule turns one set of parameters of the grid into columns."""
    STRATEGIES[key] = Strategy(key, family, kind, tuple(grid), rule)
    return STRATEGIES[key]


c = F.col


def _sma_cross(p: dict) -> Rule:
    a, b = f"sma{p['short']}", f"sma{p['long']}"
    return Rule(smoothed=(a, b), position=c(a) > c(b))


def _macd(p: dict) -> Rule:
    name = f"macd_{p['fast']}_{p['slow']}_{p['signal']}"
    return Rule(smoothed=(name,), position=c(f"{name}_line") > c(f"{name}_signal"))


def _rsi_cross(p: dict) -> Rule:
    buy, sell = F.lit(p["buy"]), F.lit(p["sell"])
    return Rule(smoothed=("rsi14",), before=("rsi14",), entry=(c("rsi14") > buy) & (c("prev_rsi14") <= buy), exit=(c("rsi14") < sell) & (c("prev_rsi14") >= sell))


def _bollinger(p: dict) -> Rule:
    tag = str(p["k"]).replace(".", "")
    mid, sd = f"sma{p['n']}", f"sd{p['n']}"
    up, low = c(mid) + p["k"] * c(sd), c(mid) - p["k"] * c(sd)
    u, d = f"up{p['n']}_{tag}", f"low{p['n']}_{tag}"
    entry = (c("close") > c(d)) & (c("prev_close") < c(f"prev_{d}"))
    return Rule({u: up, d: low}, before=("close", u, d), smoothed=(mid, sd), entry=entry, exit=(c("close") < c(u)) & (c("prev_close") > c(f"prev_{u}")))


def _obv(p: dict) -> Rule:
    return Rule(smoothed=(f"obv_sma{p['n']}",), position=c("obv") > c(f"obv_sma{p['n']}"))


BASE = ("sma_cross", "macd", "rsi_cross", "bollinger", "obv")


def _combined(p: dict) -> Rule:
    return Rule(votes=(p["k"], tuple(f"{s}_0" for s in BASE)))


def _donchian(p: dict) -> Rule:
    h, d = f"high_before{p['entry']}", f"low_before{p['exit']}"
    return Rule(smoothed=(h, d), entry=c("close") > c(h), exit=c("close") < c(d))


def _momentum(p: dict) -> Rule:
    return Rule({f"mom{p['n']}": ind.change("close", p["n"])}, position=c(f"mom{p['n']}") > 0)


def _trend_filter(p: dict) -> Rule:
    return Rule(smoothed=(f"sma{p['n']}",), position=c("close") > c(f"sma{p['n']}"))


def _dip(p: dict) -> Rule:
    return Rule(smoothed=("rsi2", "sma200", "sma5"), entry=(c("rsi2") < p["th"]) & (c("close") > c("sma200")), exit=c("close") > c("sma5"))


def _breakout(p: dict) -> Rule:
    return Rule({"range1": F.lag(c("high") - c("low")).over(ind.history())}, level=c("open") + F.lit(p["k"]) * c("range1"))


# The published parameter grids.
register_strategy("sma_cross", "trend", "position", ({"short": 3, "long": 15}, {"short": 10, "long": 50}, {"short": 20, "long": 100}, {"short": 50, "long": 200}), _sma_cross)
register_strategy("macd", "trend", "position", ({"fast": 8, "slow": 17, "signal": 12}, {"fast": 12, "slow": 26, "signal": 9}, {"fast": 5, "slow": 35, "signal": 5}), _macd)
register_strategy("rsi_cross", "reversion", "position", ({"n": 14, "buy": 45, "sell": 65}, {"n": 14, "buy": 30, "sell": 70}), _rsi_cross)
register_strategy("bollinger", "reversion", "position", ({"n": 20, "k": 2.0}, {"n": 20, "k": 2.5}), _bollinger)
register_strategy("obv", "trend", "position", ({"n": 10}, {"n": 20}, {"n": 50}), _obv)
register_strategy("combined", "trend", "position", ({"k": 3}, {"k": 4}), _combined)
register_strategy("donchian", "trend", "position", ({"entry": 20, "exit": 10}, {"entry": 55, "exit": 20}), _donchian)
register_strategy("ts_momentum", "trend", "position", ({"n": 63}, {"n": 126}, {"n": 252}), _momentum)
register_strategy("trend_filter", "trend", "position", ({"n": 100}, {"n": 150}, {"n": 200}), _trend_filter)
register_strategy("rsi2", "reversion", "position", ({"th": 5}, {"th": 10}, {"th": 20}), _dip)
register_strategy("vol_breakout", "day", "breakout", ({"k": 0.4}, {"k": 0.5}, {"k": 0.6}), _breakout)


def wide_signals(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """bars with a column <strategy>_<variant> for each variant: a position of 0 or 1, or a breakout level."""
    chosen = [STRATEGIES[k] for k in (keys or STRATEGIES)]
    if any(s.key == "combined" for s in chosen):
        chosen = [*chosen, *(STRATEGIES[k] for k in BASE if k not in {s.key for s in chosen})]
    rules = {f"{s.key}_{v}": s.rule(p) for s in chosen for v, p in enumerate(s.grid)}
    smoothed = sorted({n for r in rules.values() for n in r.smoothed})
    rows = ind.with_obv(bars)
    rows = with_smoothed(rows, smoothed) if smoothed else rows
    inputs = {k: v for r in rules.values() for k, v in r.inputs.items()}
    rows = rows.select("*", *[v.alias(k) for k, v in inputs.items()])
    before = sorted({b for r in rules.values() for b in r.before})
    rows = rows.select("*", *[F.lag(b).over(ind.history()).alias(f"prev_{b}") for b in before])
    made = {}
    for name, r in rules.items():
        if r.position is not None:
            made[name] = ind.as_position(r.position)
        elif r.entry is not None:
            made[name] = ind.hold_state(r.entry, r.exit)
        elif r.level is not None:
            made[name] = r.level
    rows = rows.select(*bars.columns, *[v.alias(k) for k, v in made.items()])
    votes = {n: r.votes for n, r in rules.items() if r.votes}
    for name, (k, parts) in votes.items():
        total = c(parts[0])
        for x in parts[1:]:
            total = total + c(x)
        rows = rows.withColumn(name, ind.as_position(total >= k))
    wanted = [f"{s}_{v}" for s in (keys or STRATEGIES) for v in range(len(STRATEGIES[s].grid))]
    return rows.select(*bars.columns, *wanted)


def stacked(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(bars columns, strategy, variant, value) rows of the named strategies."""
    names = variants(keys)
    own = [x for x in wide.columns if x not in {f"{s}_{v}" for s in STRATEGIES for v in range(len(STRATEGIES[s].grid))}]
    cells = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(v).alias("variant"), c(f"{s}_{v}").alias("value")) for s, v in names])
    return wide.select(*own, F.explode(cells).alias("_c")).select(*own, "_c.strategy", "_c.variant", "_c.value")


def position_keys() -> list[str]:
    return [k for k, s in STRATEGIES.items() if s.kind == "position"]


def breakout_keys() -> list[str]:
    return [k for k, s in STRATEGIES.items() if s.kind == "breakout"]


def variants(keys: list[str]) -> list[tuple[str, int]]:
    """(strategy, variant) of the named strategies."""
    return [(s, v) for s in keys for v in range(len(STRATEGIES[s].grid))]


def strategy_grid(spark) -> DataFrame:
    """(strategy, family, kind, variant, params): a few dozen rows."""
    rows = [(s.key, s.family, s.kind, v, {k: float(x) for k, x in p.items()}) for s in STRATEGIES.values() for v, p in enumerate(s.grid)]
    return spark.createDataFrame(rows, "strategy string, family string, kind string, variant int, params map<string,double>")
