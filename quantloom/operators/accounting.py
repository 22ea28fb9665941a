"""Position accounting: decisions at the close are filled at the next open.

A bar's return has a part over night, earned by what was held before, and a part
from open to close, earned by what is held now; turnover costs a fee and cash earns
the daily rate.  All of it is lag arithmetic over (symbol, strategy, variant).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["symbol", "strategy", "variant"]
FEE = 0.0005
RATE = 0.0001


def order():
    return Window.partitionBy(*KEYS).orderBy("date")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def position_returns(signals: DataFrame, fee: float = FEE, rate: Column | float = RATE) -> DataFrame:
    """signals(KEYS, date, open, close, value: position) with held and ret; the first bar earns 0."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    pos = F.coalesce(F.nanvl("value", F.lit(None).cast("double")), F.lit(0.0))
    rows = signals.withColumn("held", _or_zero(F.lag(pos).over(order()))).withColumn("_gap", _or_zero(F.lag(pos, 2).over(order())))
    rows = rows.withColumn("_was", _or_zero(F.lag("held").over(order()))).withColumn("_pc", F.lag("close").over(order()))
    over_night = F.when(F.col("_pc") > 0, F.col("open") / F.col("_pc")).otherwise(1.0) - 1
    intraday = F.when(F.col("open") > 0, F.col("close") / F.col("open")).otherwise(1.0) - 1
    ret = (1 + F.col("_gap") * over_night) * (1 + F.col("held") * intraday) - 1 - fee * F.abs(F.col("held") - F.col("_was")) + (1 - F.col("held")) * rate
    return rows.withColumn("ret", F.when(F.col("_pc").isNull(), F.lit(0.0)).otherwise(ret)).drop("_gap", "_was", "_pc")


def breakout_fills(signals: DataFrame) -> DataFrame:
    """signals(…, value: level) with hit, entry price and the next open; the last bar cannot be left again, so it has no hit."""
    rows = signals.withColumn("next_open", F.lead("open").over(order())).withColumn("next_date", F.lead("date").over(order()))
    hit = F.coalesce((F.col("high") >= F.col("value")) & F.col("next_open").isNotNull(), F.lit(False))
    return rows.withColumn("hit", hit).withColumn("entry_px", F.greatest("value", "open"))


def breakout_returns(signals: DataFrame, fee: float = FEE, rate: float = RATE) -> DataFrame:
    """Bought at the level, or the open if that is higher, and sold at the next open."""
    rows = breakout_fills(signals).withColumn("_hit", F.lag("hit").over(order())).withColumn("_pc", F.lag("close").over(order()))
    over_night = F.when(F.col("_hit"), F.col("open") * (1 - fee) / F.col("_pc") - 1).otherwise(0.0)
    intraday = F.when(F.col("hit"), F.col("close") / (F.col("entry_px") * (1 + fee)) - 1).otherwise(0.0)
    held = F.when(F.col("hit"), 1.0).otherwise(0.0)
    ret = (1 + over_night) * (1 + intraday) - 1 + (1 - held) * rate
    rows = rows.withColumn("held", held).withColumn("ret", F.when(F.col("_pc").isNull(), F.lit(0.0)).otherwise(ret))
    return rows.drop("_hit", "_pc", "next_open", "next_date", "hit", "entry_px")


def _trade(entry: Column, exit_: Column, fee: float) -> Column:
    return exit_ * (1 - fee) / (entry * (1 + fee)) - 1


def extract_trades(held: DataFrame, fee: float = FEE) -> DataFrame:
    """held(KEYS, date, open, close, held): runs of held > 0, left at the next open or, still open, at the last close."""
    rows = held.withColumn("_was", _or_zero(F.lag("held").over(order()))).withColumn("_next", F.struct(F.lead("date").over(order()).alias("d"), F.lead("open").over(order()).alias("o")))
    starts = F.when((F.col("held") > 0) & (F.col("_was") <= 0), 1).otherwise(0)
    rows = rows.withColumn("_start", starts).withColumn("_island", F.sum("_start").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("held > 0").groupBy(*KEYS, "_island").agg(
        F.min("date").alias("entry"), F.min_by("open", "date").alias("entry_px"), F.max_by(F.struct("date", "close", "_next"), "date").alias("z"), F.count(F.lit(1)).alias("days")
    )
    out = runs.select(
        *KEYS, "entry", F.coalesce("z._next.d", "z.date").alias("exit"), "entry_px", F.when(F.col("z._next.d").isNull(), F.col("z.close")).otherwise(F.col("z._next.o")).alias("exit_px"),
        "days", F.col("z._next.d").isNull().alias("is_open"),
    )
    return out.withColumn("ret", _trade(F.col("entry_px"), F.col("exit_px"), fee))


def breakout_trades(signals: DataFrame, fee: float = FEE) -> DataFrame:
    rows = breakout_fills(signals).where("hit")
    out = rows.select(*KEYS, F.col("date").alias("entry"), F.col("next_date").alias("exit"), "entry_px", F.col("next_open").alias("exit_px"), F.lit(1).cast("long").alias("days"), F.lit(False).alias("is_open"))
    return out.withColumn("ret", _trade(F.col("entry_px"), F.col("exit_px"), fee))


def buy_hold(bars: DataFrame, fee: float = FEE, rate: float = RATE) -> DataFrame:
    """Always in the market: the baseline."""
    rows = bars.select("*", F.lit("buy_hold").alias("strategy"), F.lit(0).alias("variant"), F.lit(1.0).alias("value"))
    return position_returns(rows, fee, rate)


def approximate_returns(held: DataFrame, fee: float = FEE, rate: float = RATE) -> DataFrame:
    """Close to close: held times the market's return; the first bar has no turnover and no return of the market."""
    market = F.coalesce(F.col("close") / F.lag("close").over(order()) - 1, F.lit(0.0))
    turnover = F.abs(F.col("held") - F.coalesce(F.lag("held").over(order()), F.col("held")))
    return held.withColumn("ret", F.col("held") * market + (1 - F.col("held")) * rate - fee * turnover)


def _steps(wide: DataFrame, positions: list[tuple[str, int]], levels: list[tuple[str, int]]) -> DataFrame:
    """wide(symbol, date, …, a column <strategy>_<variant> each) with the bar number i, the bars before and after, and arrays over
    all variants, positions first: _held and _was, what is held now and was a bar ago, _will, what the next bar holds, and _level.
    Windows are over symbols, so no row is made, sorted or shuffled for a variant."""
    c, o, none = F.col, Window.partitionBy("symbol").orderBy("date"), F.lit(None).cast("double")
    rows = wide.select(
        "*", (F.row_number().over(o) - 1).alias("i"), F.lag("close").over(o).alias("_pc"), F.lead("open").over(o).alias("_next_open"), F.lead("date").over(o).alias("_next_date"),
        F.array(*[_or_zero(F.nanvl(f"{s}_{v}", none)) for s, v in positions]).cast("array<double>").alias("_now"), F.array(*[c(f"{s}_{v}") for s, v in levels]).cast("array<double>").alias("_level"),
    )
    hits = F.transform("_level", lambda x: F.when((c("high") >= x) & c("_next_open").isNotNull(), 1.0).otherwise(0.0))
    rows = rows.withColumn("_hits", hits)
    rows = rows.select("*", F.lag("_now").over(o).alias("_one"), F.lag("_now", 2).over(o).alias("_two"), F.lag("_hits").over(o).alias("_hit"))
    zeros = lambda x, n: F.coalesce(x, F.array_repeat(F.lit(0.0), n))
    n, m = len(positions), len(levels)
    return rows.select(
        *wide.columns, "i", "_pc", "_next_open", "_next_date", F.concat(zeros(c("_one"), n), c("_hits")).alias("_held"), F.concat(zeros(c("_two"), n), zeros(c("_hit"), m)).alias("_was"), c("_now").alias("_will"), "_level"
    )


def _names(positions: list[tuple[str, int]], levels: list[tuple[str, int]]) -> Column:
    """The variants with their places in the arrays, a constant."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("strategy"), F.lit(v).alias("variant"), F.lit(k >= len(positions)).alias("day")) for k, (s, v) in enumerate([*positions, *levels])])


def wide_returns(wide: DataFrame, positions: list[tuple[str, int]], levels: list[tuple[str, int]]) -> DataFrame:
    """wide with i and names, the array of its variants, for `unfolded`."""
    return _steps(wide, positions, levels).drop("_next_open", "_next_date", "_will").withColumn("names", _names(positions, levels)).withColumn("_first", F.lit(len(positions)))


def unfolded(rows: DataFrame, keep: list[str], only: Column | str = "names", fee: float = FEE, rate: float = RATE) -> DataFrame:
    """(keep, strategy, variant, held, ret) of each of the variants `only`: the figures of position_returns and breakout_returns of the stacked rows."""
    c = F.col
    rows = rows.withColumn("e", F.explode(only))
    k, held, was, level = c("e.k"), F.get("_held", c("e.k")), F.get("_was", c("e.k")), F.get("_level", c("e.k") - c("_first"))
    gap = F.when(c("_pc") > 0, c("open") / c("_pc")).otherwise(1.0) - 1
    day = F.when(c("open") > 0, c("close") / c("open")).otherwise(1.0) - 1
    stay = (1 + was * gap) * (1 + held * day) - 1 - fee * F.abs(held - was) + (1 - held) * rate
    over_night = F.when(was > 0, c("open") * (1 - fee) / c("_pc") - 1).otherwise(0.0)
    intraday = F.when(held > 0, c("close") / (F.greatest(level, c("open")) * (1 + fee)) - 1).otherwise(0.0)
    bought = (1 + over_night) * (1 + intraday) - 1 + (1 - held) * rate
    ret = F.when(c("_pc").isNull(), F.lit(0.0)).when(c("e.day"), bought).otherwise(stay)
    return rows.select(*keep, "e.strategy", "e.variant", held.alias("held"), ret.alias("ret"))


def wide_trades(wide: DataFrame, positions: list[tuple[str, int]], levels: list[tuple[str, int]], keep: list[str], fee: float = FEE) -> DataFrame:
    """(KEYS, entry, exit, entry_px, exit_px, days, is_open, ret, i, …keep): the trades of extract_trades and breakout_trades with the
    bar number of their entry; only the first and last bars of a run become rows."""
    c = F.col
    rows = _steps(wide, positions, levels).withColumn("e", F.explode(_names(positions, levels)))
    held, was, will, day = F.get("_held", c("e.k")), F.get("_was", c("e.k")), F.get("_will", c("e.k")), c("e.day")
    own = ["symbol", "date", "i", "close", "_next_date", "_next_open", *keep]
    rows = rows.select(
        *own, "e.strategy", "e.variant", ((held > 0) & (day | (was <= 0))).alias("start"), ((held > 0) & (day | c("_next_date").isNull() | (will <= 0))).alias("end"),
        F.when(day, F.greatest(F.get("_level", c("e.k") - len(positions)), c("open"))).otherwise(c("open")).alias("px"),
    ).where("start or end")
    begun = F.last(F.when(c("start"), F.struct(c("date").alias("entry"), c("px").alias("entry_px"), c("i").alias("at"), *keep)), ignorenulls=True)
    rows = rows.withColumn("b", begun.over(order().rowsBetween(Window.unboundedPreceding, 0))).where("end")
    is_open = c("_next_date").isNull()
    out = rows.select(
        *KEYS, "b.entry", F.coalesce("_next_date", "date").alias("exit"), "b.entry_px", F.when(is_open, c("close")).otherwise(c("_next_open")).alias("exit_px"),
        (c("i") - c("b.at") + 1).cast("long").alias("days"), is_open.alias("is_open"), c("b.at").alias("i"), *[c(f"b.{x}").alias(x) for x in keep],
    )
    return out.withColumn("ret", _trade(c("entry_px"), c("exit_px"), fee))
