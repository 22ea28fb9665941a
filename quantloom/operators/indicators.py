"""Fixed-frame indicators: column expressions over one window of each symbol.

All of them look back only, so values of a full history equal those of any prefix,
and all share one exchange and sort by (symbol, date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history():
    """A symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("date")


def so_far():
    return history().rowsBetween(Window.unboundedPreceding, 0)


def last(n: int):
    """The newest n rows up to this one."""
    return history().rowsBetween(-(n - 1), 0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def when_full(value: Column, c: Column | str, n: int) -> Column:
    """value once the frame has n observations, else null."""
    return F.when(F.count(col(c)).over(last(n)) == n, value)


def sma(c: Column | str, n: int) -> Column:
    return when_full(F.avg(col(c)).over(last(n)), c, n)


def bollinger(c: Column | str, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """(middle, upper, lower) with the population deviation."""
    mid, sd = sma(c, n), when_full(F.stddev_pop(col(c)).over(last(n)), c, n)
    return mid, mid + k * sd, mid - k * sd


def true_range() -> Column:
    """Null-skipping, so the first bar gives high - low."""
    before = F.lag("close").over(history())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def obv() -> Column:
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(history())), F.lit(0.0))
    return step * F.col("volume")


def with_obv(bars: DataFrame) -> DataFrame:
    """On-balance volume: the running sum of signed volume, 0 on the first bar."""
    return bars.withColumn("_step", obv()).withColumn("obv", F.sum("_step").over(so_far())).drop("_step")


def donchian(entry: int, exit_: int) -> tuple[Column, Column]:
    """Highest high and lowest low of the bars before this one."""
    span = lambda n: history().rowsBetween(-n, -1)
    high = F.when(F.count("high").over(span(entry)) == entry, F.max("high").over(span(entry)))
    low = F.when(F.count("low").over(span(exit_)) == exit_, F.min("low").over(span(exit_)))
    return high, low


def moving_sums(rows: DataFrame, sums: dict[str, Column], n: int) -> DataFrame:
    """rows(symbol, date, …) with sums over the newest n rows, in a few steps for each row however long n is.

    Rows are cut into chunks of n.  The newest n rows are the chunk so far and the end of the one before, which is its
    total less what stood at the same place; so only numbers of one window's size are subtracted.
    """
    chunk = Window.partitionBy("symbol", "_chunk").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = history().rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_i", bar_index()).withColumn("_chunk", F.floor(F.col("_i") / n))
    numbered = numbered.select("*", *[F.sum(v).over(chunk).alias(f"_p_{k}") for k, v in sums.items()])
    whole = lambda k: F.last(F.when(F.col("_i") % n == n - 1, F.col(f"_p_{k}")), ignorenulls=True).over(before)
    value = lambda k: F.col(f"_p_{k}") + F.coalesce(whole(k) - F.lag(f"_p_{k}", n).over(history()), whole(k), F.lit(0.0))
    return numbered.select(*rows.columns, F.least(F.col("_i") + 1, F.lit(n)).alias("rows"), *[value(k).alias(k) for k in sums])


def change(c: Column | str, n: int = 1) -> Column:
    """c / c[n bars ago] - 1."""
    return F.try_divide(col(c), F.lag(col(c), n).over(history())) - 1


def log_return() -> Column:
    return F.log(F.col("close")) - F.log(F.lag("close").over(history()))


def forward_return(n: int) -> Column:
    return F.lead("close", n).over(history()) / F.col("close") - 1


def bar_index() -> Column:
    return F.row_number().over(history()) - 1


def crosses_above(x: Column, level: Column) -> Column:
    """x is above level and was not on the bar before; null counts as no. Needs x, level as plain columns."""
    return F.coalesce((x > level) & (F.lag(x).over(history()) <= F.lag(level).over(history())), F.lit(False))


def hold_state(entry: Column, exit_: Column) -> Column:
    """1 from an entry to the next exit, which wins on the same bar; 0 before the first event."""
    event = F.when(F.coalesce(exit_, F.lit(False)), F.lit(0.0)).when(F.coalesce(entry, F.lit(False)), F.lit(1.0))
    return F.coalesce(F.last(event, ignorenulls=True).over(so_far()), F.lit(0.0))


def as_position(held: Column) -> Column:
    return F.when(F.coalesce(held, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def market_state(rsi: Column, mom_bars: int = 63, avg: Column | None = None) -> Column:
    """100 above the 200-bar average, 10 for a positive quarter, and the RSI zone 0, 1 or 2; null if any is unknown."""
    avg, mom = sma("close", 200) if avg is None else avg, change("close", mom_bars)
    zone = F.when(rsi < 30, 0).when(rsi > 70, 2).otherwise(1)
    code = F.when(F.col("close") > avg, 100).otherwise(0) + F.when(mom > 0, 10).otherwise(0) + zone
    return F.when(avg.isNotNull() & mom.isNotNull() & rsi.isNotNull(), code)


def price_levels(bars: DataFrame) -> DataFrame:
    """Averages, bands and extremes of each bar that later steps compare the price with."""
    _, up, low = bollinger("close")
    return bars.select(
        "symbol", "date", "close", sma("close", 20).alias("sma20"), sma("close", 50).alias("sma50"), sma("close", 200).alias("sma200"), up.alias("bb_up"), low.alias("bb_low"),
        F.max("high").over(last(20)).alias("high20"), F.min("low").over(last(20)).alias("low20"), F.max("close").over(last(252)).alias("high52w"), F.min("close").over(last(252)).alias("low52w"),
    )


def newest(df: DataFrame, by: str = "date") -> DataFrame:
    """The newest row of each symbol."""
    top = Window.partitionBy("symbol").orderBy(F.col(by).desc())
    return df.withColumn("_n", F.row_number().over(top)).where("_n = 1").drop("_n")


def equity(returns: DataFrame, keys: list[str]) -> DataFrame:
    """returns(keys, date, ret) with the compounded value and the drawdown from its peak."""
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("equity", F.product(1 + F.col("ret")).over(run))
    return grown.withColumn("drawdown", F.col("equity") / F.max("equity").over(run) - 1)


def downsample(curve: DataFrame, keys: list[str], points: int = 200) -> DataFrame:
    """Every max(1, n // points)-th row, and the last."""
    order = Window.partitionBy(*keys).orderBy("date")
    numbered = curve.withColumn("_i", F.row_number().over(order) - 1).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    step = F.greatest(F.lit(1), F.floor(F.col("_c") / points))
    return numbered.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_c") - 1)).drop("_i", "_c")


def signal_age(signals: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Bars since the last change of the position, and whether that is at most two."""
    order = Window.partitionBy(*keys).orderBy("date")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = signals.withColumn("_i", F.row_number().over(order)).withColumn("_was", F.lag(pos).over(order))
    moved = F.last(F.when(F.col(pos) != F.col("_was"), F.col("_i")), ignorenulls=True).over(run)
    return numbered.withColumn("since", F.col("_i") - moved).withColumn("fresh", F.coalesce(F.col("since") <= 2, F.lit(False))).drop("_i", "_was")
