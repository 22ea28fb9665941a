"""As-of alignment of dated tables, by windows over slices of the time axis.

Only the distinct (keys, date) of the left table are aligned, and its rows meet them again
in a plain join, so a key that most rows share costs no task more than its dates.  The time
axis of a key is cut into slices of `days`; the window over the union of both tables runs
within (keys, slice), and what earlier slices (or later ones, looking forward) leave behind
comes from a small table with a row for each key and slice.  Frames always run from the start
of the order to the row, so a row costs one step; the next value is the last one in descending
order.  There is no range join and no assumption about either table's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_DAYS = 32


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str, forward: bool = False, name: str | None = None, days: int = SLICE_DAYS) -> DataFrame:
    """left with `name`: right's value of the newest date <= on (or, forward, the oldest >= on) for the same keys.

    Null values of right are passed over; a null date or key of left finds nothing.
    """
    name = name or value
    own = [f"_k{i}" for i in range(len(keys))]
    part = F.floor(F.unix_date(F.to_date("_on")) / days).alias("_slice")
    cut = lambda df, *more: df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(on).alias("_on"), *more)
    points = cut(left).where("_on is not null").distinct().select("*", part)
    known = cut(right, F.col(value).alias("_v")).where("_on is not null and _v is not null").select("*", part)
    order = lambda c: F.col(c).desc() if forward else F.col(c)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    both = points.withColumn("_own", F.lit(1)).unionByName(known.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    inside = F.last("_v", ignorenulls=True).over(so_far(Window.partitionBy(*own, "_slice").orderBy(order("_on"), "_own")))
    found = both.withColumn("_in", inside).where("_own = 1").select(*own, "_slice", "_on", "_in")
    end = F.min_by("_v", "_on") if forward else F.max_by("_v", "_on")
    ends = known.groupBy(*own, "_slice").agg(end.alias("_v")).withColumn("_own", F.lit(0))
    slots = points.select(*own, "_slice").distinct().withColumn("_own", F.lit(1))
    outside = F.last("_v", ignorenulls=True).over(so_far(Window.partitionBy(*own).orderBy(order("_slice"), F.desc("_own"))))  # a row a slice
    carried = slots.unionByName(ends, allowMissingColumns=True).withColumn("_out", outside).where("_own = 1").select(*own, "_slice", "_out")
    looked = found.join(carried, [*own, "_slice"]).select(*own, "_on", F.coalesce("_in", "_out").alias("_found"))
    same = [F.col(k) == F.col(o) for k, o in zip(keys, own, strict=True)]
    rows = left.select("*") if name not in left.columns else left.drop(name)
    return rows.join(looked, [*same, F.col(on) == F.col("_on")], "left").withColumn(name, F.col("_found")).select(*[c for c in left.columns if c != name], name)


def align_rate(bars: DataFrame, series: DataFrame, name: str = "rate") -> DataFrame:
    """bars with a series' newest value by each date; dates before its start take its newest value of all."""
    newest = series.agg(F.max_by("value", "date").alias("_newest"))
    out = asof(bars, series.select("date", "value"), [], "date", "value", name=name)
    return out.crossJoin(F.broadcast(newest)).withColumn(name, F.coalesce(name, "_newest")).drop("_newest")  # one row


def price_on(rows: DataFrame, bars: DataFrame, due: str) -> DataFrame:
    """rows(symbol, …) with end_price: the first close on or after the due date."""
    prices = bars.select("symbol", F.col("date").alias(due), F.col("close").alias("end_price"))
    return asof(rows, prices, ["symbol"], due, "end_price", forward=True)


def last_closes(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    return bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.max_by("close", "date").alias("last_close"))
