"""Row filters and small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NEW_YORK

# The fund that stands for each sector.
SECTOR_FUNDS = {
    "Technology": "XLK", "Financial Services": "XLF", "Healthcare": "XLV", "Consumer Cyclical": "XLY", "Consumer Defensive": "XLP", "Energy": "XLE",
    "Industrials": "XLI", "Basic Materials": "XLB", "Utilities": "XLU", "Real Estate": "XLRE", "Communication Services": "XLC",
}


def sector_etf(sector: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SECTOR_FUNDS.items() for x in pair])[sector]


def drop_partial_bar(bars: DataFrame, now: Column, least: int = 300, round_the_clock: bool = False) -> DataFrame:
    """Without the newest bar if its day is still trading: today, a weekday, before 16:00 in New York, with enough history."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), now.cast("timestamp_ntz"))
    if round_the_clock:
        running = F.col("date") >= F.to_date(now)
    else:
        running = (F.col("date") == F.to_date(local)) & (F.weekday(local) < 5) & (F.hour(local) < 16)
    by_symbol = Window.partitionBy("symbol")
    rows = bars.withColumn("_r", F.row_number().over(by_symbol.orderBy(F.col("date").desc()))).withColumn("_k", F.count(F.lit(1)).over(by_symbol))
    return rows.where(~((F.col("_r") == 1) & running & (F.col("_k") > least))).drop("_r", "_k")


# The exchanges of the directory whose symbols are listed.
EXCHANGES = ["NMS", "NGM", "NCM", "NYQ", "ASE", "PCX", "BTS", "NAS", "NYS", "CXI", "CCC"]


def search_directory(directory: DataFrame, text: str, name: str, kind: str, kinds: list[str], exchange: str, order: str, limit: int = 8, exchanges: list[str] | None = None, longest: int = 40) -> DataFrame:
    """The first rows of the listed kinds and exchanges whose name has the text, in any case, and no dot; none for a blank or overlong text."""
    asked = (text or "").strip()
    if not asked or len(asked) > longest:
        return directory.limit(0)
    able = F.col(kind).isin(*kinds) & F.col(exchange).isin(*(exchanges or EXCHANGES)) & ~F.col(name).contains(".")
    return directory.where(able & F.contains(F.lower(name), F.lit(asked.lower()))).orderBy(order).limit(limit)


def newest_changes(rows: DataFrame, key: str, day: str, tie: str, n: int = 8) -> DataFrame:
    """The n newest rows of each key, however old, with their rank."""
    order = Window.partitionBy(key).orderBy(F.col(day).desc(), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def recent_counts(rows: DataFrame, key: str, action: str, actions: list[str], day: str, as_of: Column, days: int) -> DataFrame:
    """Counts of each action by key over the `days` up to as_of."""
    recent = rows.where((F.col(day) > F.date_sub(as_of, days)) & (F.col(day) <= as_of))
    return recent.groupBy(key).agg(*[F.count_if(F.col(action) == a).alias(a) for a in actions])
