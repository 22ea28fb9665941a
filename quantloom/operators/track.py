"""Track record of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .asof import asof, price_on


def with_price(runs: DataFrame, bars: DataFrame) -> DataFrame:
    """runs with the newest close by their day; runs before the first bar drop out."""
    prices = bars.select("symbol", F.col("date").alias("created"), F.col("close").alias("price"))
    return asof(runs, prices, ["symbol"], "created", "price").where("price is not null")


def evaluate_runs(runs: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """Return and hit of each run: to the first close on or after the due date once that is past, else to the last close."""
    due = runs.withColumn("due", sc.due_date(F.col("created"), F.col("horizon")))
    last = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("newest"))
    rows = price_on(due, bars, "due").join(last, "symbol").withColumn("evaluated", F.col("due") <= as_of)
    end = F.coalesce(F.when(F.col("evaluated"), F.col("end_price")), F.col("newest"))
    rows = rows.withColumn("ret", end / F.col("price") - 1)
    return rows.select("id", "symbol", "horizon", "verdict", "due", "evaluated", "ret", F.when(F.col("evaluated"), sc.is_hit(F.col("verdict"), F.col("ret"))).alias("hit"))


def track_record(evaluated: DataFrame) -> DataFrame:
    """Count, hit rate and mean return of evaluated runs, by verdict and for all."""
    g = evaluated.where("hit is not null").rollup("verdict")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("ret").alias("avg_return"))
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("all")))
