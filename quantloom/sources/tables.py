"""Readers of the input tables and what makes their rows fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]


def finite(c: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def clean_bars(raw: DataFrame) -> DataFrame:
    """Rows with all four prices, volume 0 where missing, six decimals."""
    rows = raw.select("symbol", F.to_date("date").alias("date"), *[finite(F.col(c)).alias(c) for c in PRICES], F.coalesce(finite(F.col("volume")), F.lit(0.0)).alias("volume"))
    return rows.dropna(subset=PRICES).select("symbol", "date", *[F.round(c, 6).alias(c) for c in [*PRICES, "volume"]])


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return clean_bars(spark.read.parquet(path))


def make_bars(rows: DataFrame, symbol: Column, ts: str, price: str, order_key: list[str]) -> DataFrame:
    """Daily bars of any price rows; ties in time are ordered by order_key, and volume counts rows."""
    at = F.struct(ts, *order_key)
    day = rows.groupBy(symbol.alias("symbol"), F.to_date(ts).alias("date"))
    return day.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def one_series(series: DataFrame, series_id: str) -> DataFrame:
    return series.where(F.col("series_id") == series_id).select("date", "value")


def read_series(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    return one_series(spark.read.parquet(path), series_id)


def with_period_index(statements: DataFrame) -> DataFrame:
    """i counts the dates of a symbol's statement from the newest, 0, for all its items alike; values that are not finite are null."""
    newest = Window.partitionBy("symbol", "stmt").orderBy(F.col("period_end").desc())
    return statements.withColumn("value", finite(F.col("value"))).withColumn("i", F.dense_rank().over(newest) - 1)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    return with_period_index(spark.read.parquet(path))


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, struct) of JSON payloads parsed by a DDL schema."""
    return spark.read.parquet(path).withColumn("payload", F.from_json("payload", schema))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return rows.withColumn("published", F.to_timestamp("published"))
