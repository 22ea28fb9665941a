"""News deduplication by micro-batch: the newest article of each symbol and title, kept as a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_title


def dedup_stream(news: DataFrame, watermark: str = "21 days") -> DataFrame:
    """A stream of articles(symbol, title, published timestamp, …) with later repeats of a title dropped within the watermark."""
    keyed = news.withColumn("key", normal_title(F.col("title"))).where("key <> ''")
    return keyed.withWatermark("published", watermark).dropDuplicatesWithinWatermark(["symbol", "key"])


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Start the query that appends the stream to a Parquet table; exactly once by Spark's file sink."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
