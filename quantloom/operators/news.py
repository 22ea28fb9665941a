"""News: deduplication, labels and sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc


def dedup_news(news: DataFrame, *more: DataFrame) -> DataFrame:
    """The newest article of each symbol and normalised title, over all sources."""
    for other in more:
        news = news.unionByName(other, allowMissingColumns=True)
    keyed = news.withColumn("key", sc.normal_title(F.col("title"))).where("key <> ''")
    order = Window.partitionBy("symbol", "key").orderBy(F.col("published").desc(), "id")
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_news(news: DataFrame, n: int = 40) -> DataFrame:
    order = Window.partitionBy("symbol").orderBy(F.col("published").desc(), "id")
    return dedup_news(news.where(~sc.is_junk(F.col("title")))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def attach_labels(news: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """All articles, with their labels where there are any."""
    return news.join(labels, key, "left")


def with_weight(labelled: DataFrame, as_of: Column) -> DataFrame:
    """Labelled articles with age in days and decayed weight."""
    age = F.greatest(F.datediff(as_of, F.col("published")).cast("double"), F.lit(0.0))
    rows = labelled.where("sentiment is not null").withColumn("age", age)
    return rows.withColumn("weight", sc.label_weight(F.col("relevance"), F.col("impact"), F.col("event"), F.col("age")))


def news_score(labelled: DataFrame, as_of: Column) -> DataFrame:
    """Per symbol: weighted sentiment, its recent and older parts, and confidence; unavailable below a weight of 0.05."""
    rows = with_weight(labelled, as_of)
    part = lambda cond: F.try_divide(F.sum(F.when(cond, F.col("sentiment") * F.col("weight"))), F.sum(F.when(cond, F.col("weight"))))
    g = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("labelled"), F.sum("weight").alias("total"), part(F.lit(True)).alias("s"), part(F.col("age") <= 7).alias("recent_7d"), part(F.col("age") > 7).alias("older"))
    ok = F.col("total") >= 0.05
    return g.select("symbol", "labelled", ok.alias("available"), F.when(ok, F.col("s")).otherwise(0.0).alias("score"), F.when(ok, 1 - F.exp(-F.col("total") / 2.5)).otherwise(0.0).alias("confidence"), "recent_7d", "older")


def news_counts(labelled: DataFrame) -> DataFrame:
    """Relevant articles by symbol and event, with those clearly positive and negative."""
    rows = labelled.where("sentiment is not null and relevance >= 0.5")
    return rows.groupBy("symbol", "event").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sentiment") > 0.15).alias("positive"), F.count_if(F.col("sentiment") < -0.15).alias("negative"))


def news_drivers(labelled: DataFrame, as_of: Column, n: int = 5) -> DataFrame:
    order = Window.partitionBy("symbol").orderBy(F.abs(F.col("sentiment") * F.col("weight")).desc(), "id")
    return with_weight(labelled, as_of).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_news(labelled: DataFrame, n: int = 15) -> DataFrame:
    """What is shown: relevance of 0.5 or more, unlabelled articles included, the newest n."""
    order = Window.partitionBy("symbol").orderBy(F.col("published").desc(), "id")
    return labelled.where(F.coalesce("relevance", F.lit(1.0)) >= 0.5).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
