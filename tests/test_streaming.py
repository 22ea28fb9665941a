import tempfile

from quantloom.streaming.news_stream import append_to, dedup_stream


def test_news_stream_drops_repeats(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [("A", "Big news!", "2024-01-01 00:00:00"), ("A", "big  NEWS", "2024-01-02 00:00:00"), ("B", "Big news", "2024-01-02 00:00:00"), ("A", "...", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "symbol string, title string, published string").selectExpr("symbol", "title", "cast(published as timestamp) published").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("symbol string, title string, published timestamp").parquet(f"{folder}/in")
    append_to(dedup_stream(stream), f"{folder}/out", f"{folder}/check").awaitTermination(60)
    assert sorted(r["symbol"] for r in spark.read.parquet(f"{folder}/out").collect()) == ["A", "B"]
