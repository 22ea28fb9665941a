"""Run records, watchlists, snapshots and weights as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_runs(runs: DataFrame, path: str) -> None:
    """Append records partitioned by month; every field also goes into the JSON payload."""
    payload = F.to_json(F.struct(*runs.columns))
    runs.withColumn("result", payload).withColumn("run_month", F.date_format("created", "yyyy-MM")).write.mode("append").partitionBy("run_month").parquet(path)


def list_runs(runs: DataFrame, symbol: str | None = None, limit: int = 50, paths: dict[str, str] | None = None) -> DataFrame:
    """Newest records first, with values at JSON paths of the payload where asked for; null where the payload has none."""
    rows = runs if symbol is None else runs.where(F.col("symbol") == symbol)
    rows = rows.orderBy(F.col("created").desc(), F.col("id").desc()).limit(limit)
    keep = [c for c in runs.columns if c != "result"]
    return rows.select(*keep, *[F.get_json_object("result", p).alias(n) for n, p in (paths or {}).items()])


def get_run(runs: DataFrame, run_id) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(delta, keys, "left_anti").unionByName(delta)


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone, keys, "left_anti")


def fresh(snapshots: DataFrame, as_of: Column, seconds: int, payload: str = "payload") -> DataFrame:
    """The newest payload of each key that is younger than `seconds`."""
    young = snapshots.where(F.col("fetched_at") > as_of - F.make_dt_interval(secs=F.lit(seconds)))
    return young.groupBy("key").agg(F.max_by(payload, "fetched_at").alias(payload), F.max("fetched_at").alias("fetched_at"))


def is_kept(as_of: Column, days: int = 30) -> Column:
    """Whether a payload is not older than `days`."""
    return F.col("fetched_at") >= as_of - F.make_dt_interval(days=F.lit(days))


def expire(snapshots: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Without payloads older than `days`: what a store keeps when it is opened."""
    return snapshots.where(is_kept(as_of, days))


def newest(history: DataFrame, n: int) -> DataFrame:
    return history.orderBy(F.col("id").desc()).limit(n)


def matured(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Runs older than `days`; of records that append_runs wrote only the months that can have some are read."""
    cut = F.date_sub(as_of, days)
    rows = runs.where(F.col("created") < cut)
    return rows.where(F.col("run_month") <= F.date_format(cut, "yyyy-MM")) if "run_month" in runs.columns else rows


def _rank(runs: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("created").desc(), F.col("id").desc())
    return runs.withColumn("_n", F.row_number().over(order))


def watch_status(watch: DataFrame, runs: DataFrame) -> DataFrame:
    """watch(symbol, horizon) with its newest and second newest verdict and the newest date."""
    two = _rank(runs, ["symbol", "horizon"]).where("_n <= 2").groupBy("symbol", "horizon")
    two = two.agg(*[F.max(F.when(F.col("_n") == n, F.col(c))).alias(f"{p}_{c}") for n, p in ((1, "last"), (2, "prev")) for c in ("verdict", "created", "score")])
    return watch.join(two, ["symbol", "horizon"], "left")


def verdict_changed(status: DataFrame) -> DataFrame:
    changed = F.coalesce(F.col("last_verdict") != F.col("prev_verdict"), F.lit(False))
    return status.withColumn("changed", changed)


def autorun_due(watch: DataFrame, runs: DataFrame, slot: Column) -> DataFrame:
    """Watched pairs without a run since the slot."""
    last = runs.groupBy("symbol", "horizon").agg(F.max("created").alias("last_created"))
    return watch.join(last, ["symbol", "horizon"], "left").where(F.col("last_created").isNull() | (F.col("last_created") < slot))


def repeated_runs(runs: DataFrame, hours: int = 6, same: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    """Runs that follow another of the same kind within `hours`."""
    order = Window.partitionBy(*same).orderBy("created", "id")
    gap = F.unix_timestamp(F.col("created").cast("timestamp")) - F.unix_timestamp(F.lag("created").over(order).cast("timestamp"))
    return runs.withColumn("_gap", gap).where(F.col("_gap") <= hours * 3600).drop("_gap")


def write_report(report: DataFrame, path: str) -> None:
    """A report as one line of JSON per row."""
    report.coalesce(1).write.mode("overwrite").json(path)
