"""Stores of keyed rows: untouched parts stay, versions, races, expiry, lookups by part and row group."""

import pytest
from pyspark.sql import functions as F

from quantloom.session import shared_path
from quantloom.sources import records as rec
from quantloom.sources.keyed_store import KeyedStore, StoreConflict


def _files(store, version=None):
    return {f.rsplit("/", 1)[-1] for f in store.read(version).inputFiles()}


def _dict(df):
    return {r["id"]: r["v"] for r in df.collect()}


@pytest.fixture
def store(spark):
    s = KeyedStore(spark, shared_path(spark, "store"), ["id"], parts=8)
    assert s.manifest()["version"] == 0 and s.delete(spark.range(3)) == 0
    assert s.upsert(spark.range(200).select("id", F.concat(F.lit("v"), "id").alias("v"))) == 1
    return s


def test_a_delta_rewrites_its_parts_only(spark, store):
    before = store.manifest()["parts"]
    delta = spark.createDataFrame([(7, "new"), (1000, "added"), (None, "no key")], "id long, v string")
    touched = {str(r[0]) for r in delta.select(store.part_of(delta.schema)).distinct().collect()}
    assert store.upsert(delta) == 2 and 0 < len(touched) < 8
    after = store.manifest()["parts"]
    assert {k for k in after if before.get(k) != after[k]} == touched
    assert _files(store, 1) & _files(store, 2) == {f for k, d in before.items() if k not in touched for f in _files(store, 1) if f in _files(store, 2)} and len(_files(store, 1) & _files(store, 2)) == 8 - len(touched)
    want = {i: f"v{i}" for i in range(200)} | {7: "new", 1000: "added", None: "no key"}
    assert _dict(store.read()) == want and _dict(store.read(1)) == {i: f"v{i}" for i in range(200)}
    assert store.upsert(delta.where("id = 7").withColumn("v", F.lit("again")).unionByName(delta.where("id = 7")), order="v") == 3
    assert _dict(store.get(7)) == {7: "new"} and _dict(store.get(None)) == {None: "no key"} and not _dict(store.get(5000))
    assert store.upsert(delta.limit(0)) == 3


def test_deletes_expiry_and_vacuum(spark, store):
    assert store.delete(spark.range(0, 200, 7).union(spark.range(900, 901))) == 2
    assert sorted(_dict(store.read())) == [i for i in range(200) if i % 7]
    parts = store.manifest()["parts"]
    assert store.expire(F.col("id") == 8) == 3 and sum(parts[k] != v for k, v in store.manifest()["parts"].items()) == 1
    assert store.expire(F.col("id") == 8) == 3  # nothing left to do, no version
    assert store.expire(F.lit(True)) == 4 and not store.manifest()["parts"] and not _dict(store.read()) and store.upsert(spark.range(1).select("id", F.lit("x").alias("v"))) == 5
    assert store.vacuum() > 0 and store.versions() == [5] and _dict(store.read()) == {0: "x"}


def test_the_later_of_two_writers_is_told(spark, store):
    late = KeyedStore(spark, store.path, ["id"], parts=8)
    stale = late.manifest()
    store.upsert(spark.range(1).select("id", F.lit("first").alias("v")))
    late.manifest = lambda version=None: stale
    with pytest.raises(StoreConflict):
        late.upsert(spark.range(1).select("id", F.lit("second").alias("v")))
    assert _dict(store.get(0)) == {0: "first"}


def test_a_lookup_reads_one_row_group(spark):
    s = KeyedStore(spark, shared_path(spark, "store"), ["id"], parts=4, row_group=64 << 10)
    s.upsert(spark.range(200_000).select("id", F.xxhash64("id").alias("v")))
    row = s.get(123_456)
    assert len(row.inputFiles()) == 1
    plan = row._jdf.queryExecution().executedPlan()
    assert row._jdf.queryExecution().executedPlan().executeCollect() and "PushedFilters: [IsNotNull(id), EqualTo(id,123456)]" in plan.toString().replace("], ReadSchema", "], ReadSchema")
    scan = plan
    while scan.children().size():
        scan = scan.children().head()
    rows = scan.metrics().get("numOutputRows").get().value()
    assert 0 < rows < 50_000 / 2  # of the 50,000 rows of its part


def test_matured_runs_read_no_later_months(spark):
    path = shared_path(spark, "runs")
    runs = spark.range(60).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 10).cast("int")).alias("created"), F.lit("A").alias("symbol"))
    rec.append_runs(runs, path)
    stored = spark.read.schema("id long, created date, symbol string, result string, run_month string").parquet(path)
    got = rec.matured(stored, F.to_date(F.lit("2024-06-15")))
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(60) if i * 10 < 136]
    assert "PartitionFilters: [isnotnull(run_month" in got._jdf.queryExecution().executedPlan().toString()
