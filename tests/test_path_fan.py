"""Fans of paths: made by symbol, the same as those of the paths themselves and of the SQL."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import draws as dr
from quantloom.operators import resample as rs
from quantloom.plans import all_queries

PS = ["p5", "p25", "p50", "p75", "p95"]


def _bars(spark, sizes):
    rng = np.random.default_rng(9)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=k), float(x)) for s, n in sizes.items() for k, x in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))))]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def _drifts(bars):
    return rs.drift(bars.select("symbol").distinct().select("symbol", F.lit(0.03).alias("rf"), F.lit(1.0).alias("beta")))


def test_picks_of_blocks_are_those_of_single_steps():
    for n, salt in ((1, 5), (3, 987654321), (756, 4294967295)):
        want = []
        for path in (0, 7, 1999):
            at = 0
            for step in range(60):
                new = step == 0 or dr.uniform(11, salt, path, step, 1) % 10 == 0
                at = int(dr.uniform(11, salt, path, step, 2)) % n if new else (at + 1) % n
                want.append(at)
        assert dr.block_picks(n, np.array([0, 7, 1999]), 60, 10, 11, salt).reshape(-1).tolist() == want


def test_fan_of_a_symbol_is_that_of_its_paths(spark):
    bars = _bars(spark, {"A": 300, "B": 40, "C": 3})
    sizes = {"n_paths": 230, "horizon": 30}
    fan = rs.forward_fan(bars, _drifts(bars), **sizes).orderBy("symbol", "day").toPandas()
    want = rs.path_fan(rs.path_arrays(bars, _drifts(bars), **sizes)).orderBy("symbol", "day").toPandas()
    assert fan[["symbol", "day"]].equals(want[["symbol", "day"]]) and len(fan) == 3 * 7
    assert np.allclose(fan[PS], want[PS], rtol=1e-12, atol=0)


def test_fan_of_a_single_return_is_null(spark):
    bars = _bars(spark, {"A": 100, "B": 2, "C": 1})
    fan = rs.forward_fan(bars, _drifts(bars), n_paths=50, horizon=20)
    counts = {r["symbol"]: (r["days"], r["found"]) for r in fan.groupBy("symbol").agg(F.count("day").alias("days"), F.count("p50").alias("found")).collect()}
    assert counts == {"A": (5, 5), "B": (5, 0)}  # its variance is null, so is all that follows, as in the SQL


@pytest.mark.parametrize("name", ["a17_path_fan", "a17_path_fan_full"])
def test_fan_query_sends_no_path(spark, sf, name):
    queries, sql = all_queries()
    fan = queries[name](spark, sf)
    assert "Generate" not in fan._jdf.queryExecution().optimizedPlan().toString()  # no row for a path and day
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    a, b = (x.sort_values(["symbol", "day"]).reset_index(drop=True) for x in (fan.toPandas(), con.sql(sql[name]).df()))
    assert list(a.columns) == list(b.columns) and a["symbol"].equals(b["symbol"]) and a["day"].tolist() == b["day"].tolist()
    assert np.allclose(a[PS], b[PS], rtol=1e-9, atol=0)
