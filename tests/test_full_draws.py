"""Resampling queries at the full number of draws, against brute force."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators import validation as va
from quantloom.plans import all_queries
from quantloom.plans import q_validation as qv
from quantloom.plans.registry import Panels


def _draw(seed, *parts):
    h = seed
    for p in parts:
        h = (h * 1103515245 + p * 12345 + 1013904223) % 2147483647 * 48271 % 2147483647
    return h


def test_full_queries_are_registered_with_the_same_sql():
    queries, sql = all_queries()
    names = {"v5_permutation_p", "v6_random_day_p", "v7_trade_bootstrap", "r1_block_bootstrap", "r2_forward_paths", "a16_path_summary", "a17_path_fan", "r4_first_touch"}
    assert {f"{n}_full" for n in names} <= set(queries) and all(sql[f"{n}_full"] == sql[n] for n in names)


def test_thousand_shifts(spark):
    rng = np.random.default_rng(3)
    held, close = (rng.random(150) < 0.5).astype(float), 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150)))
    rows = spark.createDataFrame([("A", "s", i, float(h), float(x)) for i, (h, x) in enumerate(zip(held, close, strict=True))], "symbol string, strategy string, i int, held double, close double")
    mkt = np.concatenate([[0.0], close[1:] / close[:-1] - 1])

    def sr(h):
        r = h * mkt + (1 - h) * 0.0001 - 0.0005 * np.abs(h - np.concatenate([h[:1], h[:-1]]))
        return round((r.mean() - 0.0001) / r.std(ddof=1), 9)

    sims = [sr(np.roll(held, 20 + _draw(7, k) % 110)) for k in range(1, 1001)]
    assert va.permutation_p(rows).first()["p"] == (1 + sum(s >= sr(held) for s in sims)) / 1001


def test_two_thousand_paths(spark, sf):
    queries = all_queries()[0]
    sizes = {r["symbol"]: r["n"] for r in qv._sizes(Panels(spark, sf)).collect()}
    picks = queries["r1_block_bootstrap_full"](spark, sf)
    assert picks.count() == len(sizes) * 2000 * 252
    symbol, n = sorted(sizes.items())[0]
    want, at = [], 0
    for step in range(252):
        salt = zlib.crc32(symbol.encode())
        at = _draw(11, salt, 1999, step, 2) % n if step == 0 or _draw(11, salt, 1999, step, 1) % 10 == 0 else (at + 1) % n
        want.append(at)
    assert [r["pick"] for r in picks.where((F.col("symbol") == symbol) & (F.col("path") == 1999)).orderBy("step").collect()] == want

    ends = queries["r2_forward_paths_full"](spark, sf).where(f"symbol = '{symbol}' and step = 251").toPandas()["growth"].to_numpy() - 1
    got = queries["a16_path_summary_full"](spark, sf).where(f"symbol = '{symbol}' and horizon = 'long'").first()
    assert len(ends) == 2000 and np.isclose(got["cvar95"], -np.sort(ends)[:100].mean()) and np.isclose(got["p5"], np.quantile(ends, 0.05))


def test_shifts_send_each_array_once(spark):
    """Arrays are dealt out once a key, not once for every block of shifts; short and constant keys have no p."""
    rng = np.random.default_rng(5)
    rows = [("A", s, i, float(h), float(x)) for s, n in (("long", 200), ("short", 119)) for i, (h, x) in enumerate(zip(rng.random(n) < 0.5, 100 + rng.random(n), strict=True))]
    rows += [("A", "still", i, 1.0, 100.0 + i) for i in range(150)]
    found = va.permutation_p(spark.createDataFrame(rows, "symbol string, strategy string, i int, held double, close double"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and {r["strategy"] for r in found.collect() if r["p"] is None} == {"short", "still"}
