"""Whitening against whole-number arithmetic and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import whitening
from quantloom.llm.queries import queries
from quantloom.llm.scratch import Scratch
from quantloom.llm.vectors import save_common, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, n long, x string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], SCHEMA).repartition(3)


def _whole(v, scale=1024, shift=100_000):
    return [math.floor(scale * c) + shift for c in v]


def _exact(vectors):
    x = [_whole(v) for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    return n, sums, [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(d)] for i in range(d)], x


def test_planes_give_products():
    rng = np.random.default_rng(3)
    bits = [5, 1, 0, 9, 20]
    y = np.stack([rng.integers(0, 1 << b, 1000) for b in bits], axis=1)
    group, weight = np.repeat(np.arange(5), bits), np.concatenate([1 << np.arange(b) for b in bits]).astype(np.int64)
    got = whitening.plane_products(whitening.bit_planes(y, bits), group, weight, 5)
    assert np.array_equal(got, np.triu(y.T @ y))


@pytest.mark.parametrize("spread", [1.0, 1e5, 1e14])
def test_covariance_is_exact(spark, spread):
    rng = np.random.default_rng(int(math.log10(spread)))
    rows = [(i, (rng.normal(size=5) * spread * [1, 0.5, 1e-3, 0, 1]).tolist()) for i in range(300)]
    table, d, _ = save_common(Scratch(spark, "test"), whole_vectors(_table(spark, rows), "vec_id", "embedding", 1024, 100_000), "whole")
    n, sums, centred, _ = whitening.exact_covariance(table, d)
    assert (n, sums, centred) == _exact([v for _, v in rows])[:3]


def test_rows_nulls_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=4).tolist()) for i in range(80)] + [(7, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.0]), (None, [0.0, -1.0, 0.5, 2.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    got = whitening.whiten(_table(spark, good + bad), components=3).collect()
    n, sums, centred, x = _exact([v for _, v in good])
    assert len(got) == 3 * n and {r["component"] for r in got} == {1, 2, 3} and all(r["n"] == n for r in got)
    assert not {r["vec_id"] for r in got} & set(range(100, 106))
    want = sorted(str((i, sum((n * c - s) ** 2 for c, s in zip(r, sums)))) for (i, _), r in zip(good, x))
    assert sorted(str((r["vec_id"], r["deviation"])) for r in got if r["component"] == 1) == want
    cov = np.array([[float(Fraction(v, n * n)) for v in row] for row in centred])
    values, axes = np.linalg.eigh(cov)
    for k in range(3):
        z = (np.array(x) - np.array(sums) / n) @ axes[:, -1 - k] / np.sqrt(values[-1 - k])
        own = {(r["vec_id"], r["deviation"]): r["whitened"] for r in got if r["component"] == k + 1}
        mine = {(i, sum((n * c - s) ** 2 for c, s in zip(r, sums))): v for (i, _), r, v in zip(good, x, z)}
        sign = 1 if abs(own[max(own, key=str)] - mine[max(own, key=str)]) < 1e-9 else -1
        assert all(abs(own[key] - sign * mine[key]) < 1e-9 for key in own)
        assert all(math.isclose(r["explained"], values[-1 - k] / np.trace(cov), rel_tol=1e-9) for r in got if r["component"] == k + 1)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_degenerate_tables(spark):
    assert not whitening.whiten(_table(spark, [(1, None)])).collect() and not whitening.whiten(_table(spark, [(1, [1.0])]).limit(0)).collect()
    same = whitening.whiten(_table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)
    line = whitening.whiten(_table(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    huge = whitening.whiten(_table(spark, [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 5.0])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] != 2)


def test_registered_query(spark, sf):
    got = queries()["op12_bit_sliced_whitening"](spark, sf)
    vectors = [(r[0], [float(c) for c in r[1]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect() if r[1] is not None]
    n, sums, centred, x = _exact([v for _, v in vectors])
    cov = np.array([[v / (n * n) for v in row] for row in centred])
    values = np.linalg.eigvalsh(cov)[::-1]
    rows = got.collect()
    want = {(i, sum((n * c - s) ** 2 for c, s in zip(r, sums))) for (i, _), r in zip(vectors, x)}
    assert len(rows) == 8 * n and {(r["vec_id"], r["deviation"]) for r in rows} == want
    assert all(math.isclose(r["explained"], values[r["component"] - 1] / np.trace(cov), rel_tol=1e-9) for r in rows) and rows[0]["identity_error"] < 1e-4
    w = np.zeros((8, n))
    place = {i: k for k, (i, _) in enumerate(vectors)}
    for r in rows:
        w[r["component"] - 1, place[r["vec_id"]]] = r["whitened"]
    assert np.abs(w @ w.T / n - np.eye(8)).max() < 1e-9
    assert got.select(F.countDistinct("identity_error")).first()[0] == 1
