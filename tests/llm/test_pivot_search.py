"""Largest inner products against brute force."""

import math
import random

import numpy as np
import pytest

from quantloom.llm import pivot_search
from quantloom.llm.queries import queries

SCHEMA = "vec_id {}, embedding array<double>, score long, rank string"


def _whole(v, scale):
    return [math.floor(scale * c) for c in v]


def _brute(rows, asked, k, scale=256):
    x = [(i, _whole(v, scale)) for i, v in rows]
    out = []
    for q, v in asked:
        mine = _whole(v, scale)
        found = sorted((-sum(a * b for a, b in zip(mine, c)), i) for i, c in x if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def _frame(spark, rows, kind="long"):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA.format(kind)).repartition(3)


def _got(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect())


def _clustered(rng, n, spread=0.05, d=6):
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(8)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Many annuli, chunks and packets of a few rows."""
    monkeypatch.setattr(pivot_search, "ANNULUS_ROWS", 8)
    monkeypatch.setattr(pivot_search, "CHUNK_BYTES", 1)
    monkeypatch.setattr(pivot_search, "PACKET", 7)


def test_clusters_ties_and_copies(spark, small):
    rng = random.Random(2)
    rows = _clustered(rng, 900) + [(i, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(900, 1000)]
    asked = [r for r in rows if r[0] % 20 == 0]
    got = pivot_search.top_k(_frame(spark, rows), _frame(spark, asked), k=5)
    assert _got(got) == _brute(rows, asked, 5)


def test_bounds_leave_out_only_what_cannot_win(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5)) * 300
    x = np.floor(centres[rng.integers(0, 6, 4000)] + rng.normal(size=(4000, 5)) * 8)
    pivots = pivot_search.fit_pivots(x[:500], 6)
    d = pivot_search.distances(x, pivots)
    own = d.argmin(axis=1)
    r = d[np.arange(len(x)), own]
    ring = own * 4 + np.minimum(3, (r // 8).astype(int))
    number = np.unique(ring)
    each = [np.flatnonzero(ring == k) for k in number]
    known = pivot_search.Annuli(number, number // 4, *[np.array(v) for v in ([r[e].min() for e in each], [r[e].max() for e in each], [(x[e] ** 2).sum(axis=1).max() for e in each])])
    bound = pivot_search.score_bounds(x[:50], pivots, known)
    for k, e in enumerate(each):
        assert (bound[:, k, None] >= x[:50] @ x[e].T).all()
    fifth = np.sort(x[:50] @ x.T, axis=1)[:, -5]
    assert (bound >= fifth[:, None]).mean() < 0.6  # a good part of the annuli is never read


def test_nulls_odd_vectors_repeated_ids_and_types(spark, small):
    rng = random.Random(3)
    good = _clustered(rng, 60, d=4) + [(3, [0.5, 0.5, 0.5, 0.5]), (5, [9.0, 9.0, 9.0, 9.0])]
    bad = [(None, [9.0] * 4), (200, None), (201, []), (202, [1.0, None, 1.0, 1.0]), (203, [1.0, float("nan"), 1.0, 1.0]), (204, [9.0, 9.0]), (205, [float("-inf")] * 4)]
    asked = [r for r in good if r[0] in (3, 10, 20)]
    got = pivot_search.top_k(_frame(spark, good + bad), _frame(spark, asked + bad[:5]), k=3)
    least = min((v for i, v in asked if i == 3), key=lambda v: np.array(_whole(v, 256), "<i8").tobytes())
    assert _got(got) == _brute(good, [r for r in asked if r[0] != 3] + [(3, least)], 3)
    named = [(f"v{i:03}", v) for i, v in good[:60]]
    got = pivot_search.top_k(_frame(spark, named, "string"), _frame(spark, named[:4], "string"), k=4)
    assert _got(got) == _brute(named, named[:4], 4)


def test_few_rows_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert _got(pivot_search.top_k(_frame(spark, rows), _frame(spark, rows[:1]))) == [(0, 1, 2, 65536), (0, 2, 1, 0)]
    assert not pivot_search.top_k(_frame(spark, rows), _frame(spark, rows).limit(0)).collect()
    assert not pivot_search.top_k(_frame(spark, rows).limit(0), _frame(spark, rows)).collect()
    assert not pivot_search.top_k(_frame(spark, rows[:1]), _frame(spark, rows[:1])).collect()


@pytest.mark.parametrize("size", [1e4, 1e9, 1e17])
def test_large_entries_are_exact(spark, small, size):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-size, size) for _ in range(3)]) for i in range(40)]
    got = _got(pivot_search.top_k(_frame(spark, rows), _frame(spark, rows[:5]), k=5))
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    if size < 1e5:
        assert got == _brute(rows, rows[:5], 5)
    else:
        x = {i: [max(-(1 << 62), min(1 << 62, c)) for c in _whole(v, 256)] for i, v in rows}
        want = [(q, n + 1, i, -s) for q in range(5) for n, (s, i) in enumerate(sorted((-clip(sum(a * b for a, b in zip(x[q], x[i]))), i) for i in x if i != q)[:5])]
        assert got == sorted(want)


def test_registered_query(spark, sf):
    rows = [(r[0], [float(c) for c in r[1]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert _got(queries()["op13_pivot_distance"](spark, sf)) == _brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
