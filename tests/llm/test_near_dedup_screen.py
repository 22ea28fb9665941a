"""The sketch screen of the exhaustive blocks, against the exact binomial tail."""

from math import comb

import pyarrow as pa
import pytest

from quantloom.llm import near_dedup
from quantloom.llm.queries import queries


@pytest.mark.parametrize("percent,fewest", [(85, 87), (80, 79)])
def test_screen_loss_at_the_threshold(percent, fewest):
    k, p = near_dedup._fewest_agreeing(percent), percent / 100
    loss = sum(comb(128, i) * p**i * (1 - p) ** (128 - i) for i in range(k))
    assert k == fewest and loss < 1e-6


@pytest.mark.parametrize("agreeing,linked", [(87, 1), (86, 0)])
def test_pairs_from_the_floor_on_are_compared(agreeing, linked):
    text = " ".join(f"w{i}" for i in range(60))
    a, b = bytes(256), bytes(2 * (agreeing)) + b"\1\0" * (128 - agreeing)
    columns = {"key": [b"k"] * 2, "band": [0] * 2, "home": [True, False], "loose": [False, True], "node": [b"a" * 16, b"b" * 16], "comp": [b"a" * 16, b"b" * 16], "n": [58] * 2, "sketch": [a, b], "text": [text] * 2}
    batch = pa.record_batch([pa.array(c) for c in columns.values()], names=list(columns))
    assert sum(x.num_rows for x in near_dedup._blocks(3, 85, 4)(iter([batch]))) == linked


def test_registered_query_at_the_threshold(spark, tmp_path):
    """Pairs with 85.0 to 85.4 % of their shingles in common are linked, pairs just below 85 % are not."""
    rows, linked = [], {}
    for k in range(1500):
        n = 110 + k % 5  # shingles; three changed words leave n - 9 of n + 9
        words = [f"w{k}x{i}" for i in range(n + 2)]
        other = [f"o{k}x{i}" if i in (20, 50, 80) else w for i, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        linked[k] = 100 * (n - 9) >= 85 * (n + 9)
    assert sum(linked.values()) == 1200
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["component_id"] for r in queries()["op4_minhash_near_dedup"](spark, str(tmp_path)).collect()}
    assert all(found[2 * k] == 2 * k and found[2 * k + 1] == 2 * k + (not ok) for k, ok in linked.items())
