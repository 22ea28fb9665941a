"""Verdicts of scores that are the threshold but for the last bit of their sum."""

from itertools import permutations

from quantloom.operators import verdict as vd


def test_order_of_modules_does_not_decide(spark):
    parts = [("technical", 0.9, 0.11), ("regime", 0.8, -0.6), ("analogs", 1.0, -0.216)]  # -0.15 in exact numbers
    rows = [(k, "short", m, True, s, conf) for k, order in enumerate(permutations(parts)) for m, conf, s in order]
    modules = spark.createDataFrame(rows, "k int, horizon string, module string, available boolean, score double, confidence double").coalesce(1)
    got = vd.combine(modules, vd.weight_table(spark), ["k", "horizon"]).collect()
    num = 0.22 * 0.9 * 0.11 + 0.15 * 0.8 * -0.6 + 0.08 * 1.0 * -0.216
    assert {r["score"] for r in got} == {num / (0.22 + 0.15 + 0.08)} and {r["verdict"] for r in got} == {"hold"} and len(got) == 6
    assert set(got[0]["contributions"]) == {"technical", "regime", "analogs"}
