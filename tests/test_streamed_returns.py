"""Returns and trades made from the wide table against those of the stacked rows."""

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators import accounting as acc
from quantloom.operators import validation as va
from quantloom.plans.q_market import all_returns, all_trades
from quantloom.plans.registry import Panels


def test_rows_of_variants_are_never_shuffled(spark, sf):
    t = Panels(spark, sf)
    figures = t.returns.groupBy(*acc.KEYS).agg(F.sum("ret"))
    plan = figures._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" not in plan and plan.count("Generate explode") == 1


def test_same_returns_trades_and_folds(spark, sf):
    t = Panels(spark, sf)
    order = [*acc.KEYS, "date"]
    a, b = (x.select(*order, "held", "ret").toPandas().sort_values(order).reset_index(drop=True) for x in (t.returns, all_returns(t)))
    assert a[order].equals(b[order]) and np.allclose(a["held"], b["held"]) and np.allclose(a["ret"], b["ret"], atol=1e-14)
    order = [*acc.KEYS, "entry"]
    cols = [*order, "exit", "entry_px", "exit_px", "days", "is_open", "ret"]
    a, b = (x.select(*cols).toPandas().sort_values(order).reset_index(drop=True) for x in (t.trades, all_trades(t)))
    assert len(a) == len(b) > 0 and a[[*order, "exit", "days", "is_open"]].equals(b[[*order, "exit", "days", "is_open"]])
    assert all(np.allclose(a[x], b[x]) for x in ("entry_px", "exit_px", "ret"))
    keys = ["symbol", "strategy", "fold", "variant", "date"]
    stitched = t.oos.select(*keys, "ret").toPandas().sort_values(keys).reset_index(drop=True)
    joined = va.walk_forward(all_returns(t), va.folds(t.bars)).select(*keys, "ret").toPandas().sort_values(keys).reset_index(drop=True)
    assert stitched["ret"].size > 0 and stitched[keys].astype(str).equals(joined[keys].astype(str)) and np.allclose(stitched["ret"], joined["ret"])
