"""A sample of the registered queries against their DuckDB SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest

from quantloom.plans import all_queries

PICK = ["w1_sma", "w4_rsi", "w9_adx", "b1_position_returns", "b3_extract_trades", "j2_price_on", "j5_watch_status", "n1_news_score", "v1_folds", "g4_quality", "g8_dcf", "r1_block_bootstrap", "f12_horizon_bars", "u1_dedup_news", "f13_autorun_slot", "g10_implied_growth", "g13_valuation_score", "v9_expected_max_sharpe", "v13_validated_votes", "v14_strategy_report"]
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.mark.parametrize("name", PICK)
def test_same_rows(spark, sf, name):
    queries, sql = all_queries()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = queries[name](spark, sf).toPandas(), con.sql(sql[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            x, y = np.sort(a[c].to_numpy(float)), np.sort(b[c].astype(float).to_numpy())
            assert np.allclose(x, y, rtol=1e-7, atol=1e-9, equal_nan=True), c
        else:
            assert sorted(a[c].astype(str).str[:10]) == sorted(b[c].astype(str).str[:10]), c


def test_every_sql_has_a_query():
    queries, sql = all_queries()
    assert set(sql) <= set(queries) and len(queries) > 150
