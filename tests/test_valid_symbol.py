"""The rule of symbols against its SQL, on letters whose upper case is longer, line ends and spaces of other kinds."""

import duckdb
from pyspark.sql import functions as F

from quantloom.functions.scalars import valid_symbol

TEXTS = ["AAPL", " brk.b ", "^gspc", "straße", "weiß", "ﬁx", "A\n", "A\r", "A ", "A ", "　A", "A B", "ıb", "ſ", "é", "", " ", "-A", "ABCDEFGHIJKLMNO", "ABCDEFGHIJKLMNOP", "A\tB"]


def test_symbols_as_in_sql(spark):
    got = spark.createDataFrame([(k, x) for k, x in enumerate(TEXTS)], "k int, t string").select("k", valid_symbol(F.col("t")).alias("ok")).orderBy("k").collect()
    con = duckdb.connect()
    want = [con.execute("select regexp_matches(upper(trim(?)), '^[A-Z0-9][A-Z0-9.\\-^=]{0,14}$')", [x]).fetchall()[0][0] for x in TEXTS]
    assert [r["ok"] for r in got] == want
