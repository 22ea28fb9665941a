"""Average ranks over any number of rows of a key, without gathering a key in one task.

Distinct values are counted first, so ties are one row.  Those rows are dealt out by ranges
of (keys, value) and written once, with the number of their range: every range is a task's
work, whichever key it belongs to.  A row's rank is what earlier ranges of its key hold (a
small table, a row for each range and key) and the running count within its own.  Ranks then
meet their rows again by an equal value, in a plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def value_ranks(rows: DataFrame, keys: list[str], values: list[str], ranges: int | None = None) -> DataFrame:
    """(keys, _of, _v, _rank): the average rank, from 1, of each distinct value of each of the columns `values`; nulls have none."""
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("_of"), F.col(v).cast("double").alias("_v")) for v in values]))
    counts = rows.select(*keys, cells.alias("_e")).select(*keys, "_e._of", "_e._v").where("_v is not null").groupBy(*keys, "_of", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counts.repartitionByRange(ranges, *keys, "_of", "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    group = [*keys, "_of"]
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy(*group, "_part").agg(F.sum("_n").alias("_t")).select(*group, "_part", before.alias("_before"))
    own = F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.select(*group, "_part", "_v", "_n", own.alias("_to")).join(parts, [*group, "_part"])
    return ranked.select(*group, "_v", (F.col("_before") + F.col("_to") - (F.col("_n") - 1) / 2).alias("_rank"))


def with_average_ranks(rows: DataFrame, keys: list[str], names: dict[str, str], ranges: int | None = None) -> DataFrame:
    """rows with the average rank of each column of names (column -> new name) within its keys; null where the column is."""
    ranks = value_ranks(rows, keys, list(names), ranges)
    for value, name in names.items():
        own = ranks.where(F.col("_of") == value).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_v", F.col("_rank").alias(name))
        same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
        rows = rows.join(own, [*same, F.col(value).cast("double") == F.col("_v")], "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])
    return rows
