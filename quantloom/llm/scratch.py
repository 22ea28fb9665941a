"""Intermediate tables in the cluster's shared folder.

Lineage is cut by writing Parquet below `spark.checkpoint.dir`, which driver and
executors share, so a lost executor costs a reread and never a recomputation.
A folder of our own is set only where the session names none (local tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package


class Scratch:
    """Named intermediate tables of one run of an operator."""

    def __init__(self, spark: SparkSession, operator: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, limit: int) -> bool:
    """Whether the strings and numbers of a table take at most `limit` bytes, rows counted with 64 bytes each."""
    sizes = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema.fields]
    total = df.agg(F.sum(sum(sizes, F.lit(64)).cast("long"))).first()[0]
    return (total or 0) <= limit


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most `rows` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows
