"""Session helpers shared by all parts of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: for tables that several branches of a plan read.

    They stay until `release`, as nobody but the caller knows which results still read them.
    """
    path = shared_path(df.sparkSession, name)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that `written` made in this application, once their results are stored; their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, unless PYTHONPATH already does.

    Also turns off the reuse of a union's partitioning: in Spark 4.1.2 a grouping over
    a union of equally partitioned inputs can return a key twice when partitions are
    coalesced at run time (tests/test_signals.py has the case).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if str(_PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_quantloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._quantloom_shipped = True
