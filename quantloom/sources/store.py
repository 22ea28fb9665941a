"""Panels kept between queries: Parquet tables below the shared folder, versioned by what they are made from.

A version is a digest of the names, lengths and times of the input files, the code of this
package and the number of buckets.  A table that is complete is read; otherwise it is built,
written under a name of its own and then renamed, so readers see whole versions only and two
writers do no harm.  Tables with keys are bucketed by them and sorted inside buckets, so
groupings, windows and joins on those keys start without an exchange.  `drop_old` deletes what
no input has any more.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

MOST_BUCKETS = 4096
_PACKAGE = Path(__file__).resolve().parents[1]


@cache
def _code() -> str:
    """Digest of the package's own code, the training-data operators left out."""
    files = sorted(f for f in _PACKAGE.rglob("*.py") if "llm" not in f.relative_to(_PACKAGE).parts)
    return hashlib.sha1(b"".join(f.read_bytes() for f in files)).hexdigest()


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _inputs(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> list[str]:
    out = []
    for t in tables:
        folder, files = _path(spark, f"{sf_dir}/{t}.parquet")
        found = files.listStatus(folder) if files.exists(folder) else []
        out += sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in found)
    return out


def stored(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], build: Callable[[], DataFrame], keys: tuple[str, ...] = (), order: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """The table `name` made by build() from the input tables, bucketed by keys and sorted by keys and order.

    dealt tells that build() starts from a table kept by the same keys and moves no row, so no exchange goes before the buckets; a wrong word costs files, not rows.
    """
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    version = hashlib.sha1("\n".join([name, _code(), str(buckets), *keys, *order, *_inputs(spark, sf_dir, tables)]).encode()).hexdigest()[:20]
    root = f"{shared_folder(spark)}/panels/{name}"
    place, table = f"{root}/{version}", f"panel_{name}_{version}"
    folder, files = _path(spark, place)
    if not files.exists(folder):
        made, own = build(), f"{root}/.{version}-{uuid.uuid4().hex}"
        if keys:
            writer = (made if dealt else made.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys, *order)
            writer.option("compression", "zstd").option("path", own).format("parquet").saveAsTable(f"{table}_{uuid.uuid4().hex}")
        else:
            made.write.option("compression", "zstd").parquet(own)
        files.mkdirs(folder.getParent())
        if not files.exists(folder):
            files.rename(_path(spark, own)[0], folder)
    if not keys:
        return spark.read.parquet(place)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema.fields)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join([*keys, *order])}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(table)


def drop_old(spark: SparkSession, keep: int = 2) -> list[str]:
    """Delete all but the `keep` newest versions of each panel below the shared folder; the deleted paths."""
    root, files = _path(spark, f"{shared_folder(spark)}/panels")
    gone = []
    for panel in files.listStatus(root) if files.exists(root) else []:
        versions = sorted(files.listStatus(panel.getPath()), key=lambda f: -f.getModificationTime())
        for f in versions[keep:]:
            files.delete(f.getPath(), True)
            gone.append(str(f.getPath()))
    return gone
