"""Exact deduplication against an index of historical digests.

The historical digests live in a minimal perfect hash that is split by digest
prefix into buckets of bounded size.  Each bucket is one row: the levels of the
hash (bit arrays whose ranks number the slots), the full 32-byte digests in slot
order, and the locator (doc_id) and count of each digest's winner.  A lookup
computes one slot and compares all 32 bytes there, so a digest outside the index
is never taken for a member.  Members are merged with the winner they hit;
nonmembers are grouped among themselves.

Defined results: null text counts as empty; of equal texts the largest doc_id
wins, null ids last (ids that are no whole numbers are ordered as strings); rows that repeat a doc_id and text share one decision; an
empty table gives an empty result; further columns are ignored by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

BUCKET_DIGESTS = 50_000
_LEVELS = 48
_INDEX = "bucket long, n long, sizes array<long>, bits binary, digests binary, locators binary, counts binary"
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _prefix(digests: np.ndarray) -> np.ndarray:
    return digests.view(">u8").reshape(len(digests), 4)[:, 1].astype(np.uint64)


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    from .text_arrays import mix64

    return mix64(x ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def build_bucket(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(level sizes, all levels' bits, slot of each digest) for distinct digests uint8[n, 32].

    At each level a digest whose position no other one shares takes it; the others
    go on.  Whatever is left after the last level is kept in slots behind the
    ranked ones and found by comparing bytes.
    """
    keys = _prefix(np.ascontiguousarray(digests))
    left, sizes, levels, slots, taken = np.arange(len(keys)), [], [], np.zeros(len(keys), np.int64), 0
    for level in range(_LEVELS):
        if not len(left):
            break
        size = 2 * len(left)
        at = (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        won = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[won]] = taken + rank[at[won]]
        taken += int(alone.sum())
        sizes.append(size)
        levels.append(alone)
        left = left[~won]
    slots[left] = taken + np.arange(len(left))
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool), slots


def find_slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The slot of each digest, or -1 where the byte check fails."""
    keys = _prefix(np.ascontiguousarray(digests))
    slots, left, start, taken = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, 0
    for level, size in enumerate(sizes):
        alone = bits[start : start + size]
        rank = np.cumsum(alone) - 1
        at = (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
        hit = alone[at]
        slots[left[hit]] = taken + rank[at[hit]]
        taken, start, left = taken + int(alone.sum()), start + size, left[~hit]
    tail = {table[i].tobytes(): i for i in range(taken, len(table))}
    for i in left:
        slots[i] = tail.get(digests[i].tobytes(), -1)
    found = slots >= 0
    found[found] = (table[slots[found]] == digests[found]).all(axis=1)
    return np.where(found, slots, -1)


def _rows_of(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), 32)


def _packed(winners: pd.Series) -> bytes:
    """Locators as bytes: eight for each whole number, else a JSON list of strings."""
    return winners.to_numpy(np.int64).tobytes() if winners.dtype.kind == "i" else json.dumps([None if pd.isna(w) else w for w in winners]).encode()


def _later(own: pd.Series, locators: bytes, slots: np.ndarray) -> list | np.ndarray:
    """The larger of each incoming winner and the historical one in its slot; null is least."""
    if own.dtype.kind == "i":
        return np.maximum(own.to_numpy(np.int64), np.frombuffer(locators, np.int64)[slots])
    old = json.loads(locators)
    pairs = zip([None if pd.isna(w) else w for w in own], [old[s] for s in slots], strict=True)
    return [max(p, key=lambda w: (w is not None, w or "")) for p in pairs]


def _index_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _rows_of(rows["digest"])
    sizes, bits, slots = build_bucket(digests)
    order = np.argsort(slots)
    return pd.DataFrame(
        {
            "bucket": [int(rows["bucket"].iloc[0])],
            "n": [len(rows)],
            "sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [digests[order].tobytes()],
            "locators": [_packed(rows["winner"].iloc[order])],
            "counts": [rows["n"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def _probe_bucket(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    rows = rows.reset_index(drop=True)
    out = pd.DataFrame({"digest": rows["digest"], "winner": rows["winner"], "n": rows["n"], "member": False})
    if len(rows) and len(index):
        entry = index.iloc[0]
        table = np.frombuffer(entry["digests"], np.uint8).reshape(-1, 32)
        sizes = [int(x) for x in entry["sizes"]]
        bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8))[: sum(sizes)].astype(bool)
        slots = find_slots(_rows_of(rows["digest"]), sizes, bits, table)
        hit = slots >= 0
        out.loc[hit, "winner"] = _later(rows["winner"][hit], entry["locators"], slots[hit])
        out.loc[hit, "n"] = rows["n"].to_numpy(np.int64)[hit] + np.frombuffer(entry["counts"], np.int64)[slots[hit]]
        out["member"] = hit
    return out


_NO_ID = -(1 << 63)


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long"), F.lit(buckets))


def distinct_digests(keyed: DataFrame) -> DataFrame:
    """(digest, winner, n): each digest once, combined on the map side first."""
    whole = keyed.schema["doc_id"].dataType.simpleString() in _INTEGERS
    winner = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) if whole else F.col("doc_id").cast("string")
    return keyed.groupBy("digest").agg(F.max(winner).alias("winner"), F.count(F.lit(1)).alias("n"))


def build_index(distinct: DataFrame, buckets: int) -> DataFrame:
    """The minimal perfect hash of (digest, winner, n) rows, a row for each bucket."""
    return distinct.withColumn("bucket", _bucket(F.col("digest"), buckets)).groupBy("bucket").applyInPandas(_index_bucket, _INDEX)


def probe_index(distinct: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(digest, winner, n, member): incoming distinct digests merged with the historical winners they hit."""
    incoming = distinct.withColumn("bucket", _bucket(F.col("digest"), buckets))
    return (
        incoming.groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(_probe_bucket, f"digest binary, winner {distinct.schema['winner'].dataType.simpleString()}, n long, member boolean")
    )


def save_index(index: DataFrame, path: str, buckets: int) -> None:
    """Write an index as a version of its own, named by its bucket count and a number that grows."""
    spark = index.sparkSession
    newest = index_versions(spark, path)
    index.write.option("compression", "zstd").parquet(f"{path}/version={max(newest, default=0) + 1}-of-{buckets}")


def index_versions(spark: SparkSession, path: str) -> dict[int, int]:
    """version -> number of buckets of the indexes below a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return {int(v): int(b) for v, b in (n.removeprefix("version=").split("-of-") for n in names if n.startswith("version="))}


def load_index(spark: SparkSession, path: str, buckets: int | None = None, version: int | None = None) -> DataFrame:
    """A saved index, by default the newest; its bucket count must be that of the lookups."""
    known = index_versions(spark, path)
    version = max(known) if version is None else version
    if buckets is not None and known[version] != buckets:
        raise ValueError(f"index version {version} has {known[version]} buckets, not {buckets}")
    return spark.read.schema(_INDEX).parquet(f"{path}/version={version}-of-{known[version]}")


def drop_known(docs: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """The rows of docs whose texts no saved index at `path` holds, all columns kept; repeats within docs stay."""
    spark = docs.sparkSession
    known = index_versions(spark, path)
    buckets = known[max(known) if version is None else version]
    scratch = Scratch(spark, "exact")
    own = docs.select(F.lit(None).cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    members = probe_index(distinct_digests(own), load_index(spark, path, version=version), buckets).where("member").select(F.col("digest").alias("known"))
    members = scratch.save(members, "members")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(members, text_digest(F.col("row.text")) == F.col("known"), "left_anti").select("row.*")


def exact_duplicates(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, digest, keep_id, group_size, kept.

    `is_history` tells the rows whose digests form the index (default: about half of
    them, by a hash of the doc_id as text, so ids may be of any type); which rows it
    names changes the way, not the result.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    half = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    history = F.coalesce(is_history if is_history is not None else half, F.lit(False))
    keyed = scratch.save(docs.select("doc_id", text_digest(F.col("text")).alias("digest"), history.alias("history")), "keyed")
    old = scratch.save(distinct_digests(keyed.where("history")), "old")
    new = scratch.save(distinct_digests(keyed.where("not history")), "new")
    buckets = max(1, -(-max(old.count(), new.count()) // BUCKET_DIGESTS))  # bounds both sides of a cogroup
    save_index(build_index(old, buckets), scratch.path("index"), buckets)
    probed = scratch.save(probe_index(new, load_index(docs.sparkSession, scratch.path("index"), buckets), buckets), "probed")
    untouched = old.join(probed.where("member").select("digest"), "digest", "left_anti")
    groups = scratch.save(untouched.select("digest", "winner", "n").unionByName(probed.select("digest", "winner", "n")), "groups")
    scratch.drop("old", "new", "index", "probed")
    kind = docs.schema["doc_id"].dataType
    keep_id = (F.when(F.col("winner") != _NO_ID, F.col("winner")) if kind.simpleString() in _INTEGERS else F.col("winner")).cast(kind)
    return keyed.join(groups, "digest").select(
        "doc_id", "digest", keep_id.alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept")
    )


def keep_winners(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns kept; of rows that also share the winner's doc_id, one."""
    from pyspark.sql import Window

    marks = exact_duplicates(docs).where("kept")
    winners = marks.groupBy("digest").agg(F.first("keep_id").alias("_keep_id"), F.count(F.lit(1)).alias("_ties")).withColumnRenamed("digest", "_digest")
    winners = Scratch(docs.sparkSession, "exact").save(winners, "winners")
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so no name can clash
    rows = rows.join(winners, (text_digest(F.col("row.text")) == F.col("_digest")) & F.col("row.doc_id").eqNullSafe(F.col("_keep_id")))
    order = Window.partitionBy("_digest").orderBy(*[F.col(f"row.{c}").asc_nulls_last() for c in docs.columns if c != "text"])
    single = rows.where("_ties = 1").select("row.*")
    tied = rows.where("_ties > 1").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("row.*")
    return single.unionByName(tied)
