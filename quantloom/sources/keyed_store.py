"""Tables of keyed rows that change in place: upserts, deletes, expiry and point lookups.

Rows lie in `parts` folders by the hash of their key.  A change reads and writes only the
parts that it touches, into folders of its own, and then names them in a manifest: a small
JSON file, the next in number, that says which folder holds each part.  Files never change,
so readers of a manifest see one version whatever is written meanwhile, older versions stay
readable until `vacuum`, and a lost task repeats its own files.  Two writers that start from
the same version race for the next number; the later one gets `StoreConflict` and starts
again.  (The number is taken by creating a file that must not exist, which file systems like
HDFS do atomically.)

Inside a part rows are sorted by key, in row groups of a bounded size with statistics and
bloom filters of the keys, so a lookup opens one part and reads the row groups that may hold
its key.  Null keys are keys; of rows of a delta with the same key the one with the largest
`order` stays (then the largest as JSON).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW_GROUP = 16 << 20


class StoreConflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int = 64, row_group: int = ROW_GROUP):
        self.spark, self.path, self.keys, self.parts, self.row_group = spark, path.rstrip("/"), keys, parts, row_group

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place, files = self._fs(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and the folder of each part; version 0 is empty."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "parts": {}}
        place, files = self._fs(f"{self.path}/manifest/{known[-1] if version is None else version:010d}.json")
        stream = files.open(place)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, base: dict, schema: StructType, changed: dict[str, str | None]) -> int:
        parts = {k: v for k, v in (base["parts"] | changed).items() if v is not None}
        place, files = self._fs(f"{self.path}/manifest/{base['version'] + 1:010d}.json")
        try:
            stream = files.create(place, False)
        except Exception as e:
            if files.exists(place):
                raise StoreConflict(f"version {base['version'] + 1} of {self.path} exists") from e
            raise
        stream.write(bytearray(json.dumps({"version": base["version"] + 1, "schema": json.loads(schema.json()), "parts": parts}).encode()))
        stream.close()
        return base["version"] + 1

    def _rows(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        folders = [f for k, f in manifest["parts"].items() if parts is None or int(k) in parts]
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else StructType()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def part_of(self, schema: StructType) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast(schema[k].dataType) for k in self.keys]), F.lit(self.parts)).cast("int")

    def _touched(self, rows: DataFrame, schema: StructType) -> list[int]:
        return sorted(r[0] for r in rows.select(self.part_of(schema)).distinct().collect())  # at most `parts`

    def _replace(self, base: dict, schema: StructType, rows: DataFrame, touched: list[int]) -> int:
        """Write rows as the whole of the touched parts."""
        own = uuid.uuid4().hex
        writer = rows.withColumn("_part", self.part_of(schema)).repartition(max(1, len(touched)), "_part").sortWithinPartitions("_part", *self.keys).write.partitionBy("_part")
        for k in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.option("parquet.block.size", self.row_group).option("compression", "zstd").parquet(f"{self.path}/data/{own}")
        place, files = self._fs(f"{self.path}/data/{own}")
        full = {f.getPath().getName() for f in files.listStatus(place)}
        return self._commit(base, schema, {str(k): f"{own}/_part={k}" if f"_part={k}" in full else None for k in touched})

    def _without(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        right = gone.select(*[F.col(k).alias(f"_gone{i}") for i, k in enumerate(self.keys)])
        same = [rows[k].eqNullSafe(right[f"_gone{i}"]) for i, k in enumerate(self.keys)]
        return rows.join(right, same, "left_anti")

    def upsert(self, delta: DataFrame, order: str | None = None) -> int:
        """Rows of delta replace those with their keys or are added; the new version (the old one for an empty delta)."""
        base = self.manifest()
        schema = StructType.fromJson(base["schema"]) if base["schema"] else delta.schema
        delta = delta.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        touched = self._touched(delta, schema)
        if not touched:
            return base["version"]
        by = [F.col(order).desc_nulls_last()] if order else []
        w = Window.partitionBy(*self.keys).orderBy(*by, F.to_json(F.struct(*delta.columns)).desc())
        single = delta.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        rows = self._without(self._rows(base, touched), single).unionByName(single) if base["schema"] else single
        return self._replace(base, schema, rows, touched)

    def delete(self, gone: DataFrame) -> int:
        """Rows with the keys of gone go."""
        base = self.manifest()
        if not base["schema"]:
            return base["version"]
        schema = StructType.fromJson(base["schema"])
        touched = [k for k in self._touched(gone, schema) if str(k) in base["parts"]]
        return self._replace(base, schema, self._without(self._rows(base, touched), gone), touched) if touched else base["version"]

    def expire(self, gone: Column) -> int:
        """Rows for which `gone` holds go; parts without such rows are left alone."""
        base = self.manifest()
        if not base["schema"]:
            return base["version"]
        schema, hit = StructType.fromJson(base["schema"]), F.coalesce(gone, F.lit(False))
        touched = self._touched(self._rows(base).where(hit), schema)
        return self._replace(base, schema, self._rows(base, touched).where(~hit), touched) if touched else base["version"]

    def get(self, *key, version: int | None = None) -> DataFrame:
        """The row with this key, from its part alone."""
        base = self.manifest(version)
        schema = StructType.fromJson(base["schema"]) if base["schema"] else None
        if schema is None:
            return self._rows(base)
        wanted = [F.lit(v).cast(schema[k].dataType) for k, v in zip(self.keys, key, strict=True)]
        part = self.spark.range(1).select(F.pmod(F.xxhash64(*wanted), F.lit(self.parts)).cast("int")).first()[0]
        rows = self._rows(base, [part])
        for k, v, given in zip(self.keys, wanted, key, strict=True):
            rows = rows.where(F.col(k).isNull() if given is None else F.col(k) == v)
        return rows

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the `keep` newest versions and delete the folders that only they had; the number of folders deleted."""
        known = self.versions()
        used = {f.split("/")[0] for v in known[-keep:] for f in self.manifest(v)["parts"].values()}
        for v in known[:-keep]:
            place, files = self._fs(f"{self.path}/manifest/{v:010d}.json")
            files.delete(place, False)
        place, files = self._fs(f"{self.path}/data")
        old = [f.getPath() for f in files.listStatus(place) if f.getPath().getName() not in used]
        for p in old:
            files.delete(p, True)
        return len(old)
