"""Keyed tables of which a change rewrites only the buckets it touches.

Rows lie in buckets by the hash of their keys. Every change is a version: it writes the touched buckets anew, and a list of which version of each bucket holds.
Files of other buckets stay as they are, readers of an older version are not disturbed, and a version that is there already is not written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.tables import latest

BUCKETS = 64


class BucketedTable:
    """A table at ``path`` with the columns of ``schema`` and unique ``keys``. The number of buckets is fixed with the first version; lists of buckets are
    as long as that number, whatever the table's size."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Versions that are complete, in order."""
        fs, path = self._fs()
        at = path(f"{self.path}/manifest")
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(path(p, "_SUCCESS")))

    def _held(self, version: int | None) -> dict[int, int]:
        """The version that holds each bucket."""
        if version is None:
            return {}
        return {r.bucket: r.held for r in self.spark.read.schema("bucket int, held long").parquet(f"{self.path}/manifest/version={version}").collect()}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last one."""
        done = self.versions()
        at = version if version is not None else (done[-1] if done else None)
        return self._rows({} if at is None else self._held(at))

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _change(self, keys: DataFrame, new: DataFrame | None, version: int | None) -> int:
        done = self.versions()
        version = (done[-1] + 1 if done else 0) if version is None else version
        if version in done:
            return version
        before = [v for v in done if v < version]
        held = self._held(before[-1]) if before else {}
        touched = sorted(r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect())
        old = self._rows({b: held[b] for b in touched if b in held})
        rest = old.join(keys.select(*self.keys).distinct(), reduce(lambda x, y: x & y, (old[k].eqNullSafe(keys[k]) for k in self.keys)), "left_anti")
        rows = rest if new is None else rest.unionByName(new.select(*self.schema.names))
        if touched:
            out = rows.withColumn("bucket", self.bucket())
            out.repartition(len(touched), "bucket").sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        fs, path = self._fs()
        written = {b: version for b in touched if fs.exists(path(f"{self.path}/data/version={version}/bucket={b}"))}
        listed = {b: v for b, v in held.items() if b not in touched} | written  # a bucket that lost all its rows is not listed
        self.spark.createDataFrame(sorted(listed.items()), "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version

    def upsert(self, new: DataFrame, order: str | None = None, version: int | None = None) -> int:
        """Rows of ``new`` replace those of equal keys, null keys included; of several with one key the latest counts (``tables.latest``). With a version
        number that is complete already nothing is done, so a change that is tried again changes nothing."""
        last = latest(new, self.keys, order)
        return self._change(last, last, version)

    def delete(self, ids: DataFrame, version: int | None = None) -> int:
        return self._change(ids.select(*self.keys).distinct(), None, version)

    def drop(self, version: int | None = None) -> int:
        """The table without its rows: a version that lists no bucket."""
        done = self.versions()
        version = (done[-1] + 1 if done else 0) if version is None else version
        if version not in done:
            self.spark.createDataFrame([], "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Remove versions but the last ``keep``, and the data that none of them holds."""
        done = self.versions()
        used = {v for at in done[-keep:] for v in self._held(at).values()}
        fs, path = self._fs()
        for v in done[:-keep]:
            fs.delete(path(f"{self.path}/manifest/version={v}"), True)
        at = path(f"{self.path}/data")
        for s in fs.listStatus(at) if fs.exists(at) else []:
            if int(s.getPath().getName().split("=")[1]) not in used and int(s.getPath().getName().split("=")[1]) <= (done[-1] if done else -1):
                fs.delete(s.getPath(), True)
