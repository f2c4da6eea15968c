"""A keyed table on plain parquet files that upserts change in numbered versions.

Rows are dealt into a fixed number of buckets by the hash of their key. An upsert compares its
rows with the table, rewrites the buckets in which something differs into a new folder, and then
commits: one small file per version names the folder of every bucket. That file is the only
thing readers look at, and it is created only if it does not exist, so a run that dies half way
leaves the version before it as it was, and of two writers one has to start again. Folders of
older versions stay and can be read by number.

A version also names the run that made it. A run that is repeated after its commit changes
nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

ATTEMPTS = 5       # times an upsert starts again when another writer was first
RUNS_KEPT = 1000   # runs that a version remembers


class VersionedTable:
    """``VersionedTable(spark, path)`` is the table below ``path``; ``create`` makes one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, run: str, buckets: int = 64) -> VersionedTable:
        """Version 1 from ``rows``, which have one row per key and no NULL key."""
        table = cls(rows.sparkSession, path)
        folders = table._write(rows, key, buckets)
        table._commit({
            "version": 1, "run": run, "runs": [run], "key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": folders, "rewritten": len(folders)})
        return table

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of a given one."""
        return self._rows(self.manifest(version))

    def version(self) -> int:
        return self.manifest()["version"]

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of. Commit files that were begun and never finished are
        passed over."""
        for number in [version] if version else sorted(self._numbers(), reverse=True):
            found = self._parse(number)
            if found:
                return found
        raise FileNotFoundError(f"no version of {self.path}" if version is None else f"no version {version} of {self.path}")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = manifest["folders"]
        paths = [f"{self.path}/{folders[b]}/bucket={b}" for b in (folders if buckets is None else map(str, buckets)) if b in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writing

    def upsert(self, changes: DataFrame, run: str, insert: bool = True) -> int:
        """Change the table by key and return its version.

        ``changes`` has the key and any of the other columns; only these are set. Rows with a
        new key are added with NULL in the other columns, or with ``insert=False`` left out.
        Rows without a key are left out, of several rows with one key the largest counts.
        """
        for _ in range(ATTEMPTS):
            before = self.manifest()
            if run in before["runs"]:
                return before["version"]
            after = self._prepare(before, changes, run, insert)
            if self._commit(after):
                return after["version"]
        raise RuntimeError(f"{self.path}: {ATTEMPTS} attempts met other writers")

    def _prepare(self, before: dict, changes: DataFrame, run: str, insert: bool) -> dict:
        """Write what the changes touch, and say what the next version consists of."""
        key, buckets = before["key"], before["buckets"]
        columns = StructType.fromJson(json.loads(before["schema"]))
        set_ = [c for c in changes.columns if c != key]
        given = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*set_)).alias("_new"))
        now = self._rows(before).withColumn("_there", F.lit(True))
        differs = F.lit(False)
        for c in set_:
            differs = differs | ~F.col(f"_new.{c}").eqNullSafe(F.col(f"t.{c}"))
        known = F.coalesce(F.col("t._there"), F.lit(False))
        wanted = (known & differs) | ~known if insert else known & differs
        real = given.alias("g").join(now.alias("t"), key, "left").filter(wanted).select(F.col(key), "_new")
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        real.withColumn("bucket", bucket_of(key, buckets)).write.parquet(draft)
        real = self.spark.read.parquet(draft)
        # there are no more rows than buckets
        touched = sorted(r.bucket for r in real.select("bucket").distinct().collect())
        folders = dict(before["folders"])
        if touched:
            value = lambda f: F.when(F.col("_new").isNotNull(), F.col(f"_new.{f.name}")).otherwise(F.col(f.name)) if f.name in set_ else F.col(f.name)
            merged = self._rows(before, touched).join(real.drop("bucket"), key, "full").select(*[value(f).cast(f.dataType).alias(f.name) for f in columns])
            folders |= self._write(merged, key, buckets)
        version = max([before["version"], *self._numbers()]) + 1
        return before | {
            "version": version, "run": run, "runs": [*before["runs"], run][-RUNS_KEPT:], "folders": folders, "rewritten": len(touched)}

    def _write(self, rows: DataFrame, key: str, buckets: int) -> dict[str, str]:
        """A new folder of buckets, not yet part of any version."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        here = [s.getPath().getName() for s in self._files().listStatus(self._hadoop(f"{self.path}/{folder}")) if s.isDirectory()]
        return {name.removeprefix("bucket="): folder for name in here}

    # commit files

    def _commit(self, manifest: dict) -> bool:
        """Whether the version is now there; False if its number was taken."""
        target = self._hadoop(f"{self.path}/versions/{manifest['version']:012d}.json")
        try:
            out = self._files().create(target, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        try:
            out.write(bytearray(json.dumps(manifest | {"complete": True}).encode()))
        finally:
            out.close()
        return True

    def _numbers(self) -> list[int]:
        files, folder = self._files(), self._hadoop(f"{self.path}/versions")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return [int(name.removesuffix(".json")) for name in names if name.endswith(".json")]

    def _parse(self, number: int) -> dict | None:
        files, target = self._files(), self._hadoop(f"{self.path}/versions/{number:012d}.json")
        if not files.exists(target):
            return None
        stream = files.open(target)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if found.get("complete") else None

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
