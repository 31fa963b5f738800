"""The metadata cache: versions of a Parquet snapshot, looked up, extended and purged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..schema import ALGORITHMS, CACHE_SCHEMA

_KEPT = ["width", "height", *ALGORITHMS]


def lookup(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """``scan`` (rel_path, mtime, size, ...) with what the cache holds, and hit: the same path, time and size."""
    held = cache.select(F.col("rel_path").alias("__p"), F.col("mtime").alias("__m"), F.col("size").alias("__s"), *(F.col(c) for c in _KEPT if c in cache.columns))
    on = (scan["rel_path"] == F.col("__p")) & (scan["mtime"] == F.col("__m")) & (scan["size"] == F.col("__s"))
    return scan.join(held, on, "left").withColumn("hit", F.col("__p").isNotNull()).drop("__p", "__m", "__s")


def upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace the cache's by path, in all columns; rows with an empty path are skipped."""
    sound = rows.where("rel_path is not null and rel_path <> ''")
    return cache.join(sound.select("rel_path"), "rel_path", "left_anti").unionByName(sound, allowMissingColumns=True)


def missing(cache: DataFrame, scan: DataFrame, listing: DataFrame) -> DataFrame:
    """Cached paths that neither this scan nor an unfiltered listing has; filtered rows survive."""
    return cache.join(scan.select("rel_path"), "rel_path", "left_anti").join(listing.select("rel_path"), "rel_path", "left_anti").select("rel_path")


def delete_paths(cache: DataFrame, paths: DataFrame) -> DataFrame:
    return cache.join(paths.select("rel_path").distinct(), "rel_path", "left_anti")


class SnapshotCache:
    """Versions v=1, v=2, ... under a folder; readers see the last whole one, and old ones stay until dropped.

    Batches of rows that are done are appended to the journal of the version they follow, where
    readers find them at once; the next version takes them in.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, prefix: str, folder: str) -> list[int]:
        """The numbers of the whole tables called so in a folder."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        fs, _ = self._fs()
        if not fs.exists(make(folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(make(folder))]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and fs.exists(make(f"{folder}/{n}/_SUCCESS")))

    def version(self) -> int:
        return max(self._numbers("v=", self.folder), default=0)

    def _journal(self, version: int) -> str:
        return f"{self.folder}/journal={version}"

    def load(self) -> DataFrame:
        """The rows of the last version, and of the batches since; of one path the latest."""
        now = self.version()
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(f"{self.folder}/v={now}") if now else self.spark.createDataFrame([], CACHE_SCHEMA)
        batches = self._numbers("batch=", self._journal(now))
        if not batches:
            return rows
        added = self.spark.read.schema(StructType([*CACHE_SCHEMA, StructField("batch", LongType())])).option("basePath", self._journal(now))
        added = added.parquet(*(f"{self._journal(now)}/batch={n}" for n in batches))
        last = F.row_number().over(Window.partitionBy("rel_path").orderBy(F.desc("batch")))
        return upsert(rows, added.withColumn("__last", last).where("__last = 1").drop("__last", "batch"))

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CACHE_SCHEMA))

    def append(self, rows: DataFrame) -> int:
        """Write one batch of rows, of distinct paths, to the journal."""
        journal = self._journal(self.version())
        number = max(self._numbers("batch=", journal), default=0) + 1
        self._shaped(rows).write.parquet(f"{journal}/batch={number}")
        return number

    def save(self, rows: DataFrame) -> int:
        version = self.version() + 1
        self._shaped(rows).write.parquet(f"{self.folder}/v={version}")
        return version

    def upsert(self, rows: DataFrame) -> int:
        return self.save(upsert(self.load(), rows))

    def delete(self, paths: DataFrame) -> int:
        return self.save(delete_paths(self.load(), paths))
