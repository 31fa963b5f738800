"""Digests as a stream: completed batches are in the cache before the next begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.order import indexed
from ..operators.stage import materialised
from ..schema import ERROR_DIGEST

BATCH_FILES = 1000


def in_batches(pending: DataFrame, work: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], object], rows: int = BATCH_FILES, cancelled: Callable[[], bool] = lambda: False) -> bool:
    """Do ``work`` on ``pending`` (with idx) in batches of ``rows`` and hand each to ``done`` before the next begins; False if cancelled between.

    A batch is a whole job: on a cluster ``rows`` should be many times its cores.
    """
    count = pending.count()
    if count <= rows:
        batches = [pending] if count else []
    else:
        places = materialised(indexed(pending, "__place", F.col("idx")))
        batches = [places.where(F.col("__place").between(first, first + rows - 1)).drop("__place") for first in range(0, count, rows)]
    for batch in batches:
        if cancelled():
            return False
        done(work(batch))
    return not cancelled()


def digest_stream(spark: SparkSession, source: str, schema: StructType, sink: str, state: str, files_per_batch: int = BATCH_FILES) -> StreamingQuery:
    """Read rows (rel_path, mtime, size, content) from Parquet files as they come, ``files_per_batch`` of these at once, and append their digests to ``sink``.

    A restart goes on after the last batch that is whole; reading ``sink`` by :func:`latest`
    makes a batch that ran twice count once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    digest = F.coalesce(F.md5(F.col("content").cast("binary")), F.lit(ERROR_DIGEST))
    done = rows.select("rel_path", "mtime", "size", digest.alias("md5"))

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return done.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest(cached: DataFrame) -> DataFrame:
    """The last row of each path, by batch and then time."""
    rank = F.row_number().over(Window.partitionBy("rel_path").orderBy(F.desc("batch"), F.desc("mtime")))
    return cached.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "batch")
