"""What the corpus operators share: the shared folder, written tables, popcounts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local master gets a temporary folder (tests); a cluster
    gets an error, as executors would not see a machine-local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="twinsift-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(batch, name: str) -> list:
    """One column of an Arrow batch as Python objects."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def given_back(rows: Iterator) -> Iterator:
    """``rows``, and after them what this worker holds no more goes back to the system: workers stay for other tasks and stages."""
    yield from rows
    del rows
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until none of ``columns`` is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
