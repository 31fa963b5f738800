"""Consecutive numbers in a global order, without one task that gets all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import materialised

_ROW = (1 << 33) - 1


def indexed(df: DataFrame, name: str, *keys: Column) -> DataFrame:
    """``df`` with 0, 1, 2, ... in the order of ``keys``.

    Rows are dealt to ranges, sorted there and written with their places. Bounds of ranges come
    from a sample that is drawn whenever the rows are dealt, so the numbers are only taken from
    what was written once: places and the sizes of ranges, which are added up in a table of one
    row for each range. ``df`` should hold no contents of files, as all its columns are written.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = materialised(dealt.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    held = placed.groupBy("__range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(F.broadcast(held.select("__range", before.alias("__before"))), "__range")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_ROW))).drop("__range", "__at", "__before")
