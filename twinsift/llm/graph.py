"""Connected components of large link tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """Name the component of every node of ``links`` (a long, b long): node, root.

    The root is some node of the component. Each round puts every node into the
    cluster of the least node among its neighbours and itself, in an order drawn
    anew by a hash, and goes on with the graph of clusters; a cluster's nodes all
    touch the node it is named after, so no component is joined or split, and at
    least about half of the nodes go each round. Minima are taken before rows are
    shuffled; no task needs a node's neighbours at once. Null ends and loops are
    dropped; no links give no rows.
    """
    edges = written(links.select("a", "b").where("a <> b"))
    roots, number = None, 0
    while not edges.isEmpty():
        rank = lambda node: F.struct(F.xxhash64(node, F.lit(number)).alias("rank"), F.col(node).alias("node"))  # noqa: B023, E731
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        heads = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("least"))
        heads = written(heads.select("node", F.least("least", rank("node")).getField("node").alias("head")))
        of_a, of_b = (heads.select(F.col("node").alias(end), F.col("head").alias(f"head_{end}")) for end in "ab")
        merged = edges.join(of_a, "a").join(of_b, "b").where("head_a <> head_b")
        edges = written(merged.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).distinct())
        if roots is None:
            roots = heads.withColumnRenamed("head", "root")
        else:
            step = heads.select(F.col("node").alias("root"), F.col("head").alias("next"))
            roots = written(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        number += 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false")
    return roots
