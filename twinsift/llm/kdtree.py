"""Exact top-k search by inner product: KD-trees per shard, searched best first.

A coarse tree of median splits, made from a bounded sample, cuts space into regions; a region's
vectors are a shard, or several of bounded size. Each shard's tree splits at medians and keeps the
tight bounding box of every node. A box bounds a query's inner product with what it holds, so
boxes are visited from the best bound on, until no box can reach the kth best score. Each query
first searches its own shard; its kth score there is the bar for all others. Against that, the
tight boxes of the regions tell which shards a query has to be sent to at all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written
from .lattice import proper

#: Vectors in a shard and queries in a group, about; they bound what a task holds.
SHARD, QUERIES = 8192, 4096
LEAF = 64
#: Regions at most, and sampled vectors for each: what the driver splits, and the boxes that every task gets.
REGIONS, SAMPLED = 1024, 64

_FOUND = "query_id long, vec_id long, score long"


class KDTree:
    """Nodes as arrays: the box (low, high), the children (-1 in leaves) and the rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        low, high, children, rows = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            part = points[order[start:stop]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            children.append([-1, -1])
            rows.append((start, stop))
            if parent >= 0:
                children[parent][side] = len(low) - 1
            spread = high[-1] - low[-1]
            if stop - start > leaf and spread.max() > 0:
                along = int(spread.argmax())
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(part[:, along], middle)]
                todo += [(start, start + middle, len(low) - 1, 0), (start + middle, stop, len(low) - 1, 1)]
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)
        self.children, self.rows = children, rows

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No point of a node scores more: queries x nodes."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, bar: float) -> list[tuple[int, int]]:
        """Up to k (score, -id), best first, ties to the smaller id, none below ``bar``; not the row ``own``."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < bar:
                break
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= bar:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            for start in range(*self.rows[node], 4096):
                stop = min(start + 4096, self.rows[node][1])
                scores = self.points[start:stop] @ query
                for at in np.flatnonzero(scores >= bar).tolist():
                    found = (int(scores[at]), -int(self.ids[start + at]))
                    if found[1] == -own or len(best) == k and found <= best[0]:
                        continue
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, found)
                    if len(best) == k:
                        bar = max(bar, best[0][0])
        return sorted(best, reverse=True)


def _matrix(vectors: pa.Array | pa.ChunkedArray | list, width: int) -> np.ndarray:
    """Rows of doubles, shorter ones filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if isinstance(vectors, pa.Array):
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        if len(flat) == len(vectors) * width:
            return flat.reshape(len(vectors), width)
        vectors = vectors.to_pylist()
    out = np.zeros((len(vectors), width))
    for at, row in enumerate(vectors):
        out[at, : len(row)] = row
    return out


def _searcher(k: int):
    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if points.num_rows and queries.num_rows:
            width = max(pc.max(pc.list_value_length(t["vector"])).as_py() for t in (points, queries)) or 1
            tree = KDTree(_matrix(points["vector"], width), points["vec_id"].to_numpy())
            bars = queries["bar"].to_pylist()
            ids = queries["vec_id"].to_pylist()
            for first in range(0, len(ids), 256):
                block = _matrix(queries["vector"].slice(first, 256), width)
                for at, (query, bounds) in enumerate(zip(block, tree.bounds(block)), first):
                    bar = -np.inf if bars[at] is None else bars[at]
                    for score, minus_id in tree.search(query, bounds, ids[at], k, bar):
                        for to, value in zip(found, (ids[at], -minus_id, score)):
                            to.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class Regions:
    """A complete tree of median splits over a sample, each along the widest dimension; regions are its leaves."""

    def __init__(self, sample: np.ndarray, count: int):
        self.depth = max(0, count.bit_length() - 1)
        self.along, self.at = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        parts = [sample]
        for node in range(len(self.along)):
            part = parts[node]
            if len(part):
                self.along[node] = (part.max(axis=0) - part.min(axis=0)).argmax()
                self.at[node] = np.median(part[:, self.along[node]])
            right = part[:, self.along[node]] > self.at[node] if len(part) else np.zeros(0, bool)
            parts += [part[~right], part[right]]

    def __call__(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.along[node]] > self.at[node])
        return node - ((1 << self.depth) - 1)


def _placed(sound: DataFrame, regions: Regions, width: int, subs: int) -> DataFrame:
    """``sound`` (vec_id, vector, query) with its region and, in that, the shard by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = regions(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["vec_id", "vector", "query", "region"])

    placed = sound.mapInArrow(run, "vec_id long, vector array<double>, query boolean, region long")
    return placed.withColumn("sub", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(subs)))


def _boxes(placed: DataFrame, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The tight box of every region: regions x components numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            points, found = _matrix(batch.column(1), width), batch.column(0).to_numpy()
            for region in np.unique(found).tolist():
                part = points[found == region]
                low, high = boxes.get(region, (np.inf, -np.inf))
                boxes[region] = np.minimum(low, part.min(axis=0)), np.maximum(high, part.max(axis=0))
        for region, (low, high) in boxes.items():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(width, region), np.arange(width), low, high)], names=["region", "at", "low", "high"])

    partial = placed.select("region", "vector").mapInArrow(run, "region long, at long, low double, high double")
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for row in partial.groupBy("region", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
        low, high = out.setdefault(row["region"], (np.zeros(width), np.zeros(width)))
        low[row["at"]], high[row["at"]] = row["low"], row["high"]
    return out


def _reached(queries: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """``queries`` (vec_id, vector, home, bar) with every region whose box can hold a score that reaches the bar."""
    names = np.array(sorted(boxes), np.int64)
    low, high = (np.array([boxes[n][side] for n in names.tolist()]).reshape(len(names), width) for side in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                asked = _matrix(part.column(1), width)
                bounds = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
                bar = part.column(3).fill_null(-np.inf).to_numpy()
                at, region = np.nonzero(bounds >= bar[:, None])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in part.columns), pa.array(names[region])], names=["vec_id", "vector", "home", "bar", "region"])

    return queries.select("vec_id", "vector", "home", F.col("bar").cast("double").alias("bar")).mapInArrow(run, "vec_id long, vector array<double>, home long, bar double, region long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard: int = SHARD, group: int = QUERIES) -> DataFrame:
    """The ``k`` highest inner products of every query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and vector (array<double> of whole numbers, products within 2**53);
    ``is_query`` tells queries among them. Candidates are all rows with another vec_id than the
    query's; ties go to the smaller vec_id. Rows with a null vec_id or an improper vector take
    no part; vectors of unlike length are filled up with zeros; repeated rows count as often as
    they stand there, a query once. No rows give none. A shard's vectors are sent once for each ``group``
    of queries that reach it, and not at all where none does.
    """
    sound = vectors.where(proper("vector") & F.col("vec_id").isNotNull()).select("vec_id", "vector", is_query.alias("query"))
    sound = written(sound)
    facts = sound.select(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    shards, width = max(1, -(-facts["n"] // shard)), facts["width"] or 1
    count = min(1 << (shards - 1).bit_length(), REGIONS)
    subs = -(-shards // count)
    sample = sound.orderBy(F.xxhash64("vec_id", "vector")).limit(count * SAMPLED if count > 1 else 0).select("vector").collect()
    placed = written(_placed(sound, Regions(_matrix([r["vector"] for r in sample], width), count), width, subs))
    queries = placed.where("query").dropDuplicates(["vec_id"])

    def searched(asked: DataFrame) -> DataFrame:
        """``asked`` (vec_id, vector, bar, region, sub), in groups of queries, against the shards."""
        keys = ["region", "sub", "group"]
        crowds = written(asked.groupBy("region", "sub").agg(F.ceil(F.count("*") / group).alias("groups")))
        asked = asked.join(crowds, ["region", "sub"]).withColumn("group", F.expr("pmod(xxhash64(vec_id, 3L), groups)"))
        points = placed.select("vec_id", "vector", "region", "sub").join(crowds, ["region", "sub"]).withColumn("group", F.explode(F.expr("sequence(0L, groups - 1)")))
        asked = asked.select(*(F.col(c).alias(c) for c in ("vec_id", "vector", "bar", *keys)))  # its columns are none of points'
        return points.select("vec_id", "vector", *keys).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searcher(k), _FOUND)

    first = written(searched(queries.select("vec_id", "vector", "region", "sub", F.lit(None).cast("double").alias("bar"))))
    if shards == 1:
        return _best(first, k)
    bars = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bar")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "bar")
    barred = queries.select("vec_id", "vector", F.expr(f"region * {subs} + sub").alias("home")).join(bars, "vec_id", "left")
    reached = _reached(barred, _boxes(placed, width), width).withColumn("sub", F.explode(F.expr(f"sequence(0L, {subs - 1}L)")))
    elsewhere = written(reached.where(f"region * {subs} + sub <> home").drop("home"))
    return _best(first.unionAll(searched(elsewhere)), k)


def quantised(vector: str) -> Column:
    """Each component x as floor(256 x), x in double precision; what is not finite stays so."""
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) < F.lit(float("inf")), F.floor(x.cast("double") * 256).cast("double")).otherwise(x.cast("double")))
