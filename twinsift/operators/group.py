"""Groups of equal digests and of hashes near a representative, and what they add up to."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MB
from ..schema import ERROR_DIGEST
from .match import collapsed, hash_pairs, least_near, near, near_each
from .order import indexed
from .stage import materialised


def shared_sizes(files: DataFrame) -> DataFrame:
    """The rows whose size another row has; only these need a digest."""
    sizes = materialised(files.groupBy("size").count().where("count > 1").select("size"))
    return files.join(sizes, "size", "left_semi")


def with_digests(files: DataFrame, digest: Column | None = None) -> DataFrame:
    """``files`` with md5 for rows of shared sizes; null for others, 'error' where there is no content.

    ``digest`` is an expression that reads a file, and is only taken of files of shared sizes;
    without it the column digest, taken where contents were read, is used. Contents are never shuffled.
    """
    # written, so that the join can split the rows of a size that very many files have
    sizes = materialised(files.groupBy("size").agg((F.count("*") > 1).alias("shared")))
    marked = files.join(sizes, "size")
    if digest is None:
        return marked.withColumn("md5", F.when(F.col("shared"), F.col("digest"))).drop("shared", "digest")
    read = marked.where("shared").withColumn("md5", digest)
    return read.unionByName(marked.where("not shared").withColumn("md5", F.lit(None).cast("string"))).drop("shared")


def md5_members(digested: DataFrame, singles: bool = False) -> DataFrame:
    """leader_idx, idx, pos of groups of one digest, members by idx; with ``singles`` every other row is a group of its own."""
    sound = F.col("md5").isNotNull() & ~F.col("md5").isin("", ERROR_DIGEST)
    groups = digested.where(sound).groupBy("md5").agg(F.min("idx").alias("leader_idx"), F.count("*").alias("n")).where("n > 1")
    groups = materialised(groups)
    joined = digested.select("idx", F.when(sound, F.col("md5")).alias("md5")).join(groups, "md5", "left" if singles else "inner")
    return _placed(joined.select(F.coalesce("leader_idx", "idx").alias("leader_idx"), "idx"))


def _placed(members: DataFrame) -> DataFrame:
    """``members`` (leader_idx, idx) with pos, from 0 by idx: a group of any size is numbered over many ranges."""
    order = indexed(members, "n", F.col("leader_idx"), F.col("idx"))
    starts = materialised(order.groupBy("leader_idx").agg(F.min("n").alias("start")))
    return order.join(starts, "leader_idx").select("leader_idx", "idx", (F.col("n") - F.col("start")).cast("int").alias("pos"))


def numbered(members: DataFrame) -> DataFrame:
    """group_id 0, 1, 2, ... in the order of leaders."""
    ids = materialised(indexed(members.where("pos = 0").select("leader_idx"), "group_id", F.col("leader_idx")))
    return members.join(ids, "leader_idx").select("group_id", "leader_idx", "idx", "pos")


#: Edges that one task resolves in sequence; it holds some 50 bytes for each.
TASK_EDGES = 4_000_000


def _in_sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sequential rule over all edges, by hi: those that join, as a neighbour below them does not."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    lo, hi = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
    nodes, places = np.unique(np.concatenate((lo, hi)), return_inverse=True)
    order = np.argsort(hi, kind="stable")
    lo, hi = places[: len(lo)][order], places[len(lo) :][order]
    joins = bytearray(len(nodes))
    for first in range(0, len(lo), 100_000):
        for a, b in zip(lo[first : first + 100_000].tolist(), hi[first : first + 100_000].tolist()):
            if not joins[a]:
                joins[b] = 1
    yield pa.RecordBatch.from_arrays([pa.array(nodes[np.frombuffer(joins, bool)])], names=["rep"])


def leaders(nodes: DataFrame, pairs: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """rep and leader of every node: going up the reps, a node joins its smallest neighbour that leads, or leads itself.

    ``pairs`` has lo and hi. Members alone are sought, as all others lead. In rounds, nodes
    without a lower neighbour among the open edges lead and their neighbours join; edges with an
    end that is decided so are dropped, and an edge's member end frees the other. What is
    open shrinks each round, and once it fits a task, that one goes on in sequence.
    """
    edges = open_edges = materialised(pairs.select("lo", "hi"))
    members: DataFrame | None = None

    def add(more: DataFrame) -> DataFrame:
        return more if members is None else members.unionAll(more)

    while open_edges.limit(task_edges + 1).count() > task_edges:
        lead = open_edges.select("lo").distinct().join(open_edges.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti")
        lead = materialised(lead)
        joining = materialised(open_edges.join(lead, "lo", "left_semi").select(F.col("hi").alias("rep")).distinct())
        members = add(joining)
        rest = open_edges.join(lead, "lo", "left_anti").join(joining, F.col("hi") == joining["rep"], "left_anti")
        open_edges = materialised(rest.join(joining, F.col("lo") == joining["rep"], "left_anti"))
    ended = open_edges.coalesce(1).mapInArrow(_in_sequence, "rep long")
    members = materialised(add(ended))
    joined = edges.join(members.withColumnRenamed("rep", "hi"), "hi", "left_semi").join(members.withColumnRenamed("rep", "lo"), "lo", "left_anti")
    led = joined.groupBy(F.col("hi").alias("rep")).agg(F.min("lo").alias("leader"))
    return nodes.select("rep").join(led, "rep", "left").withColumn("leader", F.coalesce("leader", "rep"))


#: Distinct hashes of the first stretch; each later one is as long as all before it. So many are also grouped by one task:
#: 1.3 s of it for 32,768 random hashes, where a stretch more takes a dozen jobs.
FIRST_STRETCH = 32_768
#: Hashes that are taken at once within such a task, and leaders that they are held against at once.
STEP, HEADS = 512, 4_096


def _led_in_sequence(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """rep, w0 .. w3 and leader of a few hashes: going up, one joins the smallest leader near it, or leads itself."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    held = pa.Table.from_batches(some).sort_by("rep").combine_chunks()
    found = np.stack([held.column(w).to_numpy().view(np.uint64) for w in ("w0", "w1", "w2", "w3")])
    rep = held.column("rep").to_numpy()
    lead = np.full(len(rep), len(rep))
    heads = np.empty(0, np.int64)
    for start in range(0, len(rep), STEP):
        own = found[:, start : start + STEP]
        led = lead[start : start + STEP]
        for k in range(0, len(heads), HEADS):
            some_heads = heads[k : k + HEADS]
            i, j, _ = near(found[:, some_heads], own, most)
            np.minimum.at(led, j, some_heads[i])
        for k in range(len(led)):
            if led[k] == len(rep):
                free = np.flatnonzero(led[k:] == len(rep)) + k
                dist = np.bitwise_count(own[:, free] ^ own[:, k : k + 1]).sum(axis=0, dtype=np.int64)
                led[free[dist <= most]] = start + k
        heads = np.concatenate((heads, start + np.flatnonzero(led == start + np.arange(len(led)))))
    yield from held.append_column("leader", pa.array(rep[lead])).to_batches()


#: Hashes of the sample that tells how many are near each other, and near ones that a hash has on average in a stretch at most for
#: pairs to be made of all of it; then a first stretch is at least so many times the usual one.
SAMPLE, NEIGHBOURS, WORTH = 8_192, 32, 4


def sparse_most(distinct: DataFrame, count: int, most: int) -> int:
    """How many hashes like the ``count`` of ``distinct`` have ``NEIGHBOURS`` near ones each on average, by a sample. It only steers: results do not depend on it."""
    some = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(-(-count // SAMPLE) or 1)) == 0)
    n, pairs = some.select("rep", "w0", "w1", "w2", "w3").repartition(1).mapInArrow(partial(near_each, most=most), "count long, pairs long").first()
    return NEIGHBOURS * n * (n - 1) // 2 // max(1, pairs)


def near_leaders(distinct: DataFrame, most: int, first: int = FIRST_STRETCH, task_hashes: int = FIRST_STRETCH) -> DataFrame:
    """rep and leader of every hash of ``distinct`` (rep, w0 .. w3), as :func:`leaders` finds them from all pairs.

    Reps are taken in stretches, going up. Those of a stretch that are near a leader of the
    stretches before join the smallest one; pairs are only made of the others. A crowd of hashes near each
    other is so held against its few leaders, and its pairs never become rows. Where few are near each
    other, the first stretch is longer, as each takes a few dozen jobs.
    """
    order = distinct.select("rep", "w0", "w1", "w2", "w3")
    count, done, found, lead = order.count(), 0, None, None
    if count > first and (sparse := sparse_most(order, count, most)) >= min(count, WORTH * first):
        first = sparse
    if count > first:
        order = materialised(indexed(order, "n", F.col("rep")))
    while done < count or found is None:
        until = max(first, 2 * done)
        stretch = order.where(F.col("n").between(done, until - 1)).drop("n") if count > first else order
        if lead is not None:
            joined = materialised(least_near(stretch, lead, most).select(F.col("hi").alias("rep"), F.col("lo").alias("leader")))
            found = found.unionAll(joined)
            stretch = materialised(stretch.join(joined, "rep", "left_anti"))
        if stretch.count() <= task_hashes:
            led = materialised(stretch.coalesce(1).mapInArrow(partial(_led_in_sequence, most=most), "rep long, w0 long, w1 long, w2 long, w3 long, leader long"))
            more = led.where("rep = leader").drop("leader")
            led = led.select("rep", "leader")
        else:
            led = materialised(leaders(stretch, hash_pairs(stretch, most)))
            more = materialised(stretch.join(led.where("rep = leader").select("rep"), "rep", "left_semi"))
        found, lead = (led, more) if found is None else (found.unionAll(led), lead.unionAll(more))
        done = until
    return found


def representative_members(hashes: DataFrame, most: int, singles: bool = False) -> DataFrame:
    """leader_idx, idx, pos of groups within ``most`` of their leader; the leader comes first, others by idx.

    ``hashes`` has idx and hash. Rows of one hash are always in one group, so the rule runs on
    distinct hashes. Not transitive: a member's neighbours need not be in its group.
    """
    hashes = materialised(hashes.select("idx", "hash").where("hash is not null"))
    distinct = materialised(collapsed(hashes))
    led = near_leaders(distinct, most) if most else distinct.select("rep", F.col("rep").alias("leader"))
    members = hashes.join(distinct.select("hash", "rep"), "hash").join(led, "rep").select(F.col("leader").alias("leader_idx"), "idx")
    placed = _placed(members)
    if singles:
        return placed
    several = materialised(placed.where("pos = 1").select("leader_idx"))
    return placed.join(several, "leader_idx", "left_semi")


def group_stats(members: DataFrame, files: DataFrame) -> DataFrame:
    """group_id, files, bytes, mb."""
    sized = members.join(files.select("idx", "size"), "idx")
    stats = sized.groupBy("group_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return stats.withColumn("mb", F.col("bytes") / MB)


def library_stats(members: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, groups."""
    both = files.select(F.lit(1).alias("file"), F.lit(None).cast("long").alias("group_id")).unionAll(members.select(F.lit(0), "group_id"))
    return both.agg(F.coalesce(F.sum("file"), F.lit(0)).alias("files"), F.count_distinct("group_id").alias("groups"))


def selection_summary(members: DataFrame, files: DataFrame) -> DataFrame:
    """One row per group: selected among its members; rows without a path do not count."""
    chosen = F.col("selected") & F.col("path").isNotNull() & (F.col("path") != "")
    return members.join(files.select("idx", "path", "selected"), "idx").groupBy("group_id").agg(F.count_if(chosen).alias("selected"))
