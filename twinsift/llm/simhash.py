"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are three segments. Of two fingerprints with at most 4
differing bits, either the last segments are equal or one of the first two differs
in at most one bit; so a table for each segment, read at the segment itself and, in
the first two, at every segment one bit away, meets every such pair. Meetings are
verified at their complete distance, in bounded blocks of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import given_back, unused, written
from .graph import connected_components

WORDS = 4
BITS = 4
#: First bit and number of bits of each segment, and the radius that is enumerated there.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Fingerprints of one bucket that a task compares at once.
BLOCK = 2048


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of a text; 0 without words."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)], "<u8")
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row of ``docs`` (doc_id, text; others are ignored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: given_back(run(batches)), "doc_id long, fingerprint long")


def _meeting_places(prints: DataFrame) -> DataFrame:
    """Where each distinct fingerprint stands or looks. One of two segments a bit apart lacks that bit, and looks where it is set."""
    places = []
    for number, (first, size, radius) in enumerate(SEGMENTS):
        value = f"(shiftrightunsigned(fingerprint, {first}) & {(1 << size) - 1}L)"
        places.append(f"array({number << 32}L | {value})")
        if radius:
            flips = ", ".join(f"if({value} & {1 << bit}L = 0, {number << 32 | 1 << bit}L | {value}, null)" for bit in range(size))
            places.append(f"array_compact(array({flips}))")
    return prints.select("fingerprint", F.explode(F.expr(f"concat({', '.join(places)})")).alias("place"))


def forest(prints: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what links of at most ``most`` bits among ``prints`` join: each print is reached once.

    Prints are unsigned: of signed integers numpy counts the bits of the absolute value.
    """
    left, right, rest = [], [], prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= most
            if near.any():
                hit = rest[near]
                left.append(np.full(len(hit), at, prints.dtype))
                right.append(hit)
                queue.extend(hit)
                rest = rest[~near]
    return left, right


def link_groups(groups: np.ndarray, prints: np.ndarray, most: int, short: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``groups``: short runs by shifted comparison, others by :func:`forest`."""
    left, right = [], []
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(groups)])))
    few = np.repeat(sizes <= short, sizes)
    for shift in range(1, min(short, len(groups))):
        near = few[shift:] & (groups[shift:] == groups[:-shift]) & (np.bitwise_count(prints[shift:] ^ prints[:-shift]) <= most)
        left.append(prints[:-shift][near])
        right.append(prints[shift:][near])
    for start, size in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist()):
        a, b = forest(prints[start : start + size], most)
        left += a
        right += b
    if not left:
        return prints[:0], prints[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def print_links(prints: DataFrame, most: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct ``prints`` that join all that differ in at most ``most`` (up to 4) bits.

    A bucket beyond ``block`` is cut into blocks by a hash, and every two blocks meet in a
    group of their own, so that no task gets more than two blocks at once and none is left out.
    """
    if not 0 <= most <= BITS:
        raise ValueError(f"segments are made for up to {BITS} bits")
    places = _meeting_places(prints)
    # written, so that the join can split the rows of a crowded place
    crowded = written(places.groupBy("place").count().where(F.col("count") > block).select("place", F.ceil(F.col("count") / block).alias("blocks")))
    mine = F.expr("cast(pmod(xxhash64(fingerprint, 7L), blocks) as long)")
    other = F.explode(F.expr("sequence(0L, blocks - 1)"))
    met = places.join(crowded, "place", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    met = met.select("place", "fingerprint", "blocks", mine.alias("mine"), other.alias("other"))
    group = F.xxhash64("place", F.least("mine", "other"), F.greatest("mine", "other"))
    met = met.select(group.alias("group"), "fingerprint")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, found = np.empty(0, np.int64), np.empty(0, np.uint64)
        ended = False
        batches = iter(batches)
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            if not ended:
                if not batch.num_rows:
                    continue
                groups = np.concatenate((groups, batch.column(0).to_numpy()))
                found = np.concatenate((found, batch.column(1).to_numpy().view(np.uint64)))
            if not len(groups):
                continue
            whole = len(groups) if ended else int(np.searchsorted(groups, groups[-1]))
            if whole:
                a, b = link_groups(groups[:whole], found[:whole], most)
                groups, found = groups[whole:], found[whole:]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return met.repartition("group").sortWithinPartitions("group").mapInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, most: int = BITS) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id (least doc_id reachable) of every row of ``docs``.

    Null and empty texts and texts without words have fingerprint 0 and link like any
    other; texts of fewer than ``words`` words are one shingle. Repeated rows are rows of
    one component; a null doc_id is no component's name while it has another. No rows give none.
    """
    rows = written(fingerprints(docs, words))
    prints = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = connected_components(print_links(prints.select("fingerprint"), most))
    named = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = written(named.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")))
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = written(named.join(least, "root").select("fingerprint", "component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, most: int = BITS) -> DataFrame:
    """One row of ``docs`` from each near-duplicate group: that of the least doc_id; its columns are untouched.

    Of rows repeated in doc_id and text one stays; rows without doc_id stay where their
    group has no other.
    """
    found = near_duplicates(docs, words, most)
    best = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("best")).distinct()
    kept = docs.join(best, docs["doc_id"].eqNullSafe(best["best"]), "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    name = unused("rank", docs.columns)
    return kept.withColumn(name, rank).where(F.col(name) == 1).drop(name)
