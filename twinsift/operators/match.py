"""Pairs of hashes within a Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import BITS, words
from ..functions.scalars import hamming
from .stage import materialised

#: Distinct hashes up to which blocks of them are held against each other, whatever the distance.
NESTED_MOST = 50_000
MOST_DISTANCE = 64
#: Bits that may differ in a segment that is looked up.
MOST_RADIUS = 1
#: Hashes at a place beyond which they are compared in blocks.
CROWD = 256
#: Hashes of a block, at least and at most, and of its parts; pairs of blocks that a task compares.
BLOCK_LEAST, BLOCK_MOST, PART, TASK_PAIRS = 1_024, 8_192, 512, 8
_WORDS = ("w0", "w1", "w2", "w3")


def collapsed(hashes: DataFrame) -> DataFrame:
    """One row per distinct hash of ``hashes`` (idx, hash): hash, rep (smallest idx), copies, w0 .. w3. Null hashes are left out."""
    one = hashes.where("hash is not null").groupBy("hash").agg(F.min("idx").alias("rep"), F.count("*").alias("copies"))
    return one.select("hash", "rep", "copies", *words("hash"))


def _verified(pairs: DataFrame, most: int) -> DataFrame:
    return pairs.withColumn("dist", hamming("a.", "b.")).where(F.col("dist") <= most).select(F.col("a.rep").alias("lo"), F.col("b.rep").alias("hi"), "dist")


def nested_pairs(distinct: DataFrame, most: int) -> DataFrame:
    """Every two hashes compared; for a checked number of them, whatever the distance."""
    a, b = distinct.alias("a"), F.broadcast(distinct.alias("b"))
    return _verified(a.join(b, (F.col("a.rep") < F.col("b.rep")) & (hamming("a.", "b.") <= most)), most)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Reps and words (4 x rows) of a batch with rep and w0 .. w3."""
    return batch.column("rep").to_numpy(), np.stack([batch.column(w).to_numpy().view(np.uint64) for w in _WORDS])


def _bits_set(hashes: np.ndarray) -> np.ndarray:
    """Rows x 17: bits set in each 16 of a hash, and in all."""
    shares = np.bitwise_count(np.ascontiguousarray(hashes.T).view(np.uint16)).astype(np.int16)
    return np.concatenate((shares, shares.sum(axis=1, keepdims=True)), axis=1)


def _parted(counts: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """``rows`` in parts of like counts: halved where the counts spread widest."""
    if len(rows) <= PART:
        yield rows
        return
    widest = np.ptp(counts[rows], axis=0).argmax()
    half = len(rows) // 2
    cut = np.argpartition(counts[rows, widest], half)
    yield from _parted(counts, rows[cut[:half]])
    yield from _parted(counts, rows[cut[half:]])


def _at_least(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """The distance that hashes of two boxes of counts have at least, for every box of a against every of b."""
    gaps = np.maximum(0, np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]))
    return np.maximum(gaps[..., :-1].sum(axis=-1), gaps[..., -1])


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held = [_read(b) for b in batches if b.num_rows]
    if not held:
        return
    reps, hashes = np.concatenate([r for r, _ in held]), np.concatenate([h for _, h in held], axis=1)
    for k, first in enumerate(range(0, len(reps), size)):
        rep, some = reps[first : first + size], hashes[:, first : first + size]
        counts = _bits_set(some)
        at = (TaskContext.get().partitionId() << 32) + k
        row = [[at], [rep.astype(np.int64).tobytes()], [np.ascontiguousarray(some).tobytes()], [counts.min(axis=0).tolist()], [counts.max(axis=0).tolist()]]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["block", "reps", "hashes", "low", "high"])


def _blocks(hashes: DataFrame, size: int, count: int) -> DataFrame:
    """``hashes`` (rep, w0 .. w3) by the number of bits set, up to ``size`` in a row, with the least and most bits set of each share."""
    bits = sum((F.bit_count(w) for w in _WORDS), F.lit(0))
    dealt = hashes.select("rep", *_WORDS).repartitionByRange(-(-count // size) or 1, bits, F.col("rep")).sortWithinPartitions(bits, "rep")
    return materialised(dealt.mapInArrow(partial(_packed, size=size), "block long, reps binary, hashes binary, low array<int>, high array<int>"))


def near(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and of b (4 x rows each) within ``most``, and their distances."""
    dist = np.bitwise_count(a[0][:, None] ^ b[0])
    at = np.flatnonzero(dist <= most)
    if len(at) * 4 > dist.size:  # then plain sums are cheaper than picking
        dist = dist.astype(np.uint16)
        for w in (1, 2, 3):
            dist += np.bitwise_count(a[w][:, None] ^ b[w])
        at = np.flatnonzero(dist <= most)
        return *np.divmod(at, b.shape[1]), dist.ravel()[at]
    dist = dist.ravel()[at]
    i, j = np.divmod(at, b.shape[1])
    for w in (1, 2, 3):
        dist = dist + np.bitwise_count(a[w][i] ^ b[w][j])
        sound = dist <= most
        i, j, dist = i[sound], j[sound], dist[sound]
    return i, j, dist


def _parts(reps: bytes, hashes: bytes) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Reps and hashes of a block's parts, and the least and most bits set in each."""
    rep = np.frombuffer(reps, np.int64)
    some = np.frombuffer(hashes, np.uint64).reshape(4, -1)
    counts = _bits_set(some)
    rows = list(_parted(counts, np.arange(len(rep))))
    return [(rep[r], np.ascontiguousarray(some[:, r])) for r in rows], np.stack([counts[r].min(axis=0) for r in rows]), np.stack([counts[r].max(axis=0) for r in rows])


def _met(a, b, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For two parts at a time: their places, and the rows and distances of what is near. A block meets itself once."""
    (some, low_a, high_a), (others, low_b, high_b) = a, b
    for p, q in np.argwhere(_at_least(low_a, high_a, low_b, high_b) <= most).tolist():
        if a is b and q < p:
            continue
        i, j, dist = near(some[p][1], others[q][1], most)
        if a is b and p == q:
            once = i < j
            i, j, dist = i[once], j[once], dist[once]
        if len(i):
            yield p, q, i, j, dist


def _compared(batches: Iterator[pa.RecordBatch], most: int, least: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a task's blocks, side 0 then 1 (one block alone: with itself), to lo, hi, dist, or with ``least`` to the smallest rep of side 1 (lo) near one of side 0 (hi)."""
    held = None
    for batch in batches:
        for task, alone, reps, hashes in zip(*(batch.column(c) for c in ("task", "alone", "reps", "hashes"))):
            block = _parts(reps.as_py(), hashes.as_py())
            if held is None and not alone.as_py():
                held = (task.as_py(), block)
                continue
            one = block if held is None else held[1]
            if held is not None and held[0] != task.as_py():
                raise RuntimeError("a pair of blocks lacks one of them")
            held = None
            best = [np.full(len(reps), np.iinfo(np.int64).max) for reps, _ in one[0]]
            for p, q, i, j, dist in _met(one, block, most):
                a, b = one[0][p][0][i], block[0][q][0][j]
                if least:
                    np.minimum.at(best[p], i, b)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(dist.astype(np.int32))], names=["lo", "hi", "dist"])
            if least:
                lo, hi = np.concatenate(best), np.concatenate([reps for reps, _ in one[0]])
                found = lo < np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([pa.array(lo[found]), pa.array(hi[found])], names=["lo", "hi"])


def _held_together(a: DataFrame, b: DataFrame | None, most: int, least: bool) -> DataFrame:
    """Blocks of a against those of b, or against each other; only those whose counts can be that near."""
    spark = a.sparkSession
    count = max(d.count() for d in (a, b) if d is not None)
    size = min(BLOCK_MOST, max(BLOCK_LEAST, count // 24))
    sides = [_blocks(d, size, count) for d in (a, b) if d is not None]
    boxes = [s.select("block", "low", "high").toArrow() for s in sides]
    ids = [x.column("block").to_numpy() for x in boxes]
    low, high = ([np.array(x.column(c).to_pylist(), np.int64).reshape(-1, BITS // 16 + 1) for x in boxes] for c in ("low", "high"))
    last = len(sides) - 1
    # a row of boxes at a time
    meets = [(p, q) for p in range(len(ids[0])) for q in np.flatnonzero(_at_least(low[0][p : p + 1], high[0][p : p + 1], low[last], high[last])[0] <= most).tolist() if last or p <= q]
    spread = []
    for side, blocks in enumerate(sides):
        at = [(task, p, not last and p == q) for task, (p, q) in enumerate(meets) if side == 0] + [(task, q, False) for task, (p, q) in enumerate(meets) if side == last and (last or p != q)]
        tasks = pa.table({"task": pa.array([x[0] for x in at], pa.int64()), "block": pa.array(ids[side][[x[1] for x in at]] if at else [], pa.int64()), "alone": pa.array([x[2] for x in at], pa.bool_())})
        spread.append(blocks.select("block", "reps", "hashes").join(F.broadcast(spark.createDataFrame(tasks)), "block").withColumn("side", F.lit(side)))
    rows = spread[0].unionByName(spread[1]) if last else spread[0]
    dealt = rows.repartition(-(-len(meets) // TASK_PAIRS) or 1, "task").sortWithinPartitions("task", "side", "block")
    shape = "lo long, hi long" if least else "lo long, hi long, dist int"
    return dealt.select("task", "alone", "reps", "hashes").mapInArrow(partial(_compared, most=most, least=least), shape)


def block_pairs(distinct: DataFrame, most: int) -> DataFrame:
    """lo, hi and dist of all pairs within ``most``, each once: blocks of hashes are compared whole, in tasks of their own.

    Two hashes differ in as many bits as the numbers of bits set in their 16 shares do at
    least, so blocks and parts of blocks whose counts are too far apart do not meet.
    """
    return _held_together(distinct, None, most, False)


def least_near(hashes: DataFrame, others: DataFrame, most: int) -> DataFrame:
    """hi and lo: of each rep of ``hashes`` that has some of ``others`` within ``most`` the smallest of these."""
    return _held_together(hashes, others, most, True).groupBy("hi").agg(F.min("lo").alias("lo"))


def radius_for(count: int, most: int) -> int:
    """The bits to enumerate in each segment, so that segments have about as many values as there are hashes.

    Of s segments one differs in at most ``most`` // s bits; fewer segments are longer ones.
    """
    radius = 0
    while radius < min(MOST_RADIUS, most) and 1 << (BITS // (most // (radius + 1) + 1)) < count:
        radius += 1
    return radius


def _segments(most: int, radius: int) -> list[tuple[int, int]]:
    """Start and length of each of the fewest segments of which one differs in at most ``radius`` bits."""
    pieces = most // (radius + 1) + 1
    cuts = [BITS * k // pieces for k in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _masks(most: int, radius: int, strided: bool = False) -> list[tuple[np.ndarray, list[int]]]:
    """For each segment its bits in each of the four words, and its bits' numbers; if ``strided``, bit i of s segments is in segment i mod s."""
    found = []
    pieces = _segments(most, radius)
    for k, (start, length) in enumerate(pieces):
        mask = np.zeros(4, np.uint64)
        bits = list(range(k, BITS, len(pieces)) if strided else range(start, start + length))
        for bit in bits:
            mask[bit // 64] |= np.uint64(1 << bit % 64)
        found.append((mask, bits))
    return found


def _mixed(segment: int, parts: np.ndarray) -> np.ndarray:
    """The number of a place: 64 bits of a segment's number and bits (4 x rows)."""
    out = np.full(parts.shape[1], segment + 1, np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _placed_at(batches: Iterator[pa.RecordBatch], most: int, radius: int, looks: bool) -> Iterator[pa.RecordBatch]:
    """A row for each place of a hash: its segments, and if it ``looks`` with ``radius`` 1 these with any one bit changed."""
    masks = _masks(most, radius)
    for batch in batches:
        _, hashes = _read(batch)
        for k, (mask, bits) in enumerate(masks):
            parts = hashes & mask[:, None]
            for flip in (None, *(bits if looks and radius else ())):
                if flip is not None:
                    parts = hashes & mask[:, None]
                    parts[flip // 64] ^= np.uint64(1 << flip % 64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", *_WORDS)), pa.array(_mixed(k, parts).view(np.int64))], names=["rep", *_WORDS, "place"])


def _standing_at(hashes: DataFrame, most: int, strided: bool) -> DataFrame:
    """A row for each place of a hash at radius 0, without Python: the number of its place is a hash of the segment's number and bits."""
    places = [F.xxhash64(F.lit(k), *(F.col(w).bitwiseAND(F.lit(part)) for w, part in zip(_WORDS, mask.view(np.int64).tolist()) if part)) for k, (mask, _) in enumerate(_masks(most, 0, strided))]
    return hashes.select("rep", *_WORDS, F.explode(F.array(*places)).alias("place"))


def banded_pairs(distinct: DataFrame, most: int, radius: int = 0, crowd: int = CROWD, strided: bool = False) -> DataFrame:
    """Of enough segments two hashes within ``most`` nearly agree on one: they meet at a place there and are compared whole.

    With ``radius`` 1 a hash stands at its segments' values and looks at those a bit apart. Hashes
    that stand at or look at a place where more than ``crowd`` stand are compared with each other in
    blocks, and meet only others at places; pairs that meet twice count once. ``strided`` segments
    take turns at the bits, so that each has its share of those that a short text sets, and few
    places are crowded.
    """
    if not 0 <= most <= MOST_DISTANCE or not 0 <= radius <= MOST_RADIUS or radius and strided:
        raise ValueError(f"distances of 0 to {MOST_DISTANCE}, radii of 0 to {MOST_RADIUS}; strided at radius 0 only")
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = distinct.select("rep", *_WORDS)
    whole = whole.repartition(spread) if radius else whole
    shape = "rep long, w0 long, w1 long, w2 long, w3 long, place long"

    def placed(rows: DataFrame, looks: bool) -> DataFrame:
        if not radius:
            return _standing_at(rows, most, strided)
        return rows.mapInArrow(partial(_placed_at, most=most, radius=radius, looks=looks), shape)

    standing = placed(whole, False)
    crowded = materialised(standing.groupBy("place").count().where(F.col("count") > crowd).select("place"))
    among = materialised(placed(whole, True).join(F.broadcast(crowded), "place", "left_semi").select("rep").distinct())
    marked = materialised(whole.join(among.withColumn("crowded", F.lit(True)), "rep", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))))
    rest = marked.where("not crowded").drop("crowded")
    rest = rest.repartition(spread) if radius else rest
    # merged: their size is estimated as that of the hashes, and the planner would broadcast all places
    a, b = placed(rest, True).hint("merge").alias("a"), standing.hint("merge").alias("b")
    met = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.rep") != F.col("b.rep")) & (hamming("a.", "b.") <= most))
    ends = (F.col("a.rep"), F.col("b.rep"))
    met = met.select(F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi"), hamming("a.", "b.").alias("dist")).distinct()
    return met.unionAll(block_pairs(marked.where("crowded"), most))


def hash_pairs(distinct: DataFrame, most: int, nested_most: int = NESTED_MOST) -> DataFrame:
    """lo, hi (reps, lo < hi) and dist of all pairs of distinct hashes within ``most``.

    Up to ``nested_most`` hashes, counted first, are compared in blocks; beyond, they meet in
    segments if these are long enough for their number, and else in blocks too. At distance 0
    distinct hashes have no pairs. Copies of a hash are not expanded: ``collapsed`` has their
    number, and :func:`representatives` which rows they are.
    """
    count = distinct.count()
    if count <= nested_most or radius_for(count, most):
        return block_pairs(distinct, most)
    return banded_pairs(distinct, most, strided=True)


def near_each(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One row: the number of a few hashes, and of pairs of them within ``most``."""
    held = [_read(b)[1] for b in batches if b.num_rows]
    hashes = np.concatenate(held, axis=1) if held else np.empty((4, 0), np.uint64)
    count, pairs = hashes.shape[1], 0
    for k in range(0, count, PART):
        own = hashes[:, k : k + PART]
        pairs += int(np.count_nonzero(np.less(*near(own, own, most)[:2])))
        for j in range(k + PART, count, BLOCK_MOST):
            pairs += len(near(own, hashes[:, j : j + BLOCK_MOST], most)[0])
    yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([pairs], pa.int64())], names=["count", "pairs"])


def representatives(hashes: DataFrame) -> DataFrame:
    """idx and rep (the smallest idx of the same hash) of every row with a hash."""
    known = hashes.where("hash is not null").groupBy("hash").agg(F.min("idx").alias("rep"))
    return hashes.select("idx", "hash").join(known, "hash").select("idx", "rep")
