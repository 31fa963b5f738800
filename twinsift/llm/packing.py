"""Best-fit packing with certified bounds.

Documents become runs of token ids (a closing id 0 each), only runs longer than a
sequence are cut, and the pieces are packed into sequences of ``capacity`` tokens.
Pieces are dealt to bounded partitions and packed there by best fit decreasing. A
lower bound by dual feasible functions certifies each partition's bin count; the
bins that a partition with a gap fills worst are opened again, their pieces
exchanged between partitions and repacked, round by round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import DEFAULT_VOCABULARY, encoder

CAPACITY = 2048
#: Pieces that one task packs at once; bounds a task's memory and time.
PARTITION_PIECES = 40_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text is the closing id alone; a null doc_id stays null; repeated
    rows give repeated pieces; no rows give none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            texts = batch.column(1)
            for at, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = encode(texts[at].as_py()) + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for to, value in zip(rows, (doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part))):
                        to.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and every bin's load. Ties go to the item that stands first.

    Bins are found by their free room: one bit of an integer for each room that occurs.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, loads = 0, []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(loads)
            loads.append(0)
        bins[item], offsets[item] = at, capacity - room
        loads[at] += size
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(at)
    return bins, offsets, np.array(loads, np.int64)


def bin_lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing uses fewer bins: the best of the total, the threshold functions and the rounding functions.

    Threshold function with parameter e: items above capacity - e count as whole
    bins, items below e as nothing, others as they are. Rounding function with
    parameter k: x maps to x where (k + 1) x / capacity is whole, else to
    floor((k + 1) x / capacity) / k. Both are dual feasible, so their sums bound
    the number of bins from below.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    count_to, total_to = np.cumsum(counts), np.cumsum(counts * sizes)
    e = np.arange(0, capacity // 2 + 1)
    whole = count_to[-1] - count_to[capacity - e]
    below = np.where(e > 0, total_to[np.maximum(e - 1, 0)], 0)
    threshold = int((whole + -((below - total_to[capacity - e]) // capacity)).max())
    rounding = 0
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        # in units of 1 / (capacity * k)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        rounding = max(rounding, -(-int((counts * value).sum()) // (capacity * k)))
    return max(threshold, rounding)


def opened_bins(loads: np.ndarray, capacity: int) -> np.ndarray:
    """The bins to open again where the bound does not certify their count: the worst filled half of those with room."""
    partly = loads < capacity
    return partly & (loads <= np.median(loads[partly]))


def _packer(capacity: int, number: int, last: bool, names: list[str]):
    """Packs a whole partition, whose size the dealing bounds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.sort_by([(n, "ascending") for n in ("length", *names)])
        lengths = table["length"].to_numpy()
        bins, offsets, loads = best_fit_decreasing(lengths, capacity)
        certified = len(loads) <= bin_lower_bound(lengths, capacity)
        opened = np.zeros(len(loads), bool) if last or certified else opened_bins(loads, capacity)
        base = (number << 56) | (TaskContext.get().partitionId() << 28)
        for name, values in (("sequence_id", base + bins), ("offset", offsets), ("certified", np.full(len(bins), certified)), ("opened", opened[bins])):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches(max_chunksize=20_000)

    return pack


def best_fit_pack(items: DataFrame, capacity: int = CAPACITY, partition_items: int = PARTITION_PIECES, rounds: int = 4) -> DataFrame:
    """Give every row of ``items`` a sequence_id and an offset, in as few sequences as it can.

    certified tells whether no fewer sequences could hold what was packed together with the row
    in its last round; where that is not so for all, partitions with a gap exchange the
    bins they fill worst, for ``rounds`` rounds. ``items`` has a column length with 1 to
    ``capacity``, and any others, which must not be called sequence_id, offset, certified or opened. Repeated rows are packed as often as they stand
    there. Rows of full length fill a sequence each and are packed in place. No rows give none.
    """
    names = [n for n in items.columns if n != "length"]
    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", sequence_id long, offset long, certified boolean, opened boolean"
    done: list[DataFrame] = []
    for number in range(rounds):
        n = items.count()
        if not n and done:
            break
        parts = max(1, -(-n // partition_items))
        last = number == rounds - 1
        dealt = items.repartition(parts, F.xxhash64(*items.columns, F.lit(number)))
        packed = written(dealt.mapInArrow(_packer(capacity, number, last or parts == 1, names), schema))
        done.append(packed.where(~F.col("opened")).drop("opened"))
        items = packed.where("opened").drop("sequence_id", "offset", "certified", "opened")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Tokenise ``docs`` and pack all its pieces.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified; see
    :func:`token_pieces` for nulls, empty texts and repeated rows. Extra columns of
    ``docs`` are ignored, whatever their names.
    """
    return best_fit_pack(written(token_pieces(docs, capacity, vocabulary)), capacity)
