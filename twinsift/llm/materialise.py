"""Training-order materialisation of token sequences.

The token ids of all documents, a closing id after each, are one stream in the order of the
input's partitions, cut into sequences of fixed length. A keyed Feistel permutation, walked
along its cycle until it lands below the number of sequences, gives every sequence its slot in
the training order. Slots are dealt to partitions in ranges of whole shards; every shard is one
file of records of one size, so a reader finds slot s at byte s % per_shard x stride of shard
s // per_shard, and can go on from any slot.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written
from .tokens import DEFAULT_VOCABULARY, encoder

LENGTH = 2048
#: Sequences in one shard file.
PER_SHARD = 4096
KEY = 0x5EED0FF1CE
ROUNDS = 6


class Feistel:
    """The permutation over whole arrays, walked along cycles: 0 .. count - 1 to 0 .. count - 1."""

    def __init__(self, count: int, key: int = KEY, rounds: int = ROUNDS):
        self.count, self.rounds = count, rounds
        self.half = np.uint64(max(1, -(-max(count - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        draw = np.random.Generator(np.random.PCG64(key))
        self.keys = draw.integers(0, 1 << 63, size=rounds, dtype=np.uint64)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & self.mask)
        return (left << self.half) | right

    def __call__(self, index: np.ndarray) -> np.ndarray:
        out = self._once(index.astype(np.uint64))
        while (beyond := np.flatnonzero(out >= self.count)).size:
            out[beyond] = self._once(out[beyond])
        return out.astype(np.int64)


def token_type(vocabulary: str = DEFAULT_VOCABULARY) -> np.dtype:
    """How an id is stored: unsigned and little-endian, of 2 bytes if all of the vocabulary's fit, else of 4."""
    return np.dtype("<u2" if encoder(vocabulary).size <= 1 << 16 else "<u4")


def token_table(docs: DataFrame, kind: np.dtype, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """part, start, tokens: the ids of every row, and where they start in their part of the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, tokens = [], []
            for text in batch.column(0):
                ids = np.frombuffer(encode(text.as_py()) + b"\0\0\0\0", "<u4").astype(kind)
                starts.append(at)
                tokens.append(ids.tobytes())
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(starts), pa.int32()), pa.array(starts, pa.int64()), pa.array(tokens, pa.binary())], names=["part", "start", "tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, start long, tokens binary")


def materialise(docs: DataFrame, folder: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Write ``docs`` (text; other columns are ignored) as shards; one row per sequence: sequence, slot, shard, offset, n_tokens, crc32, file.

    ``folder`` defaults to a new one in the shared folder; without a scheme it is one of Spark's
    default file system. Shards are written once, before this returns, and what is returned is
    read from a table. A shard is written under a name of the task's own and renamed when whole, so tasks
    may run twice. Ids take 2 bytes, or 4 where the vocabulary has more than 65,536. Null and
    empty texts are a closing id alone; the last sequence is filled up with id 0 and its n_tokens
    counts what is real; repeated rows stand in the stream as often; ids of documents, null or
    not, play no part. No rows give no sequences and no files.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    kind = token_type(vocabulary)
    wide = kind.itemsize
    table = written(token_table(docs, kind, vocabulary), "zstd")
    ends = table.groupBy("part").agg(F.max(F.col("start") + F.octet_length("tokens") / wide).cast("long").alias("n"))
    # one row for each partition of the input
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(ends.select("part", "n", before.alias("before")))
    total = offsets.agg(F.sum("n")).first()[0] or 0
    count = -(-total // length)
    shards = max(1, -(-count // per_shard))
    parts = min(shards, 2 * spark.sparkContext.defaultParallelism + shards // 16)
    order = Feistel(max(count, 1), key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, places, pieces = [], [], []
            for start, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                done, n = 0, len(tokens) // wide
                while done < n:
                    sequence, place = divmod(start + done, length)
                    take = min(length - place, n - done)
                    sequences.append(sequence)
                    places.append(place)
                    pieces.append(zlib.compress(tokens[wide * done : wide * (done + take)], 1))
                    done += take
            at = np.array(sequences, np.int64)
            slot = order(at) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array((slot // per_shard * parts // shards).astype(np.int32)), pa.array(slot), pa.array(at), pa.array(places, pa.int32()), pa.array(pieces, pa.binary())],
                names=["range", "slot", "sequence", "place", "piece"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for shard, records in _shards(_records(batches, length, wide), per_shard):
            name = f"{folder}/shard-{shard:08d}.bin"
            _put(name, f"{folder}/.shard-{shard:08d}-{attempt}", b"".join(r[2] for r in records))
            rows = [(r[1], r[0], shard, (r[0] - shard * per_shard) * wide * length, r[3], zlib.crc32(r[2]), name) for r in records]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()))],
                names=["sequence", "slot", "shard", "offset", "n_tokens", "crc32", "file"],
            )

    pieces = table.join(offsets.select("part", "before"), "part")
    pieces = pieces.select((F.col("before") + F.col("start")).alias("start"), "tokens")
    cuts = pieces.mapInArrow(cut, "range int, slot long, sequence long, place int, piece binary")
    dealt = cuts.repartitionById(parts, "range").sortWithinPartitions("slot", "place").drop("range")
    return written(dealt.mapInArrow(write, "sequence long, slot long, shard int, offset long, n_tokens int, crc32 long, file string"))


def _records(batches: Iterator[pa.RecordBatch], length: int, wide: int) -> Iterator[tuple[int, int, bytes, int]]:
    """Whole records in order of their slots: slot, sequence, bytes, real tokens. One is held at a time."""
    now, held = None, []
    for batch in batches:
        for slot, sequence, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if now is not None and slot != now[0]:
                yield (*now, *_record(held, length, wide))
                held = []
            now = (slot, sequence)
            held.append(zlib.decompress(piece))
    if now is not None:
        yield (*now, *_record(held, length, wide))


def _record(pieces: list[bytes], length: int, wide: int) -> tuple[bytes, int]:
    joined = b"".join(pieces)
    return joined.ljust(wide * length, b"\0"), len(joined) // wide


def _shards(records: Iterator[tuple[int, int, bytes, int]], per_shard: int) -> Iterator[tuple[int, list]]:
    """The records of one shard at a time."""
    shard, held = None, []
    for record in records:
        if shard is not None and record[0] // per_shard != shard:
            yield shard, held
            held = []
        shard = record[0] // per_shard
        held.append(record)
    if held:
        yield shard, held


def qualified(spark, folder: str) -> str:
    """``folder`` with the scheme and host of the file system that Spark would use for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _put(name: str, draft: str, content: bytes) -> None:
    """Write a file whole or not at all, on any file system that Arrow knows by its URI.

    A shard's bytes follow from its number, so one that another try has put there is as good:
    where a file system does not rename onto a file, the draft goes.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if re.match("file:/[^/]", name) else name)
    draft_path = path.rsplit("/", 1)[0] + "/" + draft.rsplit("/", 1)[1]
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(draft_path) as out:
        out.write(content)
    try:
        system.move(draft_path, path)
    except OSError:
        there = system.get_file_info(path)
        if there.type != fs.FileType.File or there.size != len(content):
            raise
        system.delete_file(draft_path)
