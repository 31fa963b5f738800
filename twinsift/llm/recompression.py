"""Substring deduplication by recompression.

A document is a row of word symbols. Each round names maximal runs of one symbol, then pairs of
neighbours of which the first is on the left side and the second on the right, the sides drawn
by a hash of symbol and round. Names are hashes of what they stand for, so they are the same in
every document. With each symbol goes the range of words that decided it: wherever those words
stand, the same symbol stands among them. A window of words is anchored at the longest symbol
that was decided within it, so equal windows have equal anchors; windows whose anchors stand in
one document only cannot repeat. The others are verified by two hashes of all their words, of
96 bits together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 13
ROUNDS = 2

#: Characters of texts that a task holds as words at once, or one longer text.
PART = 1_000_000
#: Keys that a task remembers as shared; beyond, it begins anew and only sends some rows more.
REMEMBERED = 500_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordCodes:
    """64-bit codes of words, remembered; memory is bounded."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        known = self.known
        if len(known) > self.most:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = xxh64_intdigest(word, 1)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def compressed(codes: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """After each round the symbols' names, starts and ends, and the starts and ends of the words that decided them.

    What the document's ends decided, words outside of it could decide otherwise: such ranges
    reach beyond the ends.
    """
    n = len(codes)
    name, start, end = codes, np.arange(n), np.arange(1, n + 1)
    low, high = start, end
    for number in range(rounds):
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        last = np.append(first[1:], len(name)) - 1
        length = (last - first + 1).astype(np.uint64)
        name = np.where(length > 1, _mixed(name[first] + _A * (length + np.uint64(1000 * number))), name[first])
        start, end = start[first], end[last]
        before = np.concatenate(([-1], low[first[1:] - 1])) if len(first) else low[:0]
        after = np.concatenate((high[last[:-1] + 1], [n + 1])) if len(first) else high[:0]
        low, high = np.minimum(low[first], before), np.maximum(high[last], after)

        drawn = np.uint64(int(_A) * (number + 7) & 0xFFFFFFFFFFFFFFFF)
        left = (_mixed(name + drawn) & np.uint64(1)).astype(bool)
        head = np.flatnonzero(left[:-1] & ~left[1:])
        gone = np.zeros(len(name), bool)
        gone[head + 1] = True
        paired = np.zeros(len(name), bool)
        paired[head] = True
        new_name, new_end, new_low, new_high = name.copy(), end.copy(), low.copy(), high.copy()
        new_name[head] = _mixed(name[head] * _B + _mixed(name[head + 1] + np.uint64(number)))
        new_end[head], new_high[head] = end[head + 1], np.maximum(high[head], high[head + 1])
        new_low[head] = np.minimum(low[head], low[head + 1])
        lone_left = np.flatnonzero(left & ~paired)
        lone_right = np.flatnonzero(~left & ~gone)
        new_high[lone_left] = np.maximum(high[lone_left], np.append(high, n + 1)[lone_left + 1])
        new_low[lone_right] = np.minimum(low[lone_right], np.concatenate(([-1], low))[lone_right])
        kept = ~gone
        name, start, end, low, high = new_name[kept], start[kept], new_end[kept], new_low[kept], new_high[kept]
        yield name, start, end, low, high


def window_hashes(codes: np.ndarray, window: int = WINDOW, odd: np.uint64 = _A) -> np.ndarray:
    """A hash of all words of every window, in order of its first word."""
    n = len(codes) - window + 1
    out = np.zeros(max(n, 0), np.uint64)
    for at in range(window if n > 0 else 0):
        out = _mixed(out * odd + codes[at : at + n])
    return out


def _ranges(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of the words from one place to another, by differences of a sum with powers of an odd number."""
    base = int(_A)
    ahead, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), b, np.uint64))), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * ahead[:-1], dtype=np.uint64)))
    return lambda start, end: (sums[end] - sums[start]) * back[start]


def window_anchors(codes: np.ndarray, hashes: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor of every window: its longest symbol with the words that decided it, of several the one with the greatest hash.

    A window in which no symbol was decided is its own anchor.
    """
    n = len(hashes)
    best = np.zeros(n, np.uint64)
    words_between = _ranges(codes)
    for number, (name, start, end, low, high) in enumerate(compressed(codes, rounds)):
        length = end - start
        room = window - (high - low)
        inside = np.flatnonzero((low >= 0) & (high <= len(codes)) & (room >= 0) & (length > 1))
        at, room = low[inside], room[inside]
        seen = _mixed(name[inside] + np.uint64(number)) + words_between(at, high[inside])
        key = (np.minimum(length[inside], 31).astype(np.uint64) << np.uint64(59)) | (_mixed(seen) >> np.uint64(5))
        for _ in range(window):
            if not len(at):
                break
            starts = at < n
            np.maximum.at(best, at[starts], key[starts])
            further = (room > 0) & (at > 0)
            at, room, key = at[further] - 1, room[further] - 1, key[further]
    return np.where(best > 0, best, hashes >> np.uint64(5))


class Batch:
    """The windows of some documents, one after the other with a mark between: documents, hashes and anchors."""

    def __init__(self, words: list[list[bytes]], code: WordCodes, window: int, anchors: bool):
        sizes = np.array([len(w) for w in words], np.int64)
        joined = code([w for row in words for w in row])
        firsts = np.cumsum(sizes + 1) - (sizes + 1)
        codes = np.empty(int(sizes.sum()) + len(words), np.uint64)
        marks = firsts + sizes
        plain = np.ones(len(codes), bool)
        plain[marks] = False
        codes[plain] = joined
        codes[marks] = _mixed(np.arange(len(words), dtype=np.uint64) + _C)
        every = window_hashes(codes, window)
        counts = np.maximum(sizes - window + 1, 0)
        self.row = np.repeat(np.arange(len(words)), counts)
        self.at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        place = self.at + np.repeat(firsts, counts)
        self.hash = every[place]
        self.anchor = window_anchors(codes, every, window)[place] if anchors else None
        self.codes, self.place, self.window = codes, place, window

    def checks(self, use: np.ndarray) -> np.ndarray:
        """32 further bits of the windows in ``use``."""
        return (window_hashes(self.codes, self.window, _C)[self.place[use]] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of batches of about so many characters, or one longer text, with the words of their texts."""
    for batch in batches:
        start, held = 0, 0
        for at, text in enumerate(texts := batch.column(1)):
            held += len(text.as_py() or "")
            if held >= most or at == batch.num_rows - 1:
                yield batch.slice(start, at + 1 - start), [_split(t.as_py()) for t in texts[start : at + 1]]
                start, held = at + 1, 0


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document ids (0 for null), and which are not null."""
    ids = batch.column(0)
    return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)


def _firsts(key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check, doc) in order, and whether doc is the least here of its key and check."""
    order = np.lexsort((doc, check, key))
    key, check, doc = key[order], check[order], doc[order]
    new_key = np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])))
    new = new_key | np.concatenate(([True], doc[1:] != doc[:-1]))
    return key[new], check[new], doc[new], new_key[new]


def _rows(key: np.ndarray, check: np.ndarray, doc: np.ndarray, state: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(key[part]).view(np.int64)), pa.array(check[part]), pa.array(doc[part]), pa.array(state[part], pa.int8())],
            names=["key", "check", "doc_id", "state"],
        )


_ASKED = "key long, check int, doc_id long, state byte"
#: What a task knows of a document and a key: nothing yet; that others have it too; that it must tell others.
ASKS, KNOWN, TELLS = 0, 1, 2


class _Shared:
    """Keys that a task has met in several documents, with the least of these, so that it sends few rows for a key that very many have."""

    def __init__(self, most: int):
        self.most = most
        self.key, self.check, self.least = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64)

    def known(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray, above: bool) -> np.ndarray:
        """Which rows have a key met before; with ``above`` in a smaller document."""
        if not len(self.key):
            return np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        met = (self.key[at] == key) & (self.check[at] == check)
        return met & (self.least[at] < doc) if above else met

    def add(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> None:
        if len(self.key) > self.most:
            self.__init__(self.most)
        key, check, doc = (np.concatenate(x) for x in ((self.key, key), (self.check, check), (self.least, doc)))
        order = np.lexsort((doc, key))
        order = order[np.concatenate(([True], key[order][1:] != key[order][:-1]))] if len(order) else order
        self.key, self.check, self.least = key[order], check[order], doc[order]


def _alone(first: np.ndarray) -> np.ndarray:
    """Which rows are the only one of their key, by the marks of each key's first."""
    return first & np.concatenate((first[1:], [True]))


def _anchored(window: int, part: int, remembered: int):
    """Distinct anchors of documents. Where several documents of a part have one, all are known to share it, and one tells so, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shared = WordCodes(), _Shared(remembered)
        for batch, words in _parts(batches, part):
            ids, sound = _ids(batch)
            found = Batch(words, code, window, True)
            use = sound[found.row]
            if not use.any():
                continue
            key, check, doc, first = _firsts(found.anchor[use], np.zeros(int(use.sum()), np.int32), ids[found.row[use]])
            alone = _alone(first)
            known = shared.known(key, check, doc, False)
            yield from _rows(key, check, doc, np.where(alone & ~known, ASKS, KNOWN))
            tells = first & ~alone & ~known
            yield from _rows(key[tells], check[tells], doc[tells], np.full(int(tells.sum()), TELLS))
            shared.add(key[tells], check[tells], doc[tells])

    return run


def _windows(window: int, part: int, remembered: int):
    """Windows at shared anchors. In a part the least document of a window asks; the others are known to repeat it, as is one past what the task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shared_here = WordCodes(), _Shared(remembered)
        for batch, words in _parts(batches, part):
            shared = batch.column(2)
            if shared.null_count == len(shared):
                continue
            ids, _ = _ids(batch)
            some = [at for at, there in enumerate(shared.is_valid().to_pylist()) if there]
            found = Batch([words[at] for at in some], code, window, True)
            use = np.zeros(len(found.row), bool)
            cuts = np.searchsorted(found.row, np.arange(len(some) + 1))
            for n, at in enumerate(some):
                keys = shared[at].values.to_numpy(zero_copy_only=False).view(np.uint64)
                use[cuts[n] : cuts[n + 1]] = np.isin(found.anchor[cuts[n] : cuts[n + 1]], keys)
            if use.any():
                key, check, doc, first = _firsts(found.hash[use], found.checks(use), ids[np.array(some)][found.row[use]])
                known = shared_here.known(key, check, doc, True)
                yield from _rows(key, check, doc, np.where(first & ~known, ASKS, KNOWN))
                several = first & ~_alone(first)
                shared_here.add(key[several], check[several], doc[several])

    return run


def _answered(asked: DataFrame, least_stays: bool) -> DataFrame:
    """doc_id and keys: the keys that a document shares with others, or with smaller ones.

    However many documents have a key, a task sends some rows that ask or tell at most; rows of
    what is known already are dealt by their documents too.
    """
    group = Window.partitionBy("key", "check", "salt")
    rows = asked.withColumn("salt", F.when(F.col("state") == KNOWN, F.col("doc_id")))
    seen = rows.select("key", "doc_id", "state", F.min("doc_id").over(group).alias("least"), F.max("doc_id").over(group).alias("most"), F.max("state").over(group).alias("told"))
    others = "doc_id > least" if least_stays else f"least < most or told = {TELLS}"
    found = seen.where(f"state = {KNOWN} or state = {ASKS} and ({others})")
    return found.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def _cleaner(window: int, part: int):
    """Takes the words of repeated windows out of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordCodes()
        for batch, words in _parts(batches, part):
            repeated = batch.column(2)
            some = [at for at, there in enumerate(repeated.is_valid().to_pylist()) if there]
            gone = [0] * len(words)
            if some:
                found = Batch([words[at] for at in some], code, window, False)
                cuts = np.searchsorted(found.row, np.arange(len(some) + 1))
                for n, at in enumerate(some):
                    keys = repeated[at].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    starts = np.flatnonzero(np.isin(found.hash[cuts[n] : cuts[n + 1]], keys))
                    cover = np.zeros(len(words[at]) + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + window, -1)
                    covered = (np.cumsum(cover)[:-1] > 0).tolist()
                    gone[at] = sum(covered)
                    words[at] = [w for w, c in zip(words[at], covered) if not c]
            kept = [b" ".join(w).decode("utf-8", "surrogatepass") for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) + g for w, g in zip(words, gone)], pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, part: int = PART, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by single blanks) of every row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts in a document with
    a smaller doc_id. ``docs`` has doc_id and text; other columns are ignored. Null and empty
    texts have no words; texts of fewer words than a window stay as they are; rows with a null
    doc_id stay whole and make no other row lose words. Rows that repeat a doc_id are one
    document: they lose nothing because of each other. No rows give none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = _answered(texts.mapInArrow(_anchored(window, part, remembered), _ASKED), False)
    # left joins both, so that one exchange of the texts serves twice
    asked = texts.join(shared, "doc_id", "left").select("doc_id", "text", "keys").mapInArrow(_windows(window, part, remembered), _ASKED)
    repeated = _answered(asked, True)
    return texts.join(repeated, "doc_id", "left").select("doc_id", "text", "keys").mapInArrow(_cleaner(window, part), "doc_id long, n_words long, n_removed long, kept string")
