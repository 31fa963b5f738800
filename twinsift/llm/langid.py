"""Language identification by unigram piece models, marginalised over segmentations.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. Both fitting and scoring go over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_back, written
from .tokens import located

#: A name among the public tokenizers, or a path.
DEFAULT_VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
#: More languages than this are an error: the model holds languages x vocabulary numbers on each worker.
MOST_LANGUAGES = 256
#: Added to each count; and the probability of a letter that no piece covers.
SMOOTHING, UNCOVERED = 0.05, 1e-9

_WORDS = re.compile(r"[^\W\d_]+").findall


def letter_runs(text: str) -> list[str]:
    """The lower-case runs of letters in a text."""
    return [w for w in _WORDS(text.lower()) if any(map(str.isalpha, w))]


class Segmenter:
    """The log probability of words under every language, summed over segmentations, for many words at once.

    Substrings are looked up by a rolling hash of 64 bits: a table of one byte a slot turns
    most away, and a search among the pieces' sorted hashes finds the others.
    """

    _BASE, _MIX, _SLOTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 21

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        self.languages = probabilities.shape[1]
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.probabilities = hashes[order], np.ascontiguousarray(probabilities[order])
        self.taken = np.zeros(1 << self._SLOTS, bool)
        self.taken[self._slot(self.hashes)] = True

    def _hash(self, piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(self._BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return value

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * self._MIX) >> np.uint64(64 - self._SLOTS)

    def words(self, words: list[str]) -> np.ndarray:
        """Words x languages."""
        out = np.zeros((len(words), self.languages))
        by_length: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            by_length.setdefault(len(word) + 1, []).append(at)
        for length, rows in by_length.items():
            step = max(1, 2_000_000 // (length * max(self.languages, self.longest)))
            for first in range(0, len(rows), step):
                part = rows[first : first + step]
                out[part] = self._alike("".join("▁" + words[at] for at in part), len(part), length)
        return out

    def _alike(self, joined: str, words: int, length: int) -> np.ndarray:
        """The forward algorithm over words of one length; each word and language has a scale of its own."""
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(words, length).astype(np.uint64)
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
        hashes = np.zeros((words, length + 1), np.uint64)
        for size in range(1, min(self.longest, length) + 1):
            hashes = hashes[:, : length - size + 1] * self._BASE + codes[:, size - 1 :]
            row, start = np.nonzero(self.taken[self._slot(hashes)])
            wanted = hashes[row, start]
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            there = self.hashes[at] == wanted
            row, start, at = row[there], start[there], at[there]
            order = np.argsort(start, kind="stable")
            row, start, at = row[order], start[order], at[order]
            cuts = np.searchsorted(start, np.arange(length - size + 2))
            for s in range(length - size + 1):
                if cuts[s] < cuts[s + 1]:
                    ends[s + size].append((size, row[cuts[s] : cuts[s + 1]], at[cuts[s] : cuts[s + 1]]))
        sums, scale = [np.ones((words, self.languages))], np.zeros((words, self.languages))
        for found in ends[1:]:
            total = sums[-1] * UNCOVERED
            for size, row, at in found:
                total[row] += sums[-size][row] * self.probabilities[at]
            sums.append(total)
            if len(sums) > self.longest:
                del sums[0]
            if total.min() < 1e-100:
                scale += np.log(total)
                sums = [s / total for s in sums]
        return scale + np.log(sums[-1])


class Scorer:
    """Sums word scores over texts, remembering those of chunks between white space; memory is bounded."""

    def __init__(self, segmenter: Segmenter):
        self.segmenter = segmenter
        self.width = segmenter.languages + 1
        self.most = max(1000, 1_500_000 // self.width)
        self.known: dict[str, int] = {}
        self.table = np.empty((0, self.width))

    def _learn(self, chunks: list[str]) -> None:
        runs = [letter_runs(c) for c in chunks]
        distinct = list({r for found in runs for r in found})
        place = {r: at for at, r in enumerate(distinct)}
        scores = np.concatenate((self.segmenter.words(distinct), np.ones((len(distinct), 1))), axis=1)
        of = np.repeat(np.arange(len(chunks)), [len(found) for found in runs])
        rows = np.zeros((len(chunks), self.width))
        np.add.at(rows, of, scores[[place[r] for found in runs for r in found]])
        self.known.update(zip(chunks, range(len(self.table), len(self.table) + len(chunks))))
        self.table = np.concatenate((self.table, rows))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the log likelihoods, and last the number of runs of letters."""
        if len(self.known) > self.most:
            self.known, self.table = {}, np.empty((0, self.width))
        split = [t.split() for t in texts]
        new = list({c for chunks in split for c in chunks if c not in self.known})
        if new:
            self._learn(new)
        return [self.table[list(map(self.known.__getitem__, chunks))].sum(axis=0) for chunks in split]


def _in_parts(texts: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Some texts at a time, of about so many characters or one longer text."""
    part, held = [], 0
    for text in texts:
        part.append(text.as_py())
        held += len(part[-1] or "")
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def piece_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """How often each piece occurs in each language: lang, piece, n; and piece -1, the number of texts.

    Texts are cut by the vocabulary's own segmentation; each task adds up its own rows first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        encode = SentencePieceProcessor(model_file=located(vocabulary)).encode
        known: dict[str, list[int]] = {}
        totals: dict[str, Counter] = {}
        for batch in batches:
            langs = iter(batch.column(0).to_pylist())
            for texts in _in_parts(batch.column(1)):
                chunks: dict[str, Counter] = {}
                for text in texts:
                    lang = next(langs)
                    chunks.setdefault(lang, Counter()).update((text or "").split())
                    totals.setdefault(lang, Counter())[-1] += 1
                if len(known) > 200_000:
                    known = {}
                new = list({c for found in chunks.values() for c in found if c not in known})
                runs = [letter_runs(c) for c in new]
                pieces = iter(encode([r for found in runs for r in found], num_threads=1))
                for chunk, found in zip(new, runs):
                    known[chunk] = [p for _ in found for p in next(pieces)]
                for lang, found in chunks.items():
                    total = totals[lang]
                    for chunk, n in found.items():
                        for piece in known[chunk]:
                            total[piece] += n
        for lang, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(total)), pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())],
                names=["lang", "piece", "n"],
            )

    rows = docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(lambda batches: given_back(count(batches)), "lang string, piece int, n long")
    return counted.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and piece probabilities (pieces x languages) from text and lang of all of ``docs``.

    The counts that reach the driver are at most languages x vocabulary numbers.
    """
    from sentencepiece import SentencePieceProcessor

    size = SentencePieceProcessor(model_file=located(vocabulary)).get_piece_size()
    counted = written(piece_counts(docs, vocabulary))
    texts = counted.where("piece = -1").select("lang", "n").limit(MOST_LANGUAGES + 1).collect()
    if len(texts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    texts.sort()
    languages = [r["lang"] for r in texts]
    prior = np.log(np.array([r["n"] for r in texts], float)) if texts else np.empty(0)
    counts = np.zeros((size, len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    for row in counted.where("piece >= 0").toLocalIterator():
        counts[row["piece"], column[row["lang"]]] = row["n"]
    return languages, prior, (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * size)


class Predictor:
    """Language and posterior of texts, by a fitted model; made once in each task."""

    def __init__(self, model: tuple[list[str], np.ndarray, np.ndarray], vocabulary: str):
        from sentencepiece import SentencePieceProcessor

        self.languages, self.prior, probabilities = model
        pieces = SentencePieceProcessor(model_file=located(vocabulary))
        self.scorer = Scorer(Segmenter([pieces.id_to_piece(i) for i in range(pieces.get_piece_size())], probabilities))

    def __call__(self, texts: pa.Array) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        return [self._best(sums) for part in _in_parts(texts) for sums in self.scorer.texts([t or "" for t in part])]

    def _best(self, sums: np.ndarray) -> tuple[str, float]:
        if not sums[-1]:
            return UNKNOWN, 0.0
        odds = sums[:-1] + self.prior
        best = int(odds.argmax())
        return self.languages[best], 1.0 / float(np.exp(odds - odds[best]).sum())


def identify(docs: DataFrame, training: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text; others are ignored).

    Learns from text and non-null lang of ``training``. A null text, one without letters, and
    any text where nothing was learned get 'und' and score 0; else score is the posterior
    probability. Ties go to the language first in order. Repeated rows are scored alike.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(model.value, vocabulary)
        for batch in batches:
            found = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: given_back(run(batches)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, training: DataFrame, least: float = 0.5, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The rows of ``docs`` whose language is known with a posterior of ``least``, with all their columns.

    Rows pass by in place, whatever their other columns are called; nothing is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training, vocabulary))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(model.value, vocabulary)
        for batch in batches:
            found = predict(batch.column(at))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(lambda batches: given_back(run(batches)), docs.schema)
