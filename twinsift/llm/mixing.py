"""Mixing by soft membership, in DataFrame operations only.

A labelled table trains a naive Bayes classifier over hashed words; it gives every document
a posterior over domains. Document rates are then fitted so that the expected tokens of each
domain, sum of rate x tokens x posterior, meet the targets: of all rates of at least 0 that do,
those nearest to 1. They are max(0, 1 + posterior . multipliers), and Newton steps on the dual
find the multipliers; each trial is one distributed sum of some numbers a pair of domains.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS = 4096
#: Labelled rows that the classifier is fitted on at most: those whose ids' hashes come first.
MOST_LABELLED = 20_000
#: Domains beyond this many are an error: the model and the pairs of domains that a fit sums up grow with them.
MOST_DOMAINS = 64
#: A text's evidence counts as that of this many words at most, so that long texts stay soft.
EVIDENCE = 64
#: Trials of multipliers before a fit that still moves is an error; the largest miss that is met, as a part of all tokens.
STEPS, TOLERANCE = 30, 1e-4
#: Weight of the squared multipliers, which keeps the fit bounded where no rates meet the targets.
_RIDGE = 1e-8
#: Sums are of whole 2**-20ths, so that they come out alike however rows are dealt.
_UNIT = 1 << 20
#: The same for Gram matrices, whose rounding has to stay well below the ridge.
_FINE = 1 << 40


@dataclass(frozen=True)
class Classifier:
    """Domains in order, and per domain its log prior and the log probabilities of the buckets."""

    domains: list[str]
    prior: list[float]
    weights: list[list[float]]


def _literal(values: list, kind: str) -> Column:
    """A constant array; folded once when the query is planned."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def word_buckets(text: str = "text") -> Column:
    """The buckets of all words of a text between blanks, tabs and new lines; none for a null text."""
    words = F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\r", "   "), " "), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, most: int = MOST_LABELLED) -> Classifier:
    """Fit on the texts of ``labelled`` (doc_id, domain; nulls are left out), of at most ``most`` rows.

    What reaches the driver is domains x buckets counts, of ``MOST_DOMAINS`` domains at most. A
    domain is learned if a labelled document of it is there; without any there are no domains.
    """
    rows = labelled.where("doc_id is not null and domain is not null").select(F.col("doc_id").alias("id"), F.col("domain").cast("string").alias("domain"))
    sample = rows.distinct().orderBy(F.xxhash64("id"), "id", "domain").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    found = texts.select("domain", word_buckets().alias("words"))
    # a bucket of -1 counts the documents themselves
    counts = found.select("domain", F.explode(F.concat(F.array(F.lit(-1)), "words")).alias("bucket")).groupBy("domain", "bucket").count()
    by: dict[str, dict[int, int]] = {}
    for row in counts.limit(MOST_DOMAINS * (BUCKETS + 1) + 1).collect():
        by.setdefault(row["domain"], {})[row["bucket"]] = row["count"]
    if len(by) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    domains = sorted(by)
    documents = {d: by[d].pop(-1) for d in domains}
    total = sum(documents.values())
    weights = []
    for d in domains:
        n = sum(by[d].values()) + BUCKETS
        weights.append([math.log((by[d].get(b, 0) + 1) / n) for b in range(BUCKETS)])
    return Classifier(domains, [math.log(documents[d] / total) for d in domains], weights)


def _evidence(weights: list[float]) -> Column:
    table = _literal(weights, "array<double>")
    return F.aggregate("words", F.lit(0.0), lambda s, bucket: s + F.element_at(table, bucket + 1))


def with_posteriors(rows: DataFrame, model: Classifier) -> DataFrame:
    """``rows`` (with text) and their tokens (words of text) and posterior (one number for each domain, in order)."""
    out = rows.withColumn("words", word_buckets()).withColumn("tokens", F.size("words").cast("long"))
    if not model.domains:
        return out.drop("words").withColumn("posterior", F.array().cast("array<double>"))
    damp = F.lit(float(EVIDENCE)) / (F.lit(float(EVIDENCE)) + F.col("tokens"))
    logits = [F.lit(model.prior[k]) + _evidence(model.weights[k]) * damp for k in range(len(model.domains))]
    out = out.withColumn("logits", F.array(*logits)).drop("words")
    best = F.array_max("logits")
    out = out.withColumn("odds", F.transform("logits", lambda x: F.exp(x - best)))
    total = F.aggregate("odds", F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("posterior", F.transform("odds", lambda x: x / total)).drop("logits", "odds")


def rate(multipliers: list[float]) -> Column:
    """A document's rate: 1 and its posterior's share of the multipliers, no lower than 0."""
    along = sum((F.col("posterior")[k] * m for k, m in enumerate(multipliers)), F.lit(1.0))
    return F.greatest(F.lit(0.0), along)


def fit_rates(members: DataFrame, domains: list[str], targets: Mapping[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[float]:
    """The multipliers, one a domain, that bring its expected tokens to its part of all tokens.

    ``members`` has tokens and posterior; ``targets`` are weights by domain (0 if not
    named). Targets that no rates meet get the nearest totals and a warning with the misses; a
    fit that has not come to rest after ``steps`` trials is an error.
    """
    if not domains:
        return []
    weight = np.array([float(targets.get(d, 0.0)) for d in domains])
    if weight.min() < 0 or weight.sum() <= 0:
        raise ValueError("targets are weights of at least 0, and not all 0")
    size = len(domains)
    pairs = [(k, j) for k in range(size) for j in range(k + 1)]

    def sums(multipliers: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Expected tokens by domain, half the tokens at squared rates, and the pairs' Gram matrix over documents that stay."""
        p, share = F.col("posterior"), F.col("rate") * F.col("tokens")
        stays = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0)
        parts = [(share * p[k], _UNIT) for k in range(size)] + [(share * F.col("rate") / 2, _UNIT)] + [(stays * p[k] * p[j], _FINE) for k, j in pairs]
        rated = members.select("tokens", "posterior", rate(multipliers.tolist()).alias("rate"))
        row = rated.select(*[F.sum(F.round(x * unit).cast("decimal(38,0)")).alias(f"s{n}") for n, (x, unit) in enumerate(parts)]).first()
        got = np.array([float(x or 0) / unit for x, (_, unit) in zip(row, parts)])
        gram = np.zeros((size, size))
        for (k, j), x in zip(pairs, got[size + 1 :]):
            gram[k, j] = gram[j, k] = x
        return got[:size], float(got[size]), gram

    at = np.zeros(size)
    now, energy, gram = sums(at)
    total = float(now.sum())
    target = weight / weight.sum()
    if not total:
        return at.tolist()

    def height(multipliers: np.ndarray, energy: float) -> float:
        return energy / total - float(multipliers @ target) + _RIDGE / 2 * float(multipliers @ multipliers)

    tried, length, fresh = 0, 1.0, True
    while np.abs(now / total - target).max() > tolerance:
        if fresh:
            slope = now / total - target + _RIDGE * at
            if np.abs(slope).max() <= tolerance / 100:
                missed = ", ".join(f"{d} {x:.4f} for {t:.4f}" for d, x, t in zip(domains, now / total, target))
                warnings.warn(f"no rates meet the targets; parts of all tokens: {missed}", stacklevel=2)
                break
            way = -np.linalg.solve(gram / total + _RIDGE * np.eye(size), slope)
        if tried == steps:
            raise RuntimeError(f"the mixture has not come to rest after {steps} trials; parts of all tokens: {dict(zip(domains, (now / total).tolist()))}")
        tried += 1
        there = at + length * way
        found = sums(there)
        # heights are compared as finely as doubles of their size are
        before = height(at, energy)
        fresh = height(there, found[1]) <= before + 1e-4 * length * float(slope @ way) + 1e-12 * (1 + abs(before))
        if fresh:
            at, (now, energy, gram), length = there, found, 1.0
        else:
            length /= 2
    return at.tolist()


#: Aimed parts of all tokens by domain.
TARGETS = {"clean": 0.90, "junk": 0.08, "toxic": 0.02}


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain from a table of labels (doc_id, quality 0/1, toxic 0/1); null labels give no domain."""
    domain = F.when(F.col("quality") == 0, "junk").when((F.col("quality") == 1) & (F.col("toxic") == 1), "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))


def _chance() -> Column:
    """A number from 0 up to 1 that follows from doc_id and text."""
    return F.expr("shiftrightunsigned(xxhash64(doc_id, text, 5L), 11)") / F.lit(float(1 << 53))


def _copies(multipliers: list[float]) -> Column:
    """A whole number of copies whose expectation is the rate; chance decides the rest."""
    return F.floor(rate(multipliers) + F.col("chance")).cast("long")


def _fitted(docs: DataFrame, rows: DataFrame, labelled: DataFrame, targets: Mapping[str, float]) -> tuple[DataFrame, Classifier, list[float]]:
    """``rows`` (with text, and chance) written with their tokens and posteriors but without text, the model, and the multipliers."""
    model = fit_classifier(docs, labelled)
    members = written(with_posteriors(rows, model).drop("text"))
    return members, model, fit_rates(members, model.domains, targets)


def mixture(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS) -> tuple[DataFrame, list[str]]:
    """doc_id, tokens, posterior, rate and copies of every row of ``docs`` (doc_id, text; others are ignored); and the domains in order.

    Texts are read once more than the classifier's sample. Null and empty texts have no tokens
    and the prior's posterior; repeated rows get the same numbers. Without labelled documents
    there are no domains: posteriors are empty, and every rate is 1. No rows give none.
    """
    members, model, multipliers = _fitted(docs, docs.select("doc_id", "text", _chance().alias("chance")), labelled, targets)
    return members.select("doc_id", "tokens", "posterior", rate(multipliers).alias("rate"), _copies(multipliers).alias("copies")), model.domains


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with their columns untouched whatever their names; see :func:`mixture`.

    Rows are written with their posteriors, which would else be made anew for every use of them.
    """
    # the row travels as one column, so that no name of its columns can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", _chance().alias("chance"))
    members, _, multipliers = _fitted(docs, rows, labelled, targets)
    repeated = members.select("row", F.explode(F.array_repeat(F.lit(1), _copies(multipliers).cast("int"))).alias("copy"))
    return repeated.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
