
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.llm import kdtree, langid, materialise, mixing, tokens, urls


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba"]
    weights = np.random.default_rng(1).random((len(pieces), 2))
    rows = dict(zip(pieces, weights))

    def every(text):
        if not text:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(text) + 1):
            if text[:n] in rows:
                total = total + rows[text[:n]] * every(text[n:])
        return total

    got = langid.Segmenter(pieces, weights).words(["a", "abab", "bba", "a" * 500])
    for word, logs in zip(["a", "abab", "bba"], got):
        assert np.allclose(np.exp(logs), every("▁" + word), rtol=1e-5)
    assert np.isfinite(got).all()


def test_languages(spark, documents):
    words = {"en": "the house of and with there", "de": "das haus und mit der nicht", "fr": "la maison et avec les dans"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[lang].split(), 12).tolist())) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    frame = documents(rows).withColumn("lang", F.element_at(F.array(*map(F.lit, ["en", "de", "fr"])), (F.col("doc_id") % 3 + 1).cast("int")))
    more = documents([(90, None), (91, ""), (92, "123 !! 456"), (None, "das haus und der"), (93, "x" * 3000)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(frame.unionAll(more), frame.where(~langid.held_out())).collect()}
    assert all(got[i][0] == ["en", "de", "fr"][i % 3] for i in range(60))
    assert got[90] == got[91] == got[92] == ("und", 0.0) and got[None][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = langid.keep_identified(frame.unionAll(more), frame)
    assert kept.columns == frame.columns and {90, 91, 92}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.where("doc_id < 60").count() == 60
    nothing = langid.identify(more, frame.limit(0)).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]
    assert langid.identify(frame.limit(0), frame).count() == 0


def test_mixture_meets_targets(spark, documents):
    draw = np.random.default_rng(0)
    kinds = {"clean": "good fine well", "junk": "spam buy now", "toxic": "idiot trash scum"}
    names = list(kinds)
    rows = [(i, " ".join(draw.choice(kinds[names[i % 3]].split() + ["the", "of"], 40).tolist())) for i in range(90)] + [(200, None), (201, ""), (0, None)]
    labelled = spark.createDataFrame([(i, names[i % 3]) for i in range(45)] + [(None, "clean"), (3, None)], "doc_id long, domain string")
    targets = {"clean": 0.6, "junk": 0.3, "toxic": 0.1}
    mixed, domains = mixing.mixture(documents(rows), labelled, targets)
    out = mixed.collect()
    assert domains == names and len(out) == len(rows)
    tokens_of = np.array([r["tokens"] for r in out], float)
    posterior = np.array([r["posterior"] for r in out])
    rates = np.array([r["rate"] for r in out])
    assert np.allclose(posterior.sum(axis=1), 1)
    got = (rates * tokens_of) @ posterior / tokens_of.sum()
    assert (rates >= 0).all() and np.abs(got - [0.6, 0.3, 0.1]).max() < 1e-3
    # brute force: the same projected steps in numpy
    r, first = np.ones(len(out)), tokens_of @ posterior
    target = np.array([0.6, 0.3, 0.1]) * tokens_of.sum()
    for _ in range(mixing.STEPS):
        now = (r * tokens_of) @ posterior
        if np.abs(now - target).max() <= mixing.TOLERANCE * tokens_of.sum():
            break
        r = np.maximum(0, r - posterior @ ((now - target) / first))
    assert np.allclose(r, rates, atol=1e-4)
    back = mixing.mix(documents(rows), labelled, targets)
    assert back.columns == documents([]).columns and back.count() == sum(x["copies"] for x in out)
    assert mixing.quality_domains(spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")).where("domain is null").count() == 1
    for docs, labels in ((documents([]), labelled), (documents(rows), labelled.limit(0)), (documents(rows), labelled.where("domain is null"))):
        unlabelled, none = mixing.mixture(docs, labels, targets)
        assert none == [] and all((r["posterior"], r["rate"], r["copies"]) == ([], 1.0, 1) for r in unlabelled.collect())
        assert sorted(map(str, mixing.mix(docs, labels, targets).collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(ValueError, match="domains"):
        mixing.mixture(documents(rows), spark.createDataFrame([(i, f"d{i}") for i in range(90)], "doc_id long, domain string"), targets)


def _members(spark, posterior, tokens_of):
    rows = [(int(t), [float(x) for x in p]) for t, p in zip(tokens_of, posterior)]
    return spark.createDataFrame(rows, "tokens long, posterior array<double>")


def test_overlapping_domains_meet_targets(spark):
    draw = np.random.default_rng(6)
    odds = np.exp(draw.normal(size=(400, 3)) * 0.3 + [2.0, 0.5, 0.0])
    posterior, tokens_of = odds / odds.sum(axis=1, keepdims=True), draw.integers(1, 500, 400)
    members = _members(spark, posterior, tokens_of)
    aimed = np.array([0.78, 0.15, 0.07])
    multipliers = mixing.fit_rates(members, list("abc"), dict(zip("abc", aimed)))
    rates = np.array([r[0] for r in members.select(mixing.rate(multipliers)).collect()])
    assert (rates >= 0).all() and (rates == 0).any()
    assert np.abs((rates * tokens_of) @ posterior / tokens_of.sum() - aimed).max() <= mixing.TOLERANCE


def test_targets_out_of_reach_are_reported(spark):
    members = _members(spark, [[0.5, 0.5]] * 20 + [[0.6, 0.4]] * 20, [10] * 40)
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        multipliers = mixing.fit_rates(members, ["a", "b"], {"a": 0.9, "b": 0.1})
    # all from the second kind, as near to both targets as it comes
    rates = np.array([r[0] for r in members.select(mixing.rate(multipliers)).collect()])
    assert np.allclose(rates, [0] * 20 + [2 * 0.58 / 0.52] * 20, atol=1e-3)


def test_search_against_all(spark):
    draw = np.random.default_rng(7)
    rows = [(i, draw.integers(-20, 20, 8).astype(float).tolist()) for i in range(700)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1050, None), (1100, [float("inf")] * 8), (1150, [None] * 8), (1200, [3.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = sorted(map(tuple, kdtree.top_k(frame, F.col("vec_id") % 50 == 0, 5, 128, 5).select("query_id", "rank", "vec_id", "score").collect()))
    sound = [(i, np.pad(v, (0, 8 - len(v)))) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    expected = []
    for i, q in sound:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in sound if j != i)[:5]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(expected)
    assert kdtree.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_permutation_and_round_trip(spark, documents, tmp_path):
    for count in (1, 2, 3, 17, 1000):
        assert sorted(materialise.Feistel(count)(np.arange(count)).tolist()) == list(range(count))
    rows = [(i, "the house of " * (i * 3)) for i in range(40)] + [(50, None), (51, ""), (50, None)]
    docs = documents(rows).coalesce(1)
    out = materialise.materialise(docs, str(tmp_path / "shards"), 64, 8).collect()
    encoder = tokens.ChunkedEncoder()
    stream = b"".join(encoder.encode(t) + b"\0" * 4 for _, t in rows)
    ids = np.frombuffer(stream, "<u4").astype("<u2").tobytes()
    count = -(-len(ids) // 128)
    assert sorted(r["slot"] for r in out) == list(range(count))
    parts = {}
    for r in out:
        with open(r["file"].removeprefix("file:"), "rb") as file:
            file.seek(r["offset"])
            parts[r["sequence"]] = file.read(128)[: 2 * r["n_tokens"]]
        assert r["shard"] == r["slot"] // 8
    assert b"".join(parts[i] for i in range(count)) == ids
    assert materialise.materialise(documents([]), str(tmp_path / "none")).count() == 0


def test_url_lists_in_time(spark):
    entries = [("bad.org", "block", 10), ("bad.org", "allow", 20), ("bad.org", "block", 20), ("x.bad.org", "allow", 15), ("y.org/a/b", "block", 0), (None, "block", 0), ("z", "block", None)]
    captures = [(1, "http://x.bad.org/p?q", 12, "k"), (2, "http://x.bad.org/", 15, "k"), (3, "http://bad.org:80/", 9, "k"), (4, "http://bad.org", 25, "k"), (5, "https://Y.org/a/b/c", 1, "k"), (6, "https://y.org/a", 1, "k"), (7, None, 1, "k"), (8, "nonsense", 1, "k"), (9, "http://bad.org", None, "k"), (1, "http://x.bad.org/p?q", 12, "k")]
    frame = spark.createDataFrame(captures, "capture_id long, url string, fetched_at long, key string")
    got = sorted((r["capture_id"], r["key"], r["blocked"]) for r in urls.filter_captures(frame, spark.createDataFrame(entries, "key string, action string, listed_at long")).collect())
    assert got == [(1, "bad.org", True), (1, "bad.org", True), (2, "x.bad.org", False), (3, None, False), (4, "bad.org", True), (5, "y.org/a/b", True), (6, None, False), (7, None, False), (8, None, False), (9, None, False)]
    assert urls.filter_captures(frame.limit(0), spark.createDataFrame([], "key string, action string, listed_at long")).count() == 0
