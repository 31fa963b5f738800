import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinsift.llm import catalog, kdtree, langid, materialise, mixing, packing, simhash, urls

DATA = "/root/testdata/sf0.001"
NAMES = ["best_fit_packing", "exact_top_k", "training_order", "embedding_near_dedup", "mixing_to_targets", "substring_dedup", "line_dedup", "language_id", "simhash_near_dedup", "url_filters"]


def test_all_ten_and_the_pipeline_are_registered():
    assert list(catalog.QUERIES) == [f"op{n}_{name}" for n, name in enumerate(NAMES, 1)]
    assert {*catalog.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_every_corpus_query_runs(spark):
    rows = {name: query(spark, DATA).count() for name, query in entry.queries().items() if name in catalog.QUERIES or name == "pipeline"}
    assert all(rows.values()), rows


def test_hosts_and_keys(spark):
    cases = {
        "http://user:pw@bad.org/x": ["bad.org", "bad.org/x"],
        "http://a@b@sub.bad.org./": ["sub.bad.org", "bad.org"],
        "http://BAD.org.:8080?x#y": ["bad.org"],
        "http://10.0.0.1:80/a/b": ["10.0.0.1", "10.0.0.1/a", "10.0.0.1/a/b"],
        "http://[2001:db8::1]:443/a": ["[2001:db8::1]", "[2001:db8::1]/a"],
        "http://localhost": ["localhost"],
        "http://user@/x": [],
        "http:///x": [],
        "mailto:a@b.org": [],
        "": [],
        None: [],
        "https://x.org/" + "a" * 100_000 + "/b": ["x.org", "x.org/" + "a" * 100_000, "x.org/" + "a" * 100_000 + "/b"],
    }
    frame = spark.createDataFrame([(n, u) for n, u in enumerate(cases)], "n int, url string")
    got = {r["n"]: r["keys"] for r in frame.select("n", urls.url_keys().alias("keys")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_a_long_text_and_clashing_columns_everywhere(spark):
    long = "the house and of with there " * 40_000
    rows = [(i, f"the house of number {i} and there with", "en", "s", 1) for i in range(30)] + [(90, long, "en", "s", 1), (91, None, None, None, None), (92, "", None, "s", 1)]
    names = ["row", "chance", "tokens", "posterior", "best", "rank", "id", "print", "fingerprint", "lang_pred", "sequence_id", "offset", "certified"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    labelled = spark.createDataFrame([(i, ["clean", "junk"][i % 2]) for i in range(20)], "doc_id long, domain string")
    mixed = mixing.mix(docs, labelled, {"clean": 0.5, "junk": 0.5})
    assert mixed.columns == docs.columns and mixed.where("text is null").count() <= 3
    assert {r["tokens"] for r in mixing.mixture(docs, labelled)[0].where("doc_id = 90").collect()} == {240_000}
    assert simhash.keep_one(docs).columns == docs.columns
    assert langid.keep_identified(docs, docs).columns == docs.columns
    packed = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 90) == 240_001
    written = materialise.materialise(docs, None, 512, 64)
    assert written.agg(F.sum("n_tokens")).first()[0] == sum(r["length"] for r in packed)
    assert written.collect() == written.collect()


def test_ids_of_wide_vocabularies_are_not_cut(spark, tmp_path, monkeypatch):
    assert materialise.token_type() == np.dtype("<u2")
    docs = spark.createDataFrame([("the house of",), (None,)], "text string")
    monkeypatch.setattr(materialise, "token_type", lambda vocabulary: np.dtype("<u4"))
    out = materialise.materialise(docs.coalesce(1), str(tmp_path / "wide"), 4, 2).collect()
    assert [r["n_tokens"] for r in sorted(out, key=lambda r: r["sequence"])] == [4, 1] and {r["offset"] for r in out} == {0, 16}
    assert os.path.getsize(out[0]["file"].removeprefix("file:")) == 32


def test_a_shard_that_is_there_already_stands(tmp_path):
    name = f"file://{tmp_path}/s/shard-00000000.bin"
    for attempt in range(2):
        materialise._put(name, f"file://{tmp_path}/s/.shard-00000000-{attempt}", b"abcd")
    assert os.listdir(tmp_path / "s") == ["shard-00000000.bin"]


def test_certificates(spark):
    exact = packing.best_fit_pack(spark.range(64).selectExpr("id", "512L as length"), 2048)
    assert exact.where("not certified").count() == 0 and exact.select("sequence_id").distinct().count() == 16
    # three of 700 in each bin is what the bound for thirds cannot beat either
    assert packing.best_fit_pack(spark.range(9).selectExpr("id", "1025L as length"), 2048).where("certified").count() == 9


def test_regions_leave_out_what_cannot_reach(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(16, 12)) * 200
    points = np.rint(np.concatenate([c + draw.normal(size=(100, 12)) for c in centres]))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in kdtree.top_k(frame, F.col("vec_id") % 20 == 0, 3, 100, 7).collect()}
    scores = points @ points.T
    for q in range(0, 1600, 20):
        best = sorted((-scores[q, j], j) for j in range(1600) if j != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(j, -s) for s, j in best]
    regions = kdtree.Regions(points, 16)
    at = regions(points)
    assert set(at.tolist()) == set(range(16)) and np.bincount(at).max() <= 250
    boxes = {r: (points[at == r].min(axis=0), points[at == r].max(axis=0)) for r in range(16)}
    queries = spark.createDataFrame([(0, points[0].tolist(), 0, float(np.sort(scores[0])[-4]))], "vec_id long, vector array<double>, home long, bar double")
    assert 1 <= kdtree._reached(queries, boxes, 12).count() <= 4
