import numpy as np

import corpus_pipeline
from twinsift.llm import tokens

BOILERPLATE = "All rights reserved by the owner"


def test_stages_and_run(spark, tmp_path):
    draw = np.random.default_rng(1)
    vocabulary = {"en": [f"th{c}re" for c in "abcdefghijklmnop"], "de": [f"sch{c}n" for c in "abcdefghijklmnop"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        text = " ".join(draw.choice(vocabulary[lang], 80).tolist())
        rows.append((i, f"{text}\n{BOILERPLATE}" if i < 20 else text, lang, "s", 0))
    rows += [(100, rows[30][1], "de", "s", 0), (101, None, None, "s", 0), (102, "12 34", None, "s", 0), (103, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), schema)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    known, lines, single, mixed = kept
    assert set(known) == {*range(60), 100}
    assert sum(BOILERPLATE in t for t in lines.values()) == 1 and set(lines) == set(known)
    assert all(lines[i] == rows[i][1] for i in range(20, 60))
    assert set(single) == set(range(60))
    assert mixed == single and docs.count() == len(single)  # one domain: every rate is 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    encoder = tokens.ChunkedEncoder()
    assert sum(r["length"] for r in packed) == sum(len(encoder.encode(r["text"])) // 4 + 1 for r in docs.collect())
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, run)) == sorted(map(key, packed))


def test_stages_of_empty_tables_and_without_labels(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"the house of number {i} and there with the old garden", "en", "s", 0) for i in range(5)]
    for n, docs in enumerate((spark.createDataFrame([], schema), spark.createDataFrame(rows, schema))):
        top = tmp_path / str(n)
        docs.write.parquet(str(top / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(top))
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
        assert (out.count() > 0) == (n > 0)
