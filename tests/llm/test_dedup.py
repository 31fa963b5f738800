import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from twinsift.llm import lattice, lines, recompression, simhash
from twinsift.llm.graph import connected_components

TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (3, None),
    (4, ""),
    (7, " \t\n"),
    (8, "two words"),
    (8, "two words"),
    (None, "quite another text of some seven words"),
    (2, "x " * 20000),
    (9, "start alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi end"),
]


def _union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, 201 + i) for i in range(50)]
    got = {}
    for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(61)), [100, 101, 102], list(range(200, 251))]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_against_comparing_all(spark, documents):
    rows = TEXTS + [(100 + i, " ".join(f"w{j}" for j in range(i % 5, 40)) + (" tail" if i % 2 else "")) for i in range(30)]
    got = {(r["doc_id"], r["fingerprint"] & (1 << 64) - 1): r["component_id"] for r in simhash.near_duplicates(documents(rows)).collect()}
    prints = [_fingerprint(t) for _, t in rows]
    roots = _union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {r: min((i for (i, _), s in zip(rows, roots) if s == r and i is not None), default=None) for r in roots}
    assert got == {(i, p): least[r] for (i, _), p, r in zip(rows, prints, roots)}
    kept = simhash.keep_one(documents(rows))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({v for v in least.values() if v is not None})
    assert kept.columns == documents(rows).columns
    assert simhash.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_links_join_what_is_near(spark, block):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 62, 5)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in draw.choice(62, k, False)) for b in base for k in (0, 1, 2, 3, 4, 6) for _ in range(12)})
    found = simhash.print_links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), 4, block).collect()
    at = {p: i for i, p in enumerate(prints)}
    expected = _union(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert all((r["a"] ^ r["b"]).bit_count() <= 4 for r in found)
    assert _union(len(prints), [(at[r["a"]], at[r["b"]]) for r in found]) == expected


@pytest.mark.parametrize("part, remembered", [(1_000_000, 500_000), (300, 500_000), (300, 5)])
def test_windows_against_brute_force(spark, documents, part, remembered):
    draw = np.random.default_rng(2)
    rows = list(TEXTS)
    passage = [f"p{i}" for i in range(60)]
    for i in range(40):
        words = [f"v{x}" for x in draw.integers(0, 4 if i % 4 == 0 else 1000, 60)]
        at = int(draw.integers(0, 60))
        rows.append((100 + i, " ".join(words[:at] + passage[at // 2 : at // 2 + int(draw.integers(5, 40))] + words[at:])))
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept"]) for r in recompression.drop_repeated_windows(documents(rows), part=part, remembered=remembered).collect())
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    expected = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        expected.append((-1 if i is None else i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    assert got == sorted(expected)
    assert recompression.drop_repeated_windows(documents([])).count() == 0


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(3)
    seen = {}
    for symbols in (2, 3, 50):
        for _ in range(400):
            codes = recompression._mixed(draw.integers(0, symbols, int(draw.integers(1, 60))).astype(np.uint64) + np.uint64(9))
            hashes = recompression.window_hashes(codes, 9)
            for at, anchor in enumerate(recompression.window_anchors(codes, hashes, 9).tolist()):
                assert seen.setdefault(tuple(codes[at : at + 9].tolist()), anchor) == anchor


def test_lines(spark, documents):
    own = [f"{c}wn {c}ext {c}umber here" for c in "abcdefghijkl"]
    rows = [(i, f"{own[i]}\nPosted by user{i} on day {i}\nAll rights reserved.\nshort") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "Posted by someone else today"), (None, "All rights reserved."), (0, rows[0][1])]
    out = lines.drop_recurring_lines(documents(rows))
    assert out.columns == [*documents([]).columns, "n_lines", "n_dropped"]
    by = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert by[(None, "All rights reserved.")] == (1, 0)  # a null id comes first
    assert by[(5, own[5])] == (4, 3)
    assert by[(0, f"{own[0]}\nPosted by user0 on day 0\nshort")] == (4, 1)
    assert by[(50, None)] == (0, 0) and by[(51, "")] == (1, 0) and by[(52, "Posted by someone else today")] == (1, 0)
    assert lines.drop_recurring_lines(documents([])).count() == 0


def test_lines_keep_columns_of_any_name(spark):
    rows = [(i, f"own {i}th line of text\nAll rights reserved.", "a", 7, "b", "c") for i in "abcdefghijkl"]
    docs = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "doc_id long, text string, id string, n_lines int, N_Dropped string, drops string")
    out = lines.drop_recurring_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    assert {tuple(r)[2:] for r in out.where("doc_id > 0").collect()} == {("a", 7, "b", "c", 2, 1)}


def test_very_long_text_of_lines(spark, documents):
    body = "\n".join(f"{'abcdefghij'[i % 10] * (i % 97 + 1)} {'klmnopqrst'[i // 10 % 10] * (i // 1000 + 1)} {i}x" for i in range(30000))
    rows = [(i, "A line that many documents have") for i in range(12)] + [(50, body + "\nA line that many documents have")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.drop_recurring_lines(documents(rows)).collect()}
    assert got[50][0] == 30001 and got[50][1] >= 1 and got[3] == (1, 1)


def test_lines_that_share_their_lead_only(spark, documents):
    ends = [["apple"], ["red", "brick"], ["very", "old", "song"]]
    kept = [" ".join(["This is a", *(f"{w}{'abcdefghijkl'[i]}" for w in end)]) for end in ends for i in range(12)]
    rows = [(k, f"{line}\nThis is a page by author {k}\nThis is a {k}") for k, line in enumerate(kept)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(documents(rows)).select("doc_id", "text").collect()}
    assert got == {k: line for k, line in enumerate(kept)} | {0: rows[0][1]}


def test_short_lines_go_in_the_pipeline(spark, documents):
    own = [f"{c}wn" for c in "abcdefghijkl"]
    rows = [(i, f"{own[i]}\nLes.\nPage {i}\n\n{i}\n{own[i]} line") for i in range(12)] + [(20, "Les. Page"), (21, None), (22, "")]
    docs = documents(rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.without_recurring_lines(spark, docs, "").collect()}
    expected = {i: t for i, t in rows} | {i: f"{own[i]}\n\n{i}\n{own[i]} line" for i in range(1, 12)}
    assert got == {i: (t, None if t is None else len(t)) for i, t in expected.items()}


def test_lattice_points():
    steps = lattice.minimal_vectors()
    assert steps.shape == (240, 8) and np.allclose((steps**2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(size=(500, 8))
    at = lattice.decode(x)
    assert ((at * 2) == np.rint(at * 2)).all() and ((at.sum(axis=1) % 2) == 0).all()
    gap = ((x - at) ** 2).sum(axis=1)
    assert (gap <= 1 + 1e-9).all()
    for step in steps:
        assert (((x - at - step) ** 2).sum(axis=1) >= gap - 1e-9).all()


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors_against_comparing_all(spark, block):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(30, 16))
    # copies, near copies that are surely met (cosine of 0.99 and more) and, past id 150, pairs around the threshold
    rows = [(i, [float(v) for v in base[i % 30 if i % 2 else 0] + draw.normal(size=16) * 0.02 * (i % 3)]) for i in range(150)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] * 16), (204, []), (205, rows[0][1]), (206, [2 * v for v in rows[0][1]]), (None, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(frame, block=block).collect()}
    sound = [i for i, (_, v) in enumerate(rows) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    units = np.array([rows[i][1] for i in sound])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= 0.95
    roots = _union(len(rows), [(sound[a], sound[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    links = dict.fromkeys(range(len(rows)), 0) | {i: int(near[k].sum()) - 1 for k, i in enumerate(sound)}
    assert sum(links.values()) > 6000
    assert got == {i: (links[at], rows[roots[at]][0], rows[roots[at]][0] == i) for at, (i, _) in enumerate(rows)}
    assert lattice.near_vectors(frame.limit(0)).count() == 0


def test_most_pairs_at_the_threshold_are_met(spark):
    draw = np.random.default_rng(8)
    a = draw.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    across = draw.normal(size=(600, 64))
    across -= (across * a).sum(axis=1, keepdims=True) * a
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    b = 0.955 * a + np.sqrt(1 - 0.955**2) * across
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate((a, b)))], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_vectors(frame).collect()}
    met = [i for i in range(600) if found[i][0]]
    assert len(met) >= 590 and all(found[i] == found[600 + i] == (1, i) for i in met)
