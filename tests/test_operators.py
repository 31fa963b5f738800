import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.operators import cache, group, keep, match, view
from twinsift.operators.order import indexed
from twinsift.sources import files as scans


def hashed(spark, values):
    rows = [(i, bytearray(v.to_bytes(32, "little"))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "idx long, hash binary")


def greedy(values, most):
    group_of = {}
    for i, v in enumerate(values):
        if i in group_of:
            continue
        for j in range(i, len(values)):
            if j not in group_of and (v ^ values[j]).bit_count() <= most:
                group_of[j] = i
    return group_of


def grouped(spark, values, most):
    return {r["idx"]: r["leader_idx"] for r in group.representative_members(hashed(spark, values), most, True).collect()}


def test_groups_are_not_transitive_and_order_matters(spark):
    a, b, c = 0, 0b1111, 0b11111111
    assert grouped(spark, [a, b, c], 4) == {0: 0, 1: 0, 2: 2}
    assert grouped(spark, [b, a, c], 4) == {0: 0, 1: 0, 2: 0}


@pytest.mark.parametrize("seed, most", [(1, 3), (2, 6)])
def test_groups_follow_the_sequential_rule(spark, seed, most):
    draw = random.Random(seed)
    base = [draw.getrandbits(256) for _ in range(6)]
    values = [draw.choice(base) ^ sum(1 << draw.randrange(256) for _ in range(draw.randrange(6))) for _ in range(80)]
    assert grouped(spark, values, most) == greedy(values, most)


@pytest.mark.parametrize("task_edges", [0, 40, 10**6])
def test_rounds_and_the_sequence_agree(spark, task_edges):
    draw = random.Random(9)
    edges = sorted({tuple(sorted(draw.sample(range(90), 2))) for _ in range(200)} | {(i, i + 1) for i in range(100, 112)})
    nodes = spark.range(120).withColumnRenamed("id", "rep")
    got = {r["rep"]: r["leader"] for r in group.leaders(nodes, spark.createDataFrame(edges, "lo long, hi long"), task_edges).collect()}
    expected = {}
    for i in range(120):
        heads = [lo for lo, hi in edges if hi == i and expected[lo] == lo]
        expected[i] = min(heads, default=i)
    assert got == expected


def test_bands_find_what_comparing_all_finds(spark):
    draw = random.Random(3)
    values = [draw.choice([0, 1 << 255, (1 << 200) - 1]) ^ sum(1 << draw.randrange(256) for _ in range(draw.randrange(8))) for _ in range(60)]
    distinct = match.collapsed(hashed(spark, values))
    for most in (0, 4, 9):
        expected = sorted(tuple(r) for r in match.nested_pairs(distinct, most).collect())
        assert sorted(tuple(r) for r in match.banded_pairs(distinct, most).collect()) == expected
        assert sorted(tuple(r) for r in match.banded_pairs(distinct, most, 1).collect()) == expected
    assert [match.radius_for(n, 16) for n in (10**3, 10**6, 10**9)] == [0, 1, 1] and match.radius_for(10**9, 4) == 0
    assert sorted(map(tuple, match.representatives(hashed(spark, [5, 7, 5])).collect())) == [(0, 0), (1, 1), (2, 0)]


def near(values, most):
    """rep, rep and distance of all that are near, for different values."""
    found = np.array([list(v.to_bytes(32, "little")) for v in values], np.uint8).view(np.uint64)
    dist = sum(np.bitwise_count(found[:, None, w] ^ found[None, :, w]).astype(int) for w in range(4))
    return sorted((i, j, int(dist[i, j])) for i, j in np.argwhere((dist <= most) & (np.arange(len(found))[:, None] < np.arange(len(found)))).tolist())


def test_blocks_compare_each_pair_once(spark):
    draw = random.Random(4)
    sparse = [draw.getrandbits(24) for _ in range(1400)]
    values = list(dict.fromkeys(sparse + [draw.getrandbits(256) for _ in range(1200)] + [0, (1 << 256) - 1]))
    values += list(dict.fromkeys(v ^ 1 << 90 for v in values[1500:1600]))
    distinct = match.collapsed(hashed(spark, values))
    for most in (0, 2, 6):
        assert sorted(map(tuple, match.block_pairs(distinct, most).collect())) == near(values, most)
    assert match.block_pairs(distinct.limit(0), 4).count() == 0


@pytest.mark.parametrize("most, radius", [(4, 0), (8, 0), (9, 1), (16, 1)])
def test_a_crowd_at_a_place_is_compared_in_blocks(spark, monkeypatch, most, radius):
    """Short texts have hashes that end in zeros: their places are crowded, and a join there makes a row for every two."""
    draw = random.Random(most)
    values = list(dict.fromkeys([draw.getrandbits(30) for _ in range(400)] + [draw.getrandbits(256) for _ in range(60)]))
    values += [v ^ sum(1 << b for b in draw.sample(range(256), draw.randrange(1, most + 2))) for v in values[380:]]
    sent, blocks = [], match.block_pairs

    def counted(distinct, most):
        sent.append(distinct.count())
        return blocks(distinct, most)

    monkeypatch.setattr(match, "block_pairs", counted)
    distinct = match.collapsed(hashed(spark, values))
    assert sorted(map(tuple, match.banded_pairs(distinct, most, radius).collect())) == near(values, most)
    assert 390 < sent[0] < len(values)


def test_places_are_never_broadcast(spark):
    pairs = match.banded_pairs(match.collapsed(hashed(spark, [5, 7, 1 << 200])), 16, 1)
    assert "SortMergeJoin [place" in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [(0, 1, 1), (0, 2, 3), (1, 2, 4)]


@pytest.mark.parametrize("most", [4, 16])
def test_a_crowd_is_grouped_without_its_pairs(spark, monkeypatch, most):
    draw = random.Random(most)
    values = list(dict.fromkeys([draw.getrandbits(most + 6) for _ in range(500)] + [draw.getrandbits(256) for _ in range(30)]))
    draw.shuffle(values)
    made, leaders = [], group.leaders

    def counted(nodes, pairs, *more):
        made.append(pairs.count())
        return leaders(nodes, pairs, *more)

    monkeypatch.setattr(group, "leaders", counted)
    distinct = match.collapsed(hashed(spark, values))
    for task_hashes in (100, 0):
        led = {r["rep"]: r["leader"] for r in group.near_leaders(distinct, most, 100, task_hashes).collect()}
        assert led == greedy(values, most)
    assert 0 < sum(made) * 10 < len(near(values, most))
    assert group.near_leaders(distinct.limit(0), most).count() == 0


@pytest.mark.parametrize("most", [4, 16])
def test_some_thousand_hashes_are_grouped_by_one_task(spark, monkeypatch, most):
    """Each stretch takes a dozen jobs, and on check_h each job 211 tasks; so few hashes take none."""

    def never(*_):
        raise AssertionError("a second stretch")

    monkeypatch.setattr(group, "least_near", never)
    draw = np.random.default_rng(most)
    found = draw.integers(0, 1 << 63, (4, 9_000))
    for n in range(3_000, 9_000):
        found[:, n] = found[:, draw.integers(n)]
        for bit in draw.integers(0, 63, draw.integers(1, most + 2)).tolist():
            found[draw.integers(4), n] ^= 1 << bit
    lead = np.full(9_000, -1)
    for k in range(9_000):
        if lead[k] < 0:
            lead[(lead < 0) & (np.bitwise_count(found ^ found[:, k : k + 1]).sum(axis=0, dtype=np.int64) <= most)] = k
    rows = [(n, *row) for n, row in enumerate(found.T.tolist())]
    led = group.near_leaders(spark.createDataFrame(rows, "rep long, w0 long, w1 long, w2 long, w3 long"), most)
    assert {r["rep"]: r["leader"] for r in led.collect()} == dict(enumerate(lead.tolist())) and 3_000 < len(set(lead.tolist())) < 8_000


@pytest.mark.parametrize("count, stretches", [(900, 0), (5_000, 1)])
def test_hashes_of_which_few_are_near_take_few_stretches(spark, monkeypatch, count, stretches):
    """A stretch takes dozens of jobs, and doubling ones from 100 hashes on would be 4 and 6."""
    draw = random.Random(count)
    values = [draw.getrandbits(256) for _ in range(count)]
    for n in range(count // 2, count):
        values[n] = values[draw.randrange(n)] ^ sum(1 << b for b in draw.sample(range(256), draw.randrange(1, 4)))
    values = list(dict.fromkeys(values))
    held, least_near = [], group.least_near
    monkeypatch.setattr(group, "least_near", lambda *x: held.append(0) or least_near(*x))
    monkeypatch.setattr(group, "NEIGHBOURS", {900: 32, 5_000: 4}[count])
    distinct = match.collapsed(hashed(spark, values))
    wanted = group.sparse_most(distinct, len(values), 4)
    assert abs(wanted * 2 * len(near(values, 4)) - group.NEIGHBOURS * len(values) ** 2) < wanted * len(values)
    led = {r["rep"]: r["leader"] for r in group.near_leaders(distinct, 4, 100, 100).collect()}
    assert led == greedy(values, 4) and len(held) <= stretches


@pytest.mark.parametrize("most", [4, 8])
def test_short_texts_are_no_crowd_in_strided_segments(spark, monkeypatch, most):
    """Short texts set the first bits only: whole segments after them are zero, and all their hashes went to blocks."""
    draw = random.Random(most)
    values = [draw.getrandbits(100) for _ in range(500)]
    values += [v ^ sum(1 << b for b in draw.sample(range(256), draw.randrange(1, most + 3))) for v in values[400:]]
    sent, blocks = [], match.block_pairs
    monkeypatch.setattr(match, "block_pairs", lambda distinct, most: sent.append(distinct.count()) or blocks(distinct, most))
    assert sorted(map(tuple, match.hash_pairs(match.collapsed(hashed(spark, values)), most, 100).collect())) == near(values, most)
    assert sent == [0]


def library(spark, rows):
    return spark.createDataFrame(rows, "idx long, path string, name string, size long, mtime long, content string, selected boolean")


def test_exact_groups(spark):
    rows = [(0, "/a", "a", 0, 1, "", True), (1, "/b", "b", 0, 1, "", False), (2, "/c", "c", 2, 1, "xy", False), (3, "/d", "d", 2, 1, "yx", False), (4, "/e", "e", 5, 1, None, False), (5, "/f", "f", 5, 1, None, False)]
    files = library(spark, rows).withColumn("digest", F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("error"))).drop("content")
    digested = group.with_digests(files)
    again = group.with_digests(files, F.concat(F.lit("of "), "path"))
    assert {r["idx"]: r["md5"] for r in again.collect()} == {i: f"of {p}" for i, p, *_ in rows}
    assert {r["idx"]: r["md5"] for r in digested.collect()}[4] == "error"
    members = group.numbered(group.md5_members(digested))
    assert sorted((r["group_id"], r["idx"], r["pos"]) for r in members.collect()) == [(0, 0, 0), (0, 1, 1)]
    assert group.numbered(group.md5_members(digested, True)).select("group_id").distinct().count() == 5
    empty = group.numbered(group.md5_members(group.with_digests(files.limit(0))))
    assert empty.count() == 0


def test_keepers_break_ties_by_path(spark):
    rows = [(0, "/B", "x", 1, 5, "", True), (1, "/a", "x", 1, 5, "", False), (2, "/c", "yy", 1, 9, "", False), (3, None, "z", 1, 99, "", True)]
    files = library(spark, rows)
    members = spark.createDataFrame([(0, 0, i, i) for i in range(4)], "group_id long, leader_idx long, idx long, pos int")
    kept = {rule: keep.keepers(members, files, rule).first()["idx"] for rule in keep.RULES}
    assert kept == {"newest": 2, "oldest": 1, "filename_first": 1, "filename_last": 2, "shortest_name": 1, "longest_name": 2}
    assert keep.deletion_plan(members, files, "newest").count() == 2
    assert keep.move_to_trash(keep.deletion_plan(members, files, "newest"), "/nowhere").select("status").distinct().first()[0] == "planned"
    everyone = keep.select_group(files, members, 0)
    assert everyone.where("selected").count() == 4


def test_cache_versions(spark, tmp_path):
    store = cache.SnapshotCache(spark, str(tmp_path / "cache"))
    assert store.load().count() == 0
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("", 1, 1, "z")], "rel_path string, mtime long, size long, md5 string")
    store.upsert(rows)
    store.upsert(spark.createDataFrame([("a", 2, 1, "new")], "rel_path string, mtime long, size long, md5 string"))
    assert {r["rel_path"]: r["md5"] for r in store.load().collect()} == {"a": "new", "b": "y"}
    found = cache.lookup(rows.select("rel_path", "mtime", "size"), store.load())
    assert {r["rel_path"]: r["hit"] for r in found.collect()} == {"a": False, "b": True, "": False}
    store.delete(spark.createDataFrame([("b",)], "rel_path string"))
    assert store.version() == 3 and store.load().count() == 1


def test_numbers_follow_the_order(spark):
    rows = spark.range(150_000).select((F.col("id") * 7919 % 75_000).alias("v"), F.col("id").alias("extra"), F.concat(F.lit("name "), "id").alias("name")).repartition(7)
    out = indexed(rows, "n", F.col("v"), F.col("extra"))
    assert out.columns == ["v", "extra", "name", "n"]
    # whatever columns are read, the numbers are the same, without gaps, and in order
    for columns in (["v", "n"], ["extra", "name", "v", "n"]):
        found = sorted(out.select(*columns).collect(), key=lambda r: r["n"])
        assert [r["n"] for r in found] == list(range(150_000)) and all(a["v"] <= b["v"] for a, b in zip(found, found[1:]))
    assert out.join(out.select("extra", F.col("n").alias("m")), "extra").where("n <> m").count() == 0


def test_scan_of_a_folder(spark, tmp_path):
    for name in ("a.PNG", "b", "c.tar.gz", ".twinsift_cache.x.png", "_x.jpg", "v.mkv"):
        (tmp_path / name).write_bytes(b"data")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.jpg").write_bytes(b"data")
    flat = {r["name"]: (r["suffix"], r["category"]) for r in scans.scan(spark, str(tmp_path), "md5", videos=True, others=True).collect()}
    assert flat == {"a.PNG": ("png", "image"), "b": ("", "other"), "c.tar.gz": ("gz", "other"), "_x.jpg": ("jpg", "image"), "v.mkv": ("mkv", "video")}
    deep = scans.scan(spark, str(tmp_path), recursive=True)
    assert {r["name"] for r in deep.collect()} == {"a.PNG", "_x.jpg", "d.jpg"}
    digests = deep.select(scans.file_md5("path").alias("m")).distinct().collect()
    assert len(digests) == 1
    assert scans.with_rasters(deep).where("gray is null").count() == 3


def test_stream_of_digests(spark, tmp_path):
    from twinsift.streaming.checkpoint import digest_stream, latest

    rows = spark.range(10).selectExpr("concat('f', id) as rel_path", "id as mtime", "4L as size", "cast(id as string) as content").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    query = digest_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "state"), 1)
    query.awaitTermination()
    done = latest(spark.read.parquet(str(tmp_path / "out")))
    assert done.count() == 10 and done.select("md5").distinct().count() == 10


def test_failures_shown(spark):
    rows = spark.createDataFrame([(f"/{i:02}", "failed") for i in range(15)] + [("/x", "deleted")], "path string, status string")
    assert [(r["path"], r["more"]) for r in view.failures(rows).collect()][0] == ("/00", 3)
