"""The engine's queries by name, over the library that the documents table makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.hashes import bits_text, hasher, words
from ..operators import cache, group, keep, match, view
from ..operators.stage import materialised
from ..schema import ALGORITHM_TABLE, ALGORITHMS, DISPLAY_ORDER, HEIF_SUFFIXES, IMAGE_SUFFIXES, JPEG2000_SUFFIXES, RASTER_SUFFIXES, RAW_SUFFIXES, VIDEO_SUFFIXES
from ..sources.tables import files_from_documents, library, rasters_from_documents, rasters_from_embeddings
from . import oracle as sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(text: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name or query.__name__] = query
        if text:
            ORACLE_SQL[name or query.__name__] = text
        return query

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str, digests: bool = True) -> DataFrame:
    return library(_table(spark, sf_dir, "documents"), digests)


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files where their order does not matter."""
    return files_from_documents(_table(spark, sf_dir, "documents"))


def _members(files: DataFrame, singles: bool = False) -> DataFrame:
    return group.numbered(group.md5_members(group.with_digests(files), singles))


def _stats(files: DataFrame) -> DataFrame:
    return group.group_stats(_members(files), files)


# --- scan


@_query(f"WITH {sql.FILES} SELECT path, name, suffix, category, size, mtime FROM files")
def scan_classify(spark, sf_dir):
    return _listing(spark, sf_dir).select("path", "name", "suffix", "category", "size", "mtime")


@_query(f"WITH {sql.FILES} SELECT idx, path FROM files")
def scan_order(spark, sf_dir):
    return _files(spark, sf_dir, False).select("idx", "path")


@_query(f"WITH {sql.FILES} SELECT category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY category")
def category_counts(spark, sf_dir):
    return _listing(spark, sf_dir).groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@_query(f"WITH {sql.FILES} SELECT path FROM (SELECT path, CASE WHEN doc_id % 50 = 0 THEN '.TwinSift_cache.' || name ELSE name END AS shown FROM files) WHERE NOT starts_with(lower(shown), '.twinsift_cache.')")
def exclude_cache_files(spark, sf_dir):
    from ..sources.files import classified

    files = _files(spark, sf_dir).select(F.col("path").alias("at"), F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("x/.TwinSift_cache."), "name")).otherwise(F.concat(F.lit("x/"), "name")).alias("path"))
    return classified(files, True, True, True).select(F.col("at").alias("path"))


@_query(f"WITH {sql.FILES} SELECT path FROM files WHERE category = 'image'")
def perceptual_scope(spark, sf_dir):
    return _listing(spark, sf_dir).where("category = 'image'").select("path")


_WIDTH, _HEIGHT = "CAST(doc_id % 97 * 90 + 1 AS INT) AS width", "CAST(doc_id % 89 * 80 + 1 AS INT) AS height"
_DIMS = f"{_WIDTH}, {_HEIGHT}"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir).selectExpr("*", _WIDTH, _HEIGHT)


@_query(f"""WITH {sql.FILES}, sized AS (SELECT *, {_DIMS} FROM files)
  SELECT path, CASE WHEN suffix IN ('j2c', 'j2k', 'jp2', 'jpc', 'jpf', 'jpx') THEN 'jpeg2000' WHEN suffix IN ('png', 'apng') AND CAST(width AS BIGINT) * height * 4 > 134217728 THEN 'large_png'
  WHEN suffix IN ('dng', 'cr2', 'nef', 'arw') THEN 'raw' ELSE 'free' END AS slot FROM sized""")
def large_raster_flag(spark, sf_dir):
    return _sized(spark, sf_dir).select("path", scalars.decode_slot().alias("slot"))


@_query(f"""WITH {sql.FILES}, sized AS (SELECT *, {_DIMS} FROM files)
  SELECT path, CASE WHEN width * 64 > height * 64 THEN 64 ELSE CAST(greatest(1, round(width * 64.0 / height)) AS INT) END AS w,
  CASE WHEN width * 64 > height * 64 THEN CAST(greatest(1, round(height * 64.0 / width)) AS INT) ELSE 64 END AS h, CAST(greatest(1, round(width * 48.0 / height)) AS INT) AS w_of_48 FROM sized""")
def requested_size(spark, sf_dir):
    sized = _sized(spark, sf_dir)
    w, h = scalars.requested_size("width", "height", 64, 64)
    return sized.select("path", w.alias("w"), h.alias("h"), scalars.requested_size("width", "height", 0, 48)[0].alias("w_of_48"))


@_query(f"WITH {sql.FILES}, sized AS (SELECT *, {_DIMS} FROM files) SELECT path, CASE WHEN width > 1 AND height > 1 THEN width || 'x' || height ELSE '-' END AS resolution FROM sized")
def resolution_text(spark, sf_dir):
    known = _sized(spark, sf_dir).withColumns({c: F.when(F.col(c) > 1, F.col(c)) for c in ("width", "height")})
    return known.select("path", F.coalesce(scalars.resolution_text(), F.lit("-")).alias("resolution"))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{c}')" for c, names in (("image", IMAGE_SUFFIXES), ("video", VIDEO_SUFFIXES)) for s in sorted(set(names))) + ") t(suffix, category)")
def supported_suffixes(spark, sf_dir):
    families = [(RASTER_SUFFIXES, "image"), (HEIF_SUFFIXES, "image"), (JPEG2000_SUFFIXES, "image"), (RAW_SUFFIXES, "image"), (VIDEO_SUFFIXES, "video")]
    listed = spark.createDataFrame([(s,) for names, _ in families for s in names], "suffix string")
    return listed.distinct().select("suffix", scalars.category().alias("category"))


# --- exact groups


@_query(f"WITH {sql.FILES} SELECT idx, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)")
def size_collisions(spark, sf_dir):
    return group.shared_sizes(_files(spark, sf_dir, False)).select("idx", "size")


@_query(f"WITH {sql.MD5} SELECT idx, md5 FROM digested")
def md5_digest(spark, sf_dir):
    return group.with_digests(_files(spark, sf_dir)).select("idx", "md5")


@_query(f"WITH {sql.MD5} SELECT * FROM members")
def md5_groups(spark, sf_dir):
    return _members(_files(spark, sf_dir))


@_query(f"""WITH {sql.MD5}, led AS (SELECT d.idx, coalesce(g.leader_idx, d.idx) AS leader_idx FROM digested d LEFT JOIN md5_groups g USING (md5)),
  ids AS (SELECT leader_idx, row_number() OVER (ORDER BY leader_idx) - 1 AS group_id FROM led GROUP BY leader_idx)
  SELECT group_id, leader_idx, idx, row_number() OVER (PARTITION BY leader_idx ORDER BY idx) - 1 AS pos FROM led JOIN ids USING (leader_idx)""")
def md5_groups_singles(spark, sf_dir):
    return _members(_files(spark, sf_dir), True)


@_query("WITH d AS (SELECT md5(html) AS md5 FROM pages GROUP BY html HAVING count(*) > 1) SELECT count(*) AS groups FROM d")
def md5_groups_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.octet_length("html").alias("size"), F.md5(F.col("html").cast("binary")).alias("digest"))
    return group.md5_members(group.with_digests(pages)).agg(F.count_distinct("leader_idx").alias("groups"))


# --- perceptual hashes


def _hashes(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    return rasters_from_documents(_table(spark, sf_dir, "documents")).select("idx", hasher(algorithm)("gray").alias("hash"))


for _algorithm in sql.HASHES:

    @_query(f"WITH {sql.hashed(_algorithm)} SELECT idx, bits FROM hashed", _algorithm)
    def _hash_query(spark, sf_dir, algorithm=_algorithm):
        return _hashes(spark, sf_dir, algorithm).select("idx", bits_text("hash").alias("bits"))


@_query(f"WITH {sql.hashed('bhash', sql.EMBEDDED)} SELECT idx, bits FROM hashed")
def bhash_embeddings(spark, sf_dir):
    return rasters_from_embeddings(_table(spark, sf_dir, "embeddings")).select("idx", bits_text(hasher("bhash")("gray")).alias("bits"))


@_query("SELECT doc_id AS idx, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 16 ELSE 0 END AS mask FROM documents")
def hash_mask(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    some = {"dhash": 2, "ahash": 3, "bhash": 5}
    held = {n: F.when(F.col("doc_id") % some[n] == 0, F.unhex(F.lit("00" * 32))) if n in some else F.lit(None).cast("binary") for n in ALGORITHMS[:5]}
    return docs.select("doc_id", *(c.alias(n) for n, c in held.items())).select(F.col("doc_id").alias("idx"), scalars.hash_mask().alias("mask"))


@_query(f"""WITH {sql.hashed('dhash')} SELECT idx, array_to_string(list_transform(range(32), lambda i: printf('%02x', CAST(list_sum(list_transform(range(8), lambda j: CASE WHEN bits[i * 8 + j + 1] = '1' THEN 1 << j ELSE 0 END)) AS INT))), '') AS bytes FROM hashed""")
def hash_bytes(spark, sf_dir):
    return _hashes(spark, sf_dir, "dhash").select("idx", F.lower(F.hex("hash")).alias("bytes"))


@_query(f"WITH {sql.hashed('dhash')} SELECT min(idx) AS rep, count(*) AS copies FROM hashed GROUP BY bits")
def hash_collapse(spark, sf_dir):
    return match.collapsed(_hashes(spark, sf_dir, "dhash")).select("rep", "copies")


@_query(f"WITH {sql.hashed('dhash')} SELECT idx, min(idx) OVER (PARTITION BY bits) AS rep FROM hashed")
def hash_members(spark, sf_dir):
    return match.representatives(_hashes(spark, sf_dir, "dhash"))


_NODES = "n AS (SELECT min(idx) AS rep, count(*) AS copies, bits FROM hashed GROUP BY bits)"
_PAIRS = "SELECT a.rep AS lo, b.rep AS hi, CAST(hamming(a.bits, b.bits) AS INT) AS dist FROM n a JOIN n b ON a.rep < b.rep AND hamming(a.bits, b.bits) <= {}"
for _most in (4, 16):

    @_query(f"WITH {sql.hashed('dhash')}, {_NODES} {_PAIRS.format(_most)}", f"hamming_pairs_t{_most}")
    def _pairs_query(spark, sf_dir, most=_most):
        return match.hash_pairs(materialised(match.collapsed(_hashes(spark, sf_dir, "dhash"))), most)


for _name, _most, _radius in (("hamming_pairs_banded", 8, 0), ("hamming_pairs_radius", 16, 1)):

    @_query(f"WITH {sql.hashed('dhash')}, {_NODES} {_PAIRS.format(_most)}", _name)
    def _banded_query(spark, sf_dir, most=_most, radius=_radius):
        return match.banded_pairs(materialised(match.collapsed(_hashes(spark, sf_dir, "dhash"))), most, radius)


for _name, _algorithm, _most, _least in (("rep_groups_dhash_t4", "dhash", 4, 2), ("rep_groups_ahash_t4", "ahash", 4, 2), ("rep_groups_bhash_t4", "bhash", 4, 2), ("rep_groups_dhash_t16", "dhash", 16, 2), ("rep_groups_singles", "dhash", 4, 1)):

    @_query(f"WITH RECURSIVE {sql.representative(_algorithm, _most, _least)} SELECT * FROM members", _name)
    def _groups_query(spark, sf_dir, algorithm=_algorithm, most=_most, singles=_least == 1):
        return group.numbered(group.representative_members(_hashes(spark, sf_dir, algorithm), most, singles))


@_query(f"""WITH RECURSIVE {sql.representative('dhash', 16)} SELECT m.idx, CAST(CASE WHEN m.pos = 0 THEN 100 ELSE 100 - hamming(a.bits, b.bits) * 100 // 256 END AS BIGINT) AS similarity
  FROM members m JOIN hashed a ON a.idx = m.leader_idx JOIN hashed b ON b.idx = m.idx""")
def similarity_pct(spark, sf_dir):
    hashes = materialised(_hashes(spark, sf_dir, "dhash"))
    members = group.representative_members(hashes, 16)
    of = hashes.select("idx", *words("hash"))
    both = members.join(of.alias("m"), "idx").join(of.withColumnRenamed("idx", "leader_idx").alias("l"), "leader_idx")
    measured = both.select("idx", "pos", scalars.hamming("m.", "l.").alias("dist"))
    return measured.select("idx", F.when(F.col("pos") == 0, 100).otherwise(scalars.similarity("dist")).cast("long").alias("similarity"))


@_query("SELECT CAST(v AS INT) AS threshold, CAST(100 - round(v * 100.0 / 256) AS INT) AS label FROM range(65) t(v)")
def min_similarity_label(spark, sf_dir):
    return spark.range(65).select(F.col("id").cast("int").alias("threshold"), scalars.threshold_label("id").alias("label"))


_SHOWN = [(*row, DISPLAY_ORDER.index(ALGORITHMS[row[0]])) for row in ALGORITHM_TABLE]


@_query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in _SHOWN) + ") t(code, name, short_name, speed, description, place)")
def algorithm_table(spark, sf_dir):
    return spark.createDataFrame(_SHOWN, "code int, name string, short_name string, speed string, description string, place int")


# --- groups shown


@_query(f"WITH {sql.MD5} SELECT * FROM stats")
def group_stats(spark, sf_dir):
    return _stats(_files(spark, sf_dir))


@_query(f"WITH {sql.MD5} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT group_id) FROM members) AS groups")
def library_stats(spark, sf_dir):
    files = _files(spark, sf_dir)
    return group.library_stats(_members(files), files)


_TERM = "AND (SELECT bool_or(contains(lower(name), '{0}')) FROM members m JOIN files USING (idx) WHERE m.group_id = stats.group_id)"
for _name, _text, _where in (
    ("filter_min_files", "min:3", "files >= 3"),
    ("filter_min_mb", "size>=0.005", "mb >= 0.005"),
    ("filter_terms", ".jpg .PNG", _TERM.format(".jpg")[4:] + _TERM.format(".png")),
    ("filter_combined", "min:2 min:3 0.001mb combmb size>=50mb doc_", "files >= 3 AND mb >= 0.001 " + _TERM.format("doc_")),
):

    @_query(f"WITH {sql.MD5} SELECT group_id, files FROM stats WHERE {_where}", _name)
    def _filter_query(spark, sf_dir, text=_text):
        files = _files(spark, sf_dir)
        members = _members(files)
        return view.filter_groups(group.group_stats(members, files), members, files, text).select("group_id", "files")


@_query(f"WITH {sql.MD5} SELECT group_id, idx, name FROM members JOIN files USING (idx) WHERE contains(lower(name), '.jp')")
def file_search(spark, sf_dir):
    files = _files(spark, sf_dir)
    return view.search_files(_members(files), files, " .JP ").select("group_id", "idx", "name")


for _by, _keys in (("number", "group_id"), ("files", "files DESC, group_id"), ("bytes", "bytes DESC, group_id")):
    _name = {"number": "sort_by_number", "files": "sort_by_count", "bytes": "sort_by_bytes"}[_by]

    @_query(f"WITH {sql.MD5} SELECT group_id, files, bytes FROM stats ORDER BY {_keys}", _name)
    def _sort_query(spark, sf_dir, by=_by):
        return view.sort_groups(_stats(_files(spark, sf_dir)), by).select("group_id", "files", "bytes")


@_query(f"WITH {sql.MD5} SELECT group_id, printf('Group %d • %d files • %.2f MB', group_id + 1, files, mb) AS label FROM stats")
def group_label(spark, sf_dir):
    return _stats(_files(spark, sf_dir)).select("group_id", view.group_label().alias("label"))


@_query(f"WITH {sql.FILES} SELECT idx, printf('%.2f MB', size / 1048576.0) AS size_text FROM files")
def size_text(spark, sf_dir):
    return _files(spark, sf_dir, False).select("idx", scalars.size_text().alias("size_text"))


@_query(f"WITH {sql.MD5} SELECT group_id, idx, CAST(pos // 12 AS INT) AS page FROM members")
def page_members(spark, sf_dir):
    return view.pages(_members(_files(spark, sf_dir))).select("group_id", "idx", "page")


@_query(f"WITH {sql.FILES}, failed AS (SELECT path FROM files WHERE doc_id % 7 = 0) SELECT path, (SELECT greatest(count(*) - 12, 0) FROM failed) AS more FROM failed ORDER BY path LIMIT 12")
def failure_list(spark, sf_dir):
    files = _listing(spark, sf_dir)
    results = files.select("path", F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("deleted").alias("status"))
    return view.failures(results)


# --- selection, keepers, deletion


@_query(f"WITH {sql.MD5} SELECT group_id, count(*) FILTER (WHERE selected) AS selected FROM members JOIN files USING (idx) GROUP BY group_id")
def selection_summary(spark, sf_dir):
    files = _files(spark, sf_dir)
    return group.selection_summary(_members(files), files)


@_query(f"WITH {sql.MD5} SELECT files.idx, selected OR group_id IS NOT NULL AS selected FROM files LEFT JOIN (SELECT idx, group_id FROM members WHERE group_id = 1) m ON m.idx = files.idx")
def select_all_in_group(spark, sf_dir):
    files = _files(spark, sf_dir)
    return keep.select_group(files, _members(files), 1).select("idx", "selected")


@_query(f"WITH {sql.MD5} SELECT group_id, path, 'selected' AS reason FROM members JOIN files USING (idx) WHERE selected AND group_id = 0")
def delete_selected_group(spark, sf_dir):
    files = _files(spark, sf_dir)
    return keep.selected_in_group(_members(files), files, 0)


@_query(f"WITH {sql.MD5} SELECT group_id, path, 'selected' AS reason FROM members JOIN files USING (idx) WHERE selected")
def delete_selected_all(spark, sf_dir):
    files = _files(spark, sf_dir)
    return keep.selected_in_all(_members(files), files)


@_query(f"""WITH {sql.MD5}, g AS (SELECT group_id, count(*) FILTER (WHERE selected) AS s, count(*) AS n FROM members JOIN files USING (idx) GROUP BY group_id)
  SELECT CAST(sum(s) AS BIGINT) AS selected_files, count(*) FILTER (WHERE s > 0) AS affected_groups, count(*) FILTER (WHERE s > 0 AND s = n) AS emptied_groups FROM g""")
def delete_preview_all(spark, sf_dir):
    files = _files(spark, sf_dir)
    return keep.deletion_preview(_members(files), files)


@_query(f"WITH {sql.MD5} SELECT count(*) AS eligible_groups, CAST(sum(files - 1) AS BIGINT) AS delete_count FROM stats WHERE files > 1")
def md5_delete_eligible(spark, sf_dir):
    files = _files(spark, sf_dir)
    return keep.eligible(_members(files), files)


_ORDERS = {
    "newest": "mtime DESC",
    "oldest": "mtime",
    "filename_first": "lower(name)",
    "filename_last": "lower(name) DESC",
    "shortest_name": "length(name), lower(name)",
    "longest_name": "length(name) DESC, lower(name)",
}
_RANKED = "SELECT group_id, idx, path, row_number() OVER (PARTITION BY group_id ORDER BY {}, lower(path), idx) AS place FROM members JOIN files USING (idx)"
for _rule, _order in _ORDERS.items():

    @_query(f"WITH {sql.MD5} SELECT group_id, idx, path FROM ({_RANKED.format(_order)}) WHERE place = 1", f"keep_{_rule}")
    def _keep_query(spark, sf_dir, rule=_rule):
        files = _files(spark, sf_dir)
        return keep.keepers(_members(files), files, rule)


@_query(f"WITH {sql.MD5} SELECT group_id, path, 'newest' AS reason FROM ({_RANKED.format(_ORDERS['newest'])}) WHERE place > 1")
def deletion_plan(spark, sf_dir):
    files = _files(spark, sf_dir)
    return keep.deletion_plan(_members(files), files, "newest")


@_query(f"WITH {sql.MD5}, gone AS (SELECT path FROM ({_RANKED.format(_ORDERS['oldest'])}) WHERE place > 1) SELECT path FROM files WHERE path NOT IN (SELECT path FROM gone)")
def forget_deleted(spark, sf_dir):
    files = _files(spark, sf_dir)
    plan = keep.deletion_plan(_members(files), files, "oldest")
    return keep.forget(files, plan.select("path", F.lit("deleted").alias("status"))).select("path")


# --- cache

_CACHE = "cached AS (SELECT path AS rel_path, mtime + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime, size, 'old' || doc_id AS md5 FROM files WHERE doc_id % 5 <> 0)"


def _cached(files: DataFrame) -> DataFrame:
    stale = F.col("mtime") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return files.where("doc_id % 5 <> 0").select(F.col("path").alias("rel_path"), stale.alias("mtime"), "size", F.concat(F.lit("old"), "doc_id").alias("md5"))


@_query(f"WITH {sql.FILES}, {_CACHE} SELECT path AS rel_path, c.md5, c.rel_path IS NOT NULL AS hit FROM files f LEFT JOIN cached c ON c.rel_path = f.path AND c.mtime = f.mtime AND c.size = f.size")
def cache_lookup(spark, sf_dir):
    files = _listing(spark, sf_dir)
    return cache.lookup(files.select(F.col("path").alias("rel_path"), "mtime", "size"), _cached(files)).select("rel_path", "md5", "hit")


@_query(f"WITH {sql.FILES}, {_CACHE}, new AS (SELECT path AS rel_path, mtime, size, md5(content) AS md5 FROM files WHERE doc_id % 4 = 0) SELECT * FROM new UNION ALL SELECT * FROM cached WHERE rel_path NOT IN (SELECT rel_path FROM new)")
def cache_upsert(spark, sf_dir):
    files = _listing(spark, sf_dir)
    new = files.where("doc_id % 4 = 0").select(F.col("path").alias("rel_path"), "mtime", "size", F.md5(F.col("content").cast("binary")).alias("md5"))
    return cache.upsert(_cached(files), new)


@_query(f"WITH {sql.FILES}, {_CACHE} SELECT rel_path FROM cached JOIN files ON path = rel_path WHERE category <> 'image' AND doc_id % 3 = 0")
def cache_purge(spark, sf_dir):
    files = _listing(spark, sf_dir)
    scan = files.where("category = 'image'").select(F.col("path").alias("rel_path"))
    return cache.missing(_cached(files), scan, files.where("doc_id % 3 <> 0").select(F.col("path").alias("rel_path")))
