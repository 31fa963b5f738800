"""SQL that DuckDB runs on the same tables, built from shared parts."""

from __future__ import annotations

from ..functions.hashes import dct_basis
from ..schema import IMAGE_SUFFIXES, VIDEO_SUFFIXES
from ..sources.tables import SUFFIXES


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


FILES = f"""
raw_files AS (
  SELECT doc_id, [{_listed(SUFFIXES)}][doc_id % {len(SUFFIXES)} + 1] AS ext, * EXCLUDE (doc_id) FROM documents
), unordered AS (
  SELECT doc_id, '/lib/' || source || '/Doc_' || doc_id || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS path,
    'Doc_' || doc_id || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS name, lower(ext) AS suffix,
    CASE WHEN lower(ext) IN ({_listed(IMAGE_SUFFIXES)}) THEN 'image' WHEN lower(ext) IN ({_listed(VIDEO_SUFFIXES)}) THEN 'video' ELSE 'other' END AS category,
    CAST(strlen(text) AS BIGINT) AS size, 1704067200000 + (doc_id * 31 % 11) * 86400000 AS mtime, text AS content, doc_id % 3 = 0 AS selected
  FROM raw_files
), files AS (SELECT row_number() OVER (ORDER BY lower(path), path) - 1 AS idx, * FROM unordered)"""

MD5 = f"""{FILES},
digested AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY size) > 1 THEN md5(content) END AS md5 FROM files),
md5_groups AS (SELECT md5, min(idx) AS leader_idx FROM digested WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1),
md5_numbered AS (SELECT *, row_number() OVER (ORDER BY leader_idx) - 1 AS group_id FROM md5_groups),
members AS (
  SELECT g.group_id, g.leader_idx, d.idx, row_number() OVER (PARTITION BY g.group_id ORDER BY d.idx) - 1 AS pos FROM digested d JOIN md5_numbered g USING (md5)
),
stats AS (SELECT group_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, sum(size) / 1048576.0 AS mb FROM members JOIN files USING (idx) GROUP BY group_id)"""

RASTER = """
chars AS (SELECT doc_id AS idx, string_split(coalesce(text, ''), '') AS c, length(coalesce(text, '')) AS n FROM documents),
codes AS (SELECT idx, n, least(unicode(ch), 255) AS code, i FROM (SELECT idx, n, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS i FROM chars WHERE n > 0)),
pixels AS (SELECT idx, k, CAST(sum(code) AS BIGINT) // count(*) AS v FROM (SELECT idx, code, CASE WHEN n <= 4096 THEN i ELSE ((i + 1) * 4096 - 1) // n END AS k FROM codes) GROUP BY idx, k),
rasters AS (SELECT idx, list_resize(coalesce(p, []), 4096, 0) AS p FROM chars LEFT JOIN (SELECT idx, list(v ORDER BY k) AS p FROM pixels GROUP BY idx) USING (idx))"""

EMBEDDED = """
rasters AS (
  SELECT vec_id AS idx, list_transform(range(4096), lambda k: CAST(greatest(0, least(255, floor(128 + 255 * CAST(embedding[(k % 64 + k // 64 // 4) % 64 + 1] AS DOUBLE)))) AS BIGINT)) AS p FROM embeddings
)"""

_BITS = "array_to_string(list_transform({values}, lambda v: CASE WHEN {test} THEN '1' ELSE '0' END), '')"

_C = "(1.0::DOUBLE / sqrt(2.0::DOUBLE))"


def _basis() -> str:
    return "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::FLOAT" for v in row) + "]" for row in dct_basis()) + "]"


#: Per algorithm: further tables, and the table with idx and bits.
HASHES = {
    "ahash": f""", a AS (SELECT idx, list_transform(range(256), lambda i: p[(i // 16 * 4 + 2) * 64 + i % 16 * 4 + 3]) AS v FROM rasters),
      hashed AS (SELECT idx, {_BITS.format(values="v", test="256 * v > s")} AS bits FROM (SELECT idx, v, list_sum(v) AS s FROM a))""",
    "dhash": f""", a AS (SELECT idx, list_transform(range(256), lambda i: p[(i // 16 * 4 + 2) * 64 + (2 * (i % 16) + 1) * 64 // 34 + 1] - p[(i // 16 * 4 + 2) * 64 + (2 * (i % 16) + 3) * 64 // 34 + 1]) AS v FROM rasters),
      hashed AS (SELECT idx, {_BITS.format(values="v", test="v > 0")} AS bits FROM a)""",
    "bhash": f""", a AS (SELECT idx, list_transform(range(256), lambda i: list_sum(list_transform(range(16), lambda j: p[(i // 16 * 4 + j // 4) * 64 + i % 16 * 4 + j % 4 + 1]))) AS v FROM rasters),
      hashed AS (SELECT idx, {_BITS.format(values="v", test="2 * v > m")} AS bits FROM (SELECT idx, v, list_sort(v)[128] + list_sort(v)[129] AS m FROM a))""",
    "whash": f""", h AS (SELECT idx, list_transform(range(1024), lambda k: p[(2 * (k // 32) + 1) * 64 + 2 * (k % 32) + 2]::DOUBLE) AS q FROM rasters),
      a AS (SELECT idx, list_transform(range(256), lambda i: ((q[i // 16 * 64 + i % 16 * 2 + 1] + q[i // 16 * 64 + i % 16 * 2 + 2]) * {_C} + (q[i // 16 * 64 + 32 + i % 16 * 2 + 1] + q[i // 16 * 64 + 32 + i % 16 * 2 + 2]) * {_C}) * {_C}) AS v FROM h),
      hashed AS (SELECT idx, {_BITS.format(values="v", test="v > m")} AS bits FROM (SELECT idx, v, list_reduce(v, lambda x, y: x + y) / 256 AS m FROM a))""",
    "phash": f""", basis AS (SELECT {_basis()} AS b),
      h AS (SELECT idx, list_transform(range(1024), lambda k: p[(2 * (k // 32) + 1) * 64 + 2 * (k % 32) + 2]::FLOAT) AS q FROM rasters),
      r AS (SELECT idx, list_max(q) > 0 AS lit, b, list_transform(range(512), lambda k: list_reduce(list_transform(range(32), lambda x: q[k // 16 * 32 + x + 1] * b[k % 16 + 1][x + 1]), lambda s, z: s + z, 0::FLOAT)) AS t FROM h, basis),
      a AS (SELECT idx, lit, list_transform(range(256), lambda i: list_reduce(list_transform(range(32), lambda y: t[y * 16 + i % 16 + 1] * b[i // 16 + 1][y + 1]), lambda s, z: s + z, 0::FLOAT)) AS v FROM r),
      hashed AS (SELECT idx, {_BITS.format(values="v", test="lit AND v > m")} AS bits FROM (SELECT idx, lit, v, list_reduce(v[2:], lambda s, z: s + z, 0::FLOAT) / 255::FLOAT AS m FROM a))""",
}


def hashed(algorithm: str, raster: str = RASTER) -> str:
    """WITH parts that end in hashed (idx, bits)."""
    return f"{raster}{HASHES[algorithm]}"


def representative(algorithm: str, most: int, least: int = 2) -> str:
    """WITH RECURSIVE parts that end in members (group_id, leader_idx, idx, pos)."""
    return f"""{hashed(algorithm)},
    nodes AS (SELECT bits, min(idx) AS rep FROM hashed GROUP BY bits),
    ranked AS (SELECT *, row_number() OVER (ORDER BY rep) AS i FROM nodes),
    near AS (SELECT b.i AS hi, a.i AS lo FROM ranked a JOIN ranked b ON a.i < b.i AND hamming(a.bits, b.bits) <= {most}),
    nb AS (SELECT r.i, r.rep, coalesce(list(lo) FILTER (WHERE lo IS NOT NULL), []) AS lower FROM ranked r LEFT JOIN near n ON n.hi = r.i GROUP BY r.i, r.rep),
    walk(i, heads) AS (
      SELECT 0::BIGINT, []::BIGINT[] UNION ALL
      SELECT nb.i, CASE WHEN list_has_any(walk.heads, nb.lower) THEN walk.heads ELSE list_append(walk.heads, nb.i) END FROM walk JOIN nb ON nb.i = walk.i + 1
    ),
    ended AS (SELECT heads FROM walk ORDER BY i DESC LIMIT 1),
    led AS (SELECT nb.rep, CASE WHEN list_contains(heads, nb.i) THEN nb.i ELSE list_min(list_intersect(heads, lower)) END AS head FROM nb, ended),
    placed AS (SELECT h.idx, l.rep AS leader_idx FROM hashed h JOIN nodes n USING (bits) JOIN led d ON d.rep = n.rep JOIN ranked l ON l.i = d.head),
    kept AS (SELECT leader_idx, row_number() OVER (ORDER BY leader_idx) - 1 AS group_id FROM placed GROUP BY leader_idx HAVING count(*) >= {least}),
    members AS (SELECT group_id, leader_idx, idx, row_number() OVER (PARTITION BY leader_idx ORDER BY idx) - 1 AS pos FROM placed JOIN kept USING (leader_idx))"""
