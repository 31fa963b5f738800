"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kdtree, langid, lattice, lines, materialise, mixing, packing, recompression, simhash, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", kdtree.quantised("embedding").alias("vector"))
    return kdtree.top_k(vectors, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(_table(spark, sf_dir, "documents")).drop("file")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.quality_domains(_table(spark, sf_dir, "labels"))
    mixed, learned = mixing.mixture(_table(spark, sf_dir, "documents"), labelled)
    posteriors = [(F.col("posterior")[learned.index(d)] if d in learned else F.lit(None).cast("double")).alias(f"p_{d}") for d in mixing.TARGETS]
    return mixed.select("doc_id", "tokens", *posteriors, "rate", "copies")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.drop_repeated_windows(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.where(~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures, entries = (spark.sql(text.replace("FROM pages", "FROM {pages}"), pages=pages) for text in (urls.CAPTURE_SQL, urls.LIST_SQL))
    found = urls.filter_captures(captures, entries)
    return found.select(F.col("capture_id").alias("page_id"), "key", "action", "blocked")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_training_order": op3_training_order,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_mixing_to_targets": op5_mixing_to_targets,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_url_filters": op10_url_filters,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": """
        WITH sound AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op4_embedding_near_dedup": """
        WITH RECURSIVE units AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        ), links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
        ), reach(id, other) AS (SELECT vec_id, vec_id FROM units UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM units LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id
        JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) ON id = vec_id""",
    "op7_line_dedup": lines.ORACLE_SQL,
    "op10_url_filters": urls.ORACLE_SQL,
}
