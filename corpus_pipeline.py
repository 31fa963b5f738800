"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import langid, lines, mixing, packing, simhash
from twinsift.llm.common import written


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or with no clear language go."""
    return langid.keep_identified(docs, docs.where(~langid.held_out()))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length of templates that recur across documents go, but for their first; n_chars follows the text."""
    cleaned = lines.drop_recurring_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays."""
    return simhash.keep_one(docs)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say; labels come from the labels table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs, mixing.quality_domains(labels))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", known_languages),
    ("line dedup", without_recurring_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing to target weights", mixed_to_targets),
    ("best-fit packing", packed),
]

#: SQL has no sum over all segmentations of a word; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
