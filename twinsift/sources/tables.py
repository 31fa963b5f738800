"""Files and rasters out of tables, for libraries that live in tables rather than folders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashes import SIDE
from ..functions.scalars import category, suffix
from ..operators.order import indexed
from ..schema import ERROR_DIGEST

SUFFIXES = ("jpg", "PNG", "gif", "heic", "mp4", "mkv", "txt", "")
PIXELS = SIDE * SIDE


def files_from_documents(documents: DataFrame) -> DataFrame:
    """A library of files: one for each document, its text the content.

    doc_id, path, name, suffix, category, size, mtime, content, selected.
    """
    suffix_of = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    name = F.concat(F.lit("Doc_"), F.col("doc_id"), F.when(suffix_of == "", "").otherwise(F.concat(F.lit("."), suffix_of)))
    files = documents.select(
        "doc_id",
        F.concat(F.lit("/lib/"), "source", F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(1704067200000) + F.col("doc_id") * 31 % 11 * 86400000).alias("mtime"),
        F.col("text").alias("content"),
        (F.col("doc_id") % 3 == 0).alias("selected"),
    )
    return files.withColumn("suffix", suffix()).withColumn("category", category())


def library(documents: DataFrame, digests: bool = False) -> DataFrame:
    """The files in canonical order, with idx and without their content.

    With ``digests`` each file has the md5 of its content as digest ('error' where there is
    none), taken where the content is read: only rows of fixed size are dealt anew.
    """
    files = files_from_documents(documents)
    if digests:
        files = files.withColumn("digest", F.coalesce(F.md5(F.col("content").cast("binary")), F.lit(ERROR_DIGEST)))
    return indexed(files.drop("content"), "idx", F.lower("path"), F.col("path"))


def text_raster(text: str | None) -> bytes:
    """A raster of a whole text. Brightness is a character's code point, at most 255.

    Up to 4096 characters each is a pixel, and 0 follows their end; in a longer text pixel k is
    the whole part of the mean over the k-th of 4096 even shares.
    """
    codes = np.minimum(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32), 255)
    if len(codes) > PIXELS:
        cuts = np.arange(PIXELS + 1) * len(codes) // PIXELS
        sums = np.concatenate(([0], np.cumsum(codes, dtype=np.int64)))[cuts]
        codes = np.diff(sums) // np.diff(cuts)
    return codes.astype(np.uint8).tobytes().ljust(PIXELS, b"\0")


def vector_raster(vector: np.ndarray | None) -> bytes | None:
    """Pixel (y, x) shows component (x + y div 4) mod its length around a middle gray."""
    if vector is None or not len(vector):
        return None
    x, y = np.arange(SIDE)[None, :], np.arange(SIDE)[:, None]
    shades = np.clip(np.floor(128 + 255 * np.asarray(vector, np.float64)), 0, 255).astype(np.uint8)
    return shades[(x + y // 4) % len(shades)].tobytes()


@F.pandas_udf(T.BinaryType())
def _text_rasters(texts: pd.Series) -> pd.Series:
    return texts.map(text_raster, na_action=None)


@F.pandas_udf(T.BinaryType())
def _vector_rasters(vectors: pd.Series) -> pd.Series:
    return vectors.map(vector_raster, na_action=None)


def rasters_from_documents(documents: DataFrame) -> DataFrame:
    """idx (doc_id) and gray, the raster of the whole text; a null text is an empty one."""
    return documents.select(F.col("doc_id").alias("idx"), _text_rasters("text").alias("gray"))


def rasters_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """idx (vec_id) and gray; null for a null or empty vector."""
    return embeddings.select(F.col("vec_id").alias("idx"), _vector_rasters("embedding").alias("gray"))
