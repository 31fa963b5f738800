"""Scans of folders: listing, classifying, digests and gray rasters of real files."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Collection, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashes import hasher
from ..functions.scalars import basename, category, decode_slot, suffix
from ..operators.order import indexed
from ..schema import ALGORITHMS, CACHE_PREFIX, ERROR_DIGEST, IMAGE_SUFFIXES, VIDEO_SUFFIXES
from .decode import DECODERS, allocation_limit, decode_gray, gray_raster, jpeg_orientation, png_size, upright

_LISTED = "path string, rel_path string, size long, mtime long"


def list_folder(spark: SparkSession, folder: str, recursive: bool = False, suffixes: Collection[str] | None = None, tasks: int = 256) -> DataFrame:
    """path, rel_path, size, mtime (ms) of readable files under a folder that all executors see.

    Names that begin with a dot or underscore are listed too, which Spark's own readers skip. The
    driver opens folders until there are ``tasks`` of them, or none is left to open; each of
    these is then walked by a task. With ``suffixes`` (in lower case, without the dot) files of others
    are passed over before they are looked at.
    """
    shallow, deep = [folder], []
    if recursive:
        deep = sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
        while deep and len(deep) < tasks:
            below = [e.path for top in deep for e in os.scandir(top) if e.is_dir(follow_symlinks=False)]
            shallow, deep = shallow + deep, sorted(below)

    wanted = None if suffixes is None else frozenset(suffixes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top, whole in zip(batch["top"], batch["whole"]):
                for at, _, names in os.walk(top):
                    rows = []
                    for name in names:
                        if wanted is not None and os.path.splitext(f"x{name}")[1][1:].lower() not in wanted:
                            continue
                        path = os.path.join(at, name)
                        try:
                            stat = os.stat(path)
                        except OSError:
                            continue
                        if os.access(path, os.R_OK):
                            rows.append((path, os.path.relpath(path, folder), stat.st_size, stat.st_mtime_ns // 1_000_000))
                    yield pd.DataFrame(rows, columns=["path", "rel_path", "size", "mtime"])
                    if not whole:
                        break

    asked = spark.createDataFrame([(t, False) for t in shallow] + [(t, True) for t in deep], "top string, whole boolean")
    return asked.repartition(max(1, min(tasks, len(shallow) + len(deep)))).mapInPandas(walk, _LISTED)


def classified(listed: DataFrame, images: bool = True, videos: bool = False, others: bool = False, cache_prefix: str = CACHE_PREFIX) -> DataFrame:
    """Rows of the wanted categories, with name, suffix, category; the engine's own cache files are left out."""
    named = listed.withColumn("name", basename()).withColumn("suffix", suffix())
    named = named.withColumn("category", category()).where(~F.lower("name").startswith(cache_prefix.lower()))
    wanted = [c for c, on in (("image", images), ("video", videos), ("other", others)) if on]
    return named.where(F.col("category").isin(wanted)) if wanted else named.where("false")


def scan(spark: SparkSession, folder: str, algorithm: str = "dhash", recursive: bool = False, videos: bool = False, others: bool = False, images: bool = True) -> DataFrame:
    """The library of a folder in canonical order: perceptual hashes take images alone, md5 what is asked for."""
    exact = algorithm == "md5"
    images, videos, others = images or not exact, videos and exact, others and exact
    suffixes = None if others else [*(IMAGE_SUFFIXES if images else ()), *(VIDEO_SUFFIXES if videos else ())]
    found = classified(list_folder(spark, folder, recursive, suffixes), images, videos, others)
    return indexed(found, "idx", F.lower("path"), F.col("path"))


@F.pandas_udf(T.StringType())
def file_md5(paths: pd.Series) -> pd.Series:
    """Streamed digests of local files; 'error' for those that cannot be read."""

    def digest(path: str) -> str:
        try:
            with open(path, "rb") as file:
                return hashlib.file_digest(file, "md5").hexdigest()
        except OSError:
            return ERROR_DIGEST

    return paths.map(digest)


#: Suffixes that Spark's image reader decodes. It passes over names that begin with a dot or an underscore.
JVM_SUFFIXES = ("jpg", "jpeg", "jpe", "jif", "jfif", "gif", "tif", "tiff", "wbmp")
#: Decodes of one kind that run at once on the whole cluster: JPEG 2000 and very large PNG take much memory.
SLOTS = {"jpeg2000": 1, "large_png": 1, "raw": 2}
_RASTER = T.StructType([T.StructField("gray", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def _head(path: str, size: int) -> bytes:
    try:
        with open(path, "rb") as file:
            return file.read(size)
    except OSError:
        return b""


@F.pandas_udf(T.StructType(_RASTER.fields[1:]))
def _png_sizes(paths: pd.Series, suffixes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([png_size(_head(p, 24)) if s in ("png", "apng") else (0, 0) for p, s in zip(paths, suffixes)], columns=["width", "height"])


def _decoded(files: DataFrame, content: str | None) -> DataFrame:
    @F.pandas_udf(_RASTER)
    def decode(suffixes: pd.Series, sources: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, source in zip(suffixes, sources):
            try:
                if content:
                    data = bytes(source)
                else:
                    with open(source, "rb") as file:
                        data = file.read()
                rows.append(decode_gray(kind, data))
            except (OSError, ValueError, TypeError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["gray", "width", "height"])

    return files.withColumn("raster", decode("suffix", content or "path"))


def _jvm_rasters(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and raster of images that Spark's reader decodes (BGR rows), shown as their EXIF orientation wants."""

    @F.pandas_udf("path string, gray binary, width int, height int")
    def convert(origins: pd.Series, data: pd.Series, heights: pd.Series, widths: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = []
        for origin, d, h, w, c in zip(origins, data, heights, widths, channels):
            path = unquote(urlparse(origin).path)
            if w * h * c > allocation_limit():
                rows.append((path, None, None, None))
                continue
            pixels = np.frombuffer(bytes(d), np.uint8).reshape(h, w, c)
            pixels = upright(pixels[:, :, 2::-1] if c >= 3 else pixels, jpeg_orientation(_head(path, 1 << 17)))
            rows.append((path, gray_raster(pixels), pixels.shape[1], pixels.shape[0]))
        return pd.DataFrame(rows, columns=["path", "gray", "width", "height"])

    images = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
    found = images.select(convert("origin", "data", "height", "width", "nChannels").alias("r"))
    return found.select(F.col("r.path").alias("path"), F.struct("r.gray", "r.width", "r.height").alias("raster"))


def with_rasters(files: DataFrame, content: str | None = None) -> DataFrame:
    """``files`` (path, suffix, ...) with gray (64 x 64), width and height; null for what no decoder reads.

    ``content`` names a column of bytes; without one files are read by path on the executors, and
    families that the JVM reads are decoded there: their paths go through the driver, so ``files``
    should be a batch of bounded size. Decodes that take much memory run in few tasks.
    """
    if content:
        return _decoded(files, content).select("*", "raster.gray", "raster.width", "raster.height").drop("raster")
    spark = files.sparkSession
    here = {r["suffix"] for r in files.where(F.col("suffix").isin(*DECODERS, *JVM_SUFFIXES)).select("suffix").distinct().collect()}
    parts: list[DataFrame] = []
    if own_suffixes := sorted(here.intersection(DECODERS)):
        own = files.where(F.col("suffix").isin(own_suffixes)).withColumn("sizes", _png_sizes("path", "suffix"))
        own = own.select("*", "sizes.width", "sizes.height").withColumn("slot", decode_slot()).drop("sizes", "width", "height")
        slots = {r["slot"] for r in own.select("slot").distinct().collect()}
        for slot in sorted(slots):
            rows = own.where(F.col("slot") == slot).drop("slot")
            parts.append(_decoded(rows.coalesce(SLOTS[slot]) if slot in SLOTS else rows, None))
    none = F.lit(None).cast(_RASTER)
    if jvm_suffixes := sorted(here.difference(DECODERS)):
        jvm = files.where(F.col("suffix").isin(jvm_suffixes))
        paths = [r["path"] for r in jvm.where(~basename().rlike("^[._]")).select("path").collect()]
        parts.append(jvm.join(_jvm_rasters(spark, paths), "path", "left").select(*files.columns, "raster") if paths else jvm.withColumn("raster", none))
    parts.append(files.where(~F.col("suffix").isin(*DECODERS, *JVM_SUFFIXES)).withColumn("raster", none))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("*", "raster.gray", "raster.width", "raster.height").drop("raster")


def with_hashes(files: DataFrame, algorithm: str) -> DataFrame:
    """``files`` with width, height, the chosen hash and its mask for a perceptual algorithm, or with md5: no other is computed.

    A perceptual hash is null where a file could not be decoded; md5 is 'error' where it could not be read.
    """
    if algorithm == "md5":
        return files.withColumn("md5", file_md5("path"))
    hashed = with_rasters(files).withColumn(algorithm, hasher(algorithm)("gray")).drop("gray")
    return hashed.withColumn("hash_mask", F.when(F.col(algorithm).isNotNull(), 1 << ALGORITHMS.index(algorithm)).otherwise(0))
