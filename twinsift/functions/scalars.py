"""Column expressions over paths, sizes and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import IMAGE_SUFFIXES, VIDEO_SUFFIXES

MB = 1024.0 * 1024.0


def basename(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: str = "name") -> Column:
    """Lower-case text after the last dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def category(of: str = "suffix") -> Column:
    """image before video before other."""
    return F.when(F.col(of).isin(IMAGE_SUFFIXES), "image").when(F.col(of).isin(VIDEO_SUFFIXES), "video").otherwise("other")


def utf16_length(text: str) -> Column:
    """Length in UTF-16 units, in which file names are measured."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def requested_size(width: str, height: str, target_width: int, target_height: int, ignore_aspect: bool = False) -> tuple[Column, Column]:
    """The size to decode at: a target of 0 follows from the aspect, at least 1; else the target, or what fits in it."""
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    at_least_one = lambda x: F.greatest(F.lit(1), F.round(x).cast("int"))
    if not target_width and not target_height:
        return F.col(width), F.col(height)
    if not target_width:
        return at_least_one(w * target_height / h), F.lit(target_height)
    if not target_height:
        return F.lit(target_width), at_least_one(h * target_width / w)
    if ignore_aspect:
        return F.lit(target_width), F.lit(target_height)
    wide = w * target_height > h * target_width
    return (
        F.when(wide, F.lit(target_width)).otherwise(at_least_one(w * target_height / h)),
        F.when(wide, at_least_one(h * target_width / w)).otherwise(F.lit(target_height)),
    )


def decode_slot(of: str = "suffix", width: str = "width", height: str = "height") -> Column:
    """Which decodes run one at a time (JPEG 2000, PNG beyond 128 MiB of pixels) or two (camera raw)."""
    from ..schema import JPEG2000_SUFFIXES, RAW_SUFFIXES

    large = F.col(of).isin("png", "apng") & (F.col(width).cast("long") * F.col(height) * 4 > 128 * 1024 * 1024)
    return F.when(F.col(of).isin(JPEG2000_SUFFIXES), "jpeg2000").when(large, "large_png").when(F.col(of).isin(RAW_SUFFIXES), "raw").otherwise("free")


def hash_mask() -> Column:
    """A bit for each perceptual hash that is there, dhash lowest."""
    names = ("dhash", "phash", "ahash", "whash", "bhash")
    return sum((F.when(F.col(n).isNotNull(), 1 << bit).otherwise(0) for bit, n in enumerate(names)), F.lit(0))


def hamming(a: str, b: str) -> Column:
    """Differing bits of two hashes as structs or columns w0 .. w3 of 64 bits."""
    return sum((F.bit_count(F.col(f"{a}w{i}").bitwiseXOR(F.col(f"{b}w{i}"))) for i in range(4)), F.lit(0))


def similarity(distance: str) -> Column:
    """A member's percentage: 100 less the whole part of distance x 100 / 256."""
    return F.expr(f"100 - {distance} * 100 div 256")


def card_similarity(algorithm: str, distance: str, leader: str, equal: str) -> Column:
    """What a member's card shows, as text: 100 for the leader; by md5 100 or 0; else the percentage, or a dash without a hash.

    ``distance`` (null without a hash), ``leader`` and ``equal`` (the same digest) name columns.
    """
    alike = F.when(F.col(equal), "100%").otherwise("0%") if algorithm == "md5" else F.coalesce(F.concat(similarity(distance).cast("string"), F.lit("%")), F.lit("-"))
    return F.when(F.col(leader), "100%").otherwise(alike)


def threshold_label(threshold: str) -> Column:
    """A threshold's percentage: 100 less the rounded threshold x 100 / 256."""
    return (100 - F.round(F.col(threshold) * 100.0 / 256)).cast("int")


def size_text(size: str = "size") -> Column:
    return F.format_string("%.2f MB", F.col(size) / MB)


def resolution_text(width: str = "width", height: str = "height", missing: str = "-") -> Column:
    sound = (F.col(width) > 0) & (F.col(height) > 0)
    return F.when(sound, F.concat_ws("x", F.col(width), F.col(height))).otherwise(missing)
