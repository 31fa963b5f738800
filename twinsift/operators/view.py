"""Filter, search, sort and show groups."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GroupFilter:
    """What a filter text asks: least files, least megabytes, and terms that all must occur."""

    files: int = 0
    mb: float = 0.0
    terms: tuple[str, ...] = field(default=())

    @classmethod
    def parse(cls, text: str) -> GroupFilter:
        """min:N, minmb:X, size>=X and Xmb, of which the greatest counts; any other token is a term.

        A token of these forms whose number does not parse is dropped.
        """
        files, mb, terms = 0, 0.0, []
        for token in text.lower().split():
            form = next((f for f in ("min:", "minmb:", "size>=") if token.startswith(f)), None)
            if form == "min:":
                files = max(files, int(token[4:])) if re.fullmatch(r"[+-]?\d+", token[4:]) else files
            elif form or token.endswith("mb"):
                number = token[len(form) :] if form else token[:-2]
                mb = max(mb, float(number)) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", number) else mb
            else:
                terms.append(token)
        return cls(files, mb, tuple(terms))


def filter_groups(stats: DataFrame, members: DataFrame, files: DataFrame, text: str, singles: bool = False) -> DataFrame:
    """The groups of ``stats`` that a filter text leaves; each term may occur in another member's name."""
    asked = GroupFilter.parse(text)
    kept = stats.where((F.col("files") >= asked.files) & (F.col("mb") >= asked.mb))
    if not singles:
        kept = kept.where("files >= 2")
    if not asked.terms:
        return kept
    named = members.join(files.select("idx", "name"), "idx")
    has = [F.bool_or(F.lower("name").contains(term)) for term in asked.terms]
    every = has[0]
    for one in has[1:]:
        every = every & one
    return kept.join(named.groupBy("group_id").agg(every.alias("all")).where("all").select("group_id"), "group_id", "left_semi")


def search_files(members: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """Members whose name holds the trimmed text in any case; rows without a path never do."""
    named = members.join(files.select("idx", "path", "name"), "idx").where("path is not null and path <> ''")
    return named.where(F.lower("name").contains(text.strip().lower()))


def sort_groups(stats: DataFrame, by: str = "number") -> DataFrame:
    """By number, or by files or bytes from the most down; ties by number."""
    keys = {"number": [], "files": [F.desc("files")], "bytes": [F.desc("bytes")]}
    return stats.orderBy(*keys[by], "group_id")


def group_label() -> Column:
    return F.format_string("Group %d • %d files • %.2f MB", F.col("group_id") + 1, "files", "mb")


def pages(members: DataFrame, size: int = 12) -> DataFrame:
    """The members with the page of their group that shows them, by position."""
    return members.withColumn("page", F.floor(F.col("pos") / size).cast("int"))


def failures(results: DataFrame, shown: int = 12) -> DataFrame:
    """The first failed paths and, in each row, how many more there are."""
    failed = results.where("status = 'failed'")
    more = max(failed.count() - shown, 0)
    return failed.orderBy("path").limit(shown).select("path", F.lit(more).cast("long").alias("more"))
