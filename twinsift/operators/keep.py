"""Which member of a group stays, and what a deletion would do. Nothing is deleted here."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import utf16_length
from .stage import materialised

#: The order that puts the keeper first; ties go to the lower path, then the lower idx.
RULES: dict[str, Callable[[], list[Column]]] = {
    "newest": lambda: [F.desc("mtime")],
    "oldest": lambda: [F.asc("mtime")],
    "filename_first": lambda: [F.lower("name").asc()],
    "filename_last": lambda: [F.lower("name").desc()],
    "shortest_name": lambda: [utf16_length("name").asc(), F.lower("name").asc()],
    "longest_name": lambda: [utf16_length("name").desc(), F.lower("name").asc()],
}


def _valid(members: DataFrame, files: DataFrame) -> DataFrame:
    there = files.where("path is not null and path <> ''")
    return members.join(there.select("idx", "path", "name", "mtime", "selected"), "idx")


def keepers(members: DataFrame, files: DataFrame, rule: str) -> DataFrame:
    """group_id, idx and path of the file that stays, for groups of two or more valid members.

    Each task keeps its best row of a group before rows are dealt by group.
    """
    valid = _valid(members, files)
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(*RULES[rule](), F.lower("path"), "idx"))
    best = valid.withColumn("place", place).where("place = 1").select("group_id", "idx", "path")
    return best.join(valid.groupBy("group_id").count().where("count > 1").select("group_id"), "group_id", "left_semi")


def deletion_plan(members: DataFrame, files: DataFrame, rule: str) -> DataFrame:
    """All valid members but the keeper of each group."""
    stays = materialised(keepers(members, files, rule).select("group_id", F.col("idx").alias("keeper")))
    return _valid(members, files).join(stays, "group_id").where("idx <> keeper").select("group_id", "path", F.lit(rule).alias("reason"))


def selected_in_group(members: DataFrame, files: DataFrame, group_id: int) -> DataFrame:
    return _valid(members, files).where((F.col("group_id") == group_id) & F.col("selected")).select("group_id", "path", F.lit("selected").alias("reason"))


def selected_in_all(members: DataFrame, files: DataFrame) -> DataFrame:
    """Each selected path once, with its first group."""
    return _valid(members, files).where("selected").groupBy("idx", "path").agg(F.min("group_id").alias("group_id")).select("group_id", "path", F.lit("selected").alias("reason"))


def deletion_preview(members: DataFrame, files: DataFrame) -> DataFrame:
    """One row: distinct selected files, groups that lose some, groups that lose all."""
    valid = _valid(members, files)
    groups = valid.groupBy("group_id").agg(F.count_if("selected").alias("selected"), F.count("*").alias("existing"))
    some = groups.select(F.lit(0).alias("file"), (F.col("selected") > 0).cast("int").alias("some"), ((F.col("selected") > 0) & (F.col("selected") == F.col("existing"))).cast("int").alias("all"))
    both = some.unionAll(valid.where("selected").select("idx").distinct().select(F.lit(1), F.lit(0), F.lit(0)))
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("file", "selected_files"), ("some", "affected_groups"), ("all", "emptied_groups"))))


def eligible(members: DataFrame, files: DataFrame) -> DataFrame:
    """One row: groups with more than one valid member, and how many files would go."""
    groups = _valid(members, files).groupBy("group_id").count().where("count > 1")
    return groups.agg(F.count("*").alias("eligible_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("delete_count"))


def forget(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """``files`` without the paths that were deleted."""
    gone = deleted.where("status = 'deleted'").select("path").distinct()
    return files.join(gone, "path", "left_anti")


def with_selection(files: DataFrame, selection: DataFrame) -> DataFrame:
    """``files`` with selected from a table of paths; other paths are not selected."""
    chosen = selection.select("path").distinct().withColumn("__chosen", F.lit(True))
    return files.drop("selected").join(chosen, "path", "left").withColumn("selected", F.coalesce("__chosen", F.lit(False))).drop("__chosen")


def select_group(files: DataFrame, members: DataFrame, group_id: int, selected: bool = True) -> DataFrame:
    """All members of a group selected or not, whatever a search hides."""
    of = members.where(F.col("group_id") == group_id).select("idx").withColumn("__of", F.lit(True))
    joined = files.join(of, "idx", "left")
    return joined.withColumn("selected", F.when(F.col("__of"), F.lit(selected)).otherwise(F.col("selected"))).drop("__of")


def move_to_trash(plan: DataFrame, trash: str, dry_run: bool = True, cancel_file: str | None = None) -> DataFrame:
    """Carry out a plan on files that all executors see: path and status (planned, deleted, failed, cancelled). Never unlinks.

    Files are moved into ``trash`` under names that follow from their paths, so a task that runs
    twice finds them there. Once ``cancel_file`` exists no further file is moved.
    """
    paths = plan.select("path").distinct()
    if dry_run:
        return paths.withColumn("status", F.lit("planned"))

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(trash, exist_ok=True)
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "status": [_moved(p, trash, cancel_file) for p in batch["path"]]})

    return materialised(paths.mapInPandas(move, "path string, status string"))


def _moved(path: str, trash: str, cancel_file: str | None) -> str:
    target = os.path.join(trash, f"{hashlib.md5(path.encode()).hexdigest()}-{os.path.basename(path)}")
    if not os.path.exists(path) and os.path.exists(target):
        return "deleted"
    if cancel_file and os.path.exists(cancel_file):
        return "cancelled"
    try:
        shutil.move(path, target)
    except OSError:
        return "failed"
    return "deleted"
