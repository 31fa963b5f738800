"""A library of files on disk: scanned, hashed as far as the cache does not know, grouped, thinned out.

    library = Library.scan(spark, "/photos", "dhash", recursive=True, cache="/photos-cache")
    library.groups(most=4).show()
    results = move_to_trash(library.plan("newest"), "/trash", dry_run=False)
    library = library.forget_deleted(results)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashes import words
from .functions.scalars import card_similarity, hamming, hash_mask
from .operators import cache as caches
from .operators import group, keep
from .operators.order import indexed
from .operators.stage import materialised
from .schema import ALGORITHMS
from .sources.files import classified, list_folder, with_hashes
from .streaming.checkpoint import BATCH_FILES, in_batches

_META = ["width", "height", *ALGORITHMS]


@dataclass(frozen=True)
class Library:
    """Files in canonical order with their hashes, and what the scan counted; members once it is grouped."""

    spark: SparkSession
    algorithm: str
    files: DataFrame
    discovered: int
    cache_hits: int
    cancelled: bool
    store: caches.SnapshotCache | None
    most: int = 4
    singles: bool = False

    @classmethod
    def scan(
        cls,
        spark: SparkSession,
        folder: str,
        algorithm: str = "dhash",
        recursive: bool = False,
        images: bool = True,
        videos: bool = False,
        others: bool = False,
        cache: str | None = None,
        batch_files: int = BATCH_FILES,
        cancelled: Callable[[], bool] = lambda: False,
    ) -> Library:
        """Scan a folder that all executors see. Perceptual hashes take images alone, md5 the categories asked for.

        What the cache holds of a file with the same time and size is not computed again. Rows are
        hashed in batches that are in the cache before the next begins, so a scan that ends early
        is taken up by the next. Files that cannot be decoded are left out and tried again next
        time; a digest that failed stays 'error'. Cached paths that are gone from the folder are dropped.
        """
        if algorithm not in ALGORITHMS:
            raise ValueError(f"algorithms are {', '.join(ALGORITHMS)}")
        exact = algorithm == "md5"
        store = caches.SnapshotCache(spark, cache) if cache else None
        listed = materialised(list_folder(spark, folder, recursive))
        found = classified(listed, images or not exact, videos and exact, others and exact)
        held = store.load() if store else spark.createDataFrame([], caches.CACHE_SCHEMA)
        known = materialised(caches.lookup(found, held))
        counts = known.agg(F.count("*").alias("discovered"), F.count_if("hit").alias("hits")).first()
        files = indexed(known, "idx", F.lower("path"), F.col("path"))
        pending = files.where(F.col(algorithm).isNull())
        if exact:
            pending = group.shared_sizes(files).where("md5 is null or md5 = ''")
        pending = materialised(pending.select("idx", "path", "rel_path", "suffix", "size", "mtime", "hit", *_META))

        results: list[DataFrame] = []

        def work(batch: DataFrame) -> DataFrame:
            made = with_hashes(batch.select("idx", "path", "suffix"), algorithm)
            fresh = [c for c in ("width", "height", algorithm) if c in made.columns]
            # other hashes of a hit are kept
            return materialised(batch.drop(*fresh).join(made.select("idx", *fresh), "idx").where(F.col(algorithm).isNotNull()))

        def done(batch: DataFrame) -> None:
            results.append(batch)
            if store:
                store.append(batch)

        whole = in_batches(pending, work, done, batch_files, cancelled)
        made = None
        for batch in results:
            part = batch.select("idx", *_META)
            made = part if made is None else made.unionByName(part)
        if made is not None:
            ready = files.join(made.select("idx"), "idx", "left_anti")
            files = ready.unionByName(files.drop(*_META).join(made, "idx"))
        if not exact:
            files = files.where(F.col(algorithm).isNotNull())
        files = materialised(files.withColumn("hash_mask", hash_mask()).withColumn("selected", F.lit(False)).drop("hit"))
        if store and whole:
            now = store.load()
            present = listed if recursive else materialised(list_folder(spark, folder, True))
            gone = caches.missing(now, found, present.select("rel_path"))
            if results or not gone.isEmpty():
                store.delete(gone)
        return cls(spark, algorithm, files, counts["discovered"], counts["hits"], not whole, store)

    def grouping(self, most: int = 4, singles: bool = False) -> Library:
        """The same with another greatest distance, and with or without groups of one file."""
        return replace(self, most=most, singles=singles)

    def members(self) -> DataFrame:
        """group_id, leader_idx, idx, pos."""
        if self.algorithm == "md5":
            return group.numbered(group.md5_members(self.files, self.singles))
        hashes = self.files.select("idx", F.col(self.algorithm).alias("hash"))
        return group.numbered(group.representative_members(hashes, self.most, self.singles))

    def groups(self) -> DataFrame:
        """group_id, files, bytes, mb."""
        return group.group_stats(self.members(), self.files)

    def cards(self) -> DataFrame:
        """Members with path, size and similarity to their leader, as shown."""
        own = F.col("md5") if self.algorithm == "md5" else F.col(self.algorithm)
        files = self.files.select("idx", "path", "size", own.alias("hash"))
        shown = files if self.algorithm == "md5" else files.select("*", *words("hash"))
        both = self.members().join(shown.alias("m"), "idx").join(shown.withColumnRenamed("idx", "leader_idx").alias("l"), "leader_idx")
        distance = F.lit(None).cast("int") if self.algorithm == "md5" else hamming("m.", "l.")
        measured = both.select("group_id", "idx", "pos", "m.path", "m.size", distance.alias("dist"), (F.col("pos") == 0).alias("leads"), F.col("m.hash").eqNullSafe(F.col("l.hash")).alias("same"))
        return measured.select("group_id", "idx", "pos", "path", "size", card_similarity(self.algorithm, "dist", "leads", "same").alias("similarity"))

    def select(self, selection: DataFrame) -> Library:
        """The same with the paths of ``selection`` selected."""
        return replace(self, files=keep.with_selection(self.files, selection))

    def plan(self, rule: str = "newest") -> DataFrame:
        """What to delete so that one file of each exact group stays; groups of other algorithms are not thinned out unseen."""
        if self.algorithm != "md5":
            raise ValueError("only exact copies are chosen by rule; select files of other groups")
        return keep.deletion_plan(self.members(), self.files, rule)

    def selected_plan(self, group_id: int | None = None) -> DataFrame:
        members = self.members()
        return keep.selected_in_all(members, self.files) if group_id is None else keep.selected_in_group(members, self.files, group_id)

    def forget_deleted(self, results: DataFrame) -> Library:
        """The library, and its cache, without the paths that ``results`` (path, status) has as deleted; groups follow from what is left."""
        gone = self.files.join(results.where("status = 'deleted'").select("path").distinct(), "path", "left_semi")
        if self.store:
            self.store.delete(gone.select("rel_path"))
        return replace(self, files=materialised(keep.forget(self.files, results)))
