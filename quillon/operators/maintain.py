"""Catalogue maintenance as snapshot transforms: old tables in, new tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schema import DEFAULTS, RECORDS

COUNT_SCALE = 100.0


def needs_update(files: DataFrame, records: DataFrame) -> DataFrame:
    """files (path, mtime, size) that are new or changed."""
    known = records.select(F.col("file_path").alias("path"), F.col("file_mtime").alias("mtime"), F.col("file_size").alias("size"))
    same = (files.path == known.path) & files.mtime.eqNullSafe(known.mtime) & files["size"].eqNullSafe(known["size"])
    return files.join(known, same, "left_anti")


def upsert(records: DataFrame, changes: DataFrame, key: str = "file_path") -> DataFrame:
    """Rows of changes take the place of rows with their key."""
    return records.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def superseded(records: DataFrame, changes: DataFrame) -> DataFrame:
    """vector_id of records that changes replace by another vector: tombstones to be."""
    new = changes.select("file_path", F.col("vector_id").alias("__new"))
    return records.join(new, "file_path").where(F.col("vector_id") != F.col("__new")).select("vector_id")


def in_folder(records: DataFrame, folder: str, recursive: bool = True, legacy_like: bool = False) -> DataFrame:
    path = F.col("file_path")
    return records.where(P.under_legacy(path, folder) if legacy_like else P.under(path, folder, recursive))


def remove(records: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records without those of doomed (file_path), and the tombstones (vector_id) for them."""
    gone = doomed.select("file_path").distinct()
    return records.join(gone, "file_path", "left_anti"), records.join(gone, "file_path", "left_semi").select("vector_id")


def stale(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose file isn't among files (path); a page's file is its document."""
    return records.join(files.select(F.col("path").alias("__file")), F.coalesce("parent_document", "file_path") == F.col("__file"), "left_anti")


def orphans(thumbnails: DataFrame, records: DataFrame) -> DataFrame:
    """thumbnails (name) that no record asks for."""
    return thumbnails.join(records.select(P.thumbnail_name(F.col("file_path")).alias("name")), "name", "left_anti")


def validation(records: DataFrame, files: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """One row: records, stale (their file is gone), valid, orphans (thumbnails that no valid record asks for)."""
    lost = stale(records, files)
    valid = records.join(lost.select("file_path"), "file_path", "left_anti")
    counts = [df.agg(F.count("*").alias(n)) for n, df in (("records", records), ("stale", lost), ("valid", valid), ("orphans", orphans(thumbnails, valid)))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(counts[3])


def flagged(files: DataFrame, records: DataFrame) -> DataFrame:
    """files (path, mtime, size and others) with changed: new, or not as recorded."""
    known = records.select(F.col("file_path").alias("path"), F.col("file_mtime").alias("__mtime"), F.col("file_size").alias("__size"), F.lit(True).alias("__known"))
    same = F.col("__known").isNotNull() & F.col("mtime").eqNullSafe(F.col("__mtime")) & F.col("size").eqNullSafe(F.col("__size"))
    return files.join(known, "path", "left").withColumn("changed", ~same).drop("__mtime", "__size", "__known")


def ingest_counters(files: DataFrame, records: DataFrame) -> DataFrame:
    """files (path, mtime, size, kind): found, changed and skipped of each kind, in one pass."""
    both = flagged(files, records).groupBy("kind").agg(F.count("*").alias("found"), F.count_if("changed").alias("changed"))
    return both.select("kind", "found", "changed", (F.col("found") - F.col("changed")).alias("skipped"))


def migrated(records: DataFrame) -> DataFrame:
    """Records of any older layout: columns that are missing are added, and defaults stand where there is nothing."""
    kinds = [c.split() for c in RECORDS.split(", ")]
    have = [F.col(n).cast(k) if n in records.columns else F.lit(None).cast(k) for n, k in kinds]
    return records.select(*[(F.coalesce(c, F.lit(DEFAULTS[n])) if n in DEFAULTS else c).alias(n) for c, (n, _) in zip(have, kinds, strict=True)])


def compaction_advice(vectors: DataFrame, tombstones: DataFrame) -> DataFrame:
    """total, deleted, wasted_percent, needed: over 10 % or over 1000 deleted."""
    both = vectors.agg(F.count("*").alias("total")).join(tombstones.agg(F.count_distinct("vector_id").alias("deleted")))
    wasted = F.when(F.col("total") > 0, F.round(COUNT_SCALE * F.col("deleted") / F.col("total"), 2)).otherwise(0.0)
    return both.withColumn("wasted_percent", wasted).withColumn("needed", (F.col("wasted_percent") > 10) | (F.col("deleted") > 1000))


def dense_ids(ids: DataFrame, column: str = "vector_id", start: int = 0, partitions: int | None = None) -> DataFrame:
    """old, new: consecutive numbers in the order of the ids.

    Rows are dealt by range and numbered within a range; the ranges' counts (a row a partition) give the offsets, so no task
    sees all ids.  The number of ranges is fixed, so that counts and numbers see the same ones however many executors are there.
    """
    only = ids.select(F.col(column).alias("old")).distinct()
    dealt = only.repartitionByRange(partitions or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), "old").sortWithinPartitions("old")
    placed = dealt.select("old", F.spark_partition_id().alias("p"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("old")))
    sizes = placed.groupBy("p").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n")).select("p", "before")
    return numbered.join(F.broadcast(offsets), "p").select("old", (F.col("before") + F.col("k") - 1 + start).cast("long").alias("new"))


def compact(records: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records and vectors with dense ids for the vectors that records refer to, and the id map (old, new)."""
    ids = dense_ids(records)
    remap = lambda df: df.join(ids, F.col("vector_id") == F.col("old")).withColumn("vector_id", F.col("new")).drop("old", "new")
    return remap(records), remap(vectors), ids


def last_of_path(rows: DataFrame, place: str, path: str = "file_path") -> DataFrame:
    """Of the rows of one path the one with the greatest place, as if each had replaced the one before it."""
    return rows.withColumn("__last", F.row_number().over(Window.partitionBy(path).orderBy(F.desc(place)))).where("__last = 1").drop("__last", place)


def append_vectors(vectors: DataFrame, new: DataFrame, order: str = "file_path") -> DataFrame:
    """new with vector_id: the numbers after the greatest one so far, in the order of the paths, of which each is there once."""
    top = vectors.agg(F.coalesce(F.max("vector_id"), F.lit(-1)).alias("m")).first().m
    ids = dense_ids(new, order, top + 1).select(F.col("old").alias(order), F.col("new").alias("vector_id"))
    return new.drop("vector_id").join(ids, order)


def stats(records: DataFrame, vectors: DataFrame, tombstones: DataFrame, folders: DataFrame) -> DataFrame:
    """One row of figures about an index."""
    kinds = [F.count_if(F.col("media_type") == k).alias(f"{k}s") for k in ("image", "video", "document")]
    r = records.agg(F.count("*").alias("records"), *kinds, F.round(F.coalesce(F.sum("file_size"), F.lit(0)) / 1048576, 2).alias("size_mb"))
    f = folders.agg(F.count("*").alias("folders"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("added_at", "folder_path"))), lambda x: x.folder_path), ", ").alias("folder_list"))
    return r.join(compaction_advice(vectors, tombstones)).join(vectors.agg(F.coalesce(F.max("vector_id"), F.lit(-1)).alias("max_vector_id"))).join(f)


def stage_profile(timings: DataFrame, stage: str, seconds: str) -> DataFrame:
    """stage, n, mean, total, rate of a long table of stage timings."""
    return timings.groupBy(F.col(stage).alias("stage")).agg(
        F.count(seconds).alias("n"), F.round(F.avg(seconds), 6).alias("mean"), F.round(F.sum(seconds), 4).alias("total"), F.round(F.count(seconds) / F.sum(seconds), 6).alias("rate")
    )
