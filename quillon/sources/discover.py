"""Finding media files: listings by Spark's binaryFile source, whose content column is pruned away unless asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

LISTING = "path string, mtime double, size long, media_type string, file_hash string"


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True, kinds=("image", "video", "document")) -> DataFrame:
    """path, mtime (seconds), size, media_type, file_hash of supported files, by path; a folder that isn't there has none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    root = P.trimmed(folder)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(there):
        return spark.createDataFrame([], LISTING)
    path = F.regexp_replace("path", "^file:/*", "/")
    return listed(reader.load(root).select(path.alias("path"), "modificationTime", "length"), kinds)


def listed(files: DataFrame, kinds=("image", "video", "document")) -> DataFrame:
    """files (path, modificationTime, length) of supported kinds as path, mtime (seconds), size, media_type, file_hash, by path."""
    return files.where(P.is_supported(F.col("path"), kinds)).select(
        "path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size"), P.media_type(F.col("path")).alias("media_type"), P.fast_hash(F.col("length"), F.col("modificationTime")).alias("file_hash")
    ).orderBy("path")


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """path, md5 of the content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(P.trimmed(folder)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.md5("content").alias("md5"))


def cache_size(listing: DataFrame) -> DataFrame:
    """files and size_mb of a listing (size)."""
    return listing.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum("size"), F.lit(0)) / 1048576, 2).alias("size_mb"))


def missing_thumbnails(records: DataFrame, listing: DataFrame) -> DataFrame:
    """file_path and name of thumbnails to be made; listing has their names."""
    wanted = records.select("file_path", P.thumbnail_name(F.col("file_path")).alias("name"))
    return wanted.join(listing.select("name"), "name", "left_anti")


def delete_files(spark: SparkSession, folder: str, names: DataFrame) -> int:
    """Delete files (name) of one folder, in tasks, on any store that pyarrow opens; returns how many went.  A file that a repeated
    task finds gone already doesn't count."""
    root = P.trimmed(folder)

    def drop(batches):
        from pyarrow import fs

        store, top = (fs.LocalFileSystem(), root.removeprefix("file://")) if "://" not in root or root.startswith("file:") else fs.FileSystem.from_uri(root)
        for batch in batches:
            gone = []
            for name in batch["name"]:
                path = f"{top}/{name.rsplit('/', 1)[-1]}"
                if store.get_file_info(path).type == fs.FileType.File:
                    store.delete_file(path)
                    gone.append(name)
            yield batch[batch["name"].isin(gone)]

    return names.where("name is not null").select("name").distinct().mapInPandas(drop, "name string").count()


def load_files(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """name, content of the files of a folder that are asked for (name)."""
    files = spark.read.format("binaryFile").load(P.trimmed(folder)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.join(names.select("name").distinct(), "name", "left_semi")
