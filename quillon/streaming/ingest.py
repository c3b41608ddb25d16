"""Incremental ingest: new files of a folder go through an index once, by Structured Streaming's own bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..index import VectorIndex
from ..operators import maintain

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_new_files(index: VectorIndex, folder: str, checkpoint: str, describe=None):
    """Process what has come since the last call, then stop.  A batch repeated after a failure finds its files unchanged."""
    stream = index.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    files = stream.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size")
    ).where(P.is_supported(F.col("path")))

    def items(batch):
        todo = maintain.needs_update(batch, index.store.table("records"))
        told = describe(todo) if describe else todo.withColumn("text", F.col("path"))
        return told.select("*", F.col("path").alias("item"), F.col("path").alias("file_path"), F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size"))

    return ingest_stream(index, files, checkpoint, items)


def ingest_stream(index: VectorIndex, stream: DataFrame, checkpoint: str, items: Callable[[DataFrame], DataFrame]):
    """Add what ``items`` makes of every new batch of a stream of any source, then stop.  The number of the last batch is in the
    manifest of its commit, so a batch that is repeated after a failure isn't added twice."""

    def add(batch: DataFrame, number: int) -> None:
        index.refresh()
        index.add_batch(items(batch), checkpoint, number)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
