"""Ingest a folder from the command line: spark-submit quillon/ingest_folder.py --catalogue /data/indexes --index photos --folder /data/photos"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from quillon.index import CHUNK_ROWS, VectorIndex
from quillon.schema import INDEX_TYPES, THUMBNAIL_SIDE, pixels
from quillon.sources.models import decoder, embedder
from quillon.sources.snapshots import Catalogue


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Returns and prints what was added, skipped and failed."""
    flags = argparse.ArgumentParser(description="Add what is new or changed in a folder to an index.")
    flags.add_argument("--catalogue", "-c", required=True, help="folder of the indexes")
    flags.add_argument("--index", "-i", required=True, help="name of the index; made where it isn't there")
    flags.add_argument("--folder", "-f", required=True, help="folder of the files")
    flags.add_argument("--recursive", "-r", action="store_true", help="folders in it too")
    flags.add_argument("--model", "-m", default="hashing", help="a registered embedder or module:maker")
    flags.add_argument("--dims", type=int, default=64, help="dimensions of the vectors")
    flags.add_argument("--index-type", default="flat", choices=sorted(INDEX_TYPES))
    flags.add_argument("--decoder", default=None, help="module:maker of what reads pictures, videos and documents; without one a file's path is its text")
    flags.add_argument("--batch-size", "-b", type=int, default=16, help="items that a model gets at a time")
    flags.add_argument("--thumbnails", default=None, help="folder that missing thumbnails are written to, by the decoder")
    flags.add_argument("--thumbnail-size", "-t", type=int, default=THUMBNAIL_SIDE, help="longest side of a thumbnail")
    flags.add_argument("--max-resolution", default="1024x1024 (1MP)", help="preset that pictures are shrunk to")
    flags.add_argument("--chunk-rows", type=int, default=CHUNK_ROWS, help="files to a commit")
    flags.add_argument("--include-videos", action=argparse.BooleanOptionalAction, default=True)
    flags.add_argument("--include-documents", action=argparse.BooleanOptionalAction, default=True)
    given = flags.parse_args(args)
    kinds = ("image", *["video"] * given.include_videos, *["document"] * given.include_documents)
    spark = spark or SparkSession.builder.appName(f"ingest {given.index}").getOrCreate()
    index = VectorIndex(Catalogue(spark, given.catalogue), given.index, embedder(given.model, given.dims), given.index_type)
    reader = decoder(given.decoder, pixels(given.max_resolution)) if given.decoder else None
    if given.thumbnails and not reader:
        flags.error("thumbnails need a decoder")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, given.batch_size)
    try:
        counted = index.add_folder(given.folder, given.recursive, kinds, chunk_rows=given.chunk_rows, decoder=reader)
        if given.thumbnails:
            index.make_thumbnails(given.thumbnails, reader, given.thumbnail_size)
    finally:
        spark.conf.set(batch, before)
    print(", ".join(f"{what}: {n}" for what, n in counted.items()))
    return counted


if __name__ == "__main__":
    main()
