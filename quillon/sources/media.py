"""Plug points for decoders and models: functions over batches, run by the executors.

No decoder or model is bundled.  A decoder turns (path, content) into rows; an embedder turns items into vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions import sampling as S
from ..functions import words
from ..schema import MOST_PAGES


class Embedder(Protocol):
    """One that can carry columns along has ``embed_rows`` too; see the function of that name."""

    dims: int

    def embed(self, items: DataFrame) -> DataFrame:
        """items (item, text or content columns) to item, embedding."""


def embed_rows(embedder: Embedder, items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """item, embedding and the columns to keep: a row for each row of items that gets a vector.  With an embedder that carries
    columns, items (and what decodes them) are read once; else each item is embedded once and its rows are joined to that."""
    keep = [c for c in keep if c not in ("item", "embedding")]
    if hasattr(embedder, "embed_rows"):
        return embedder.embed_rows(items, keep)
    return items.select("item", *keep).join(embedder.embed(items.dropDuplicates(["item"])).select("item", "embedding"), "item")


class HashingEmbedder:
    """Word counts by hash bucket: a text embedder in built-in functions alone.  A text without words gets no vector."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, items: DataFrame) -> DataFrame:
        return words.hashed_vectors(items, "item", "text", self.dims)

    def embed_rows(self, items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        rows = items.select("item", *keep, F.col("text").alias("__text"), F.monotonically_increasing_id().alias("__row"))
        return words.hashed_vectors(rows, "__row", "__text", self.dims, keep=["item", *keep]).drop("__row")


class TableEmbedder:
    """Vectors made elsewhere: a table of item and embedding."""

    def __init__(self, table: DataFrame, dims: int):
        self.table, self.dims = table, dims

    def embed(self, items: DataFrame) -> DataFrame:
        return items.select("item").join(self.table, "item")

    def embed_rows(self, items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return items.select("item", *keep).join(self.table.select("item", "embedding"), "item")


class ColumnEmbedder:
    """Vectors that come with the items, in a column."""

    def __init__(self, dims: int, column: str = "vector"):
        self.dims, self.column = dims, column

    def embed(self, items: DataFrame) -> DataFrame:
        return self.embed_rows(items)

    def embed_rows(self, items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return items.select("item", *keep, F.col(self.column).cast("array<float>").alias("embedding"))


class BatchEmbedder:
    """A model called on pandas batches.  A batch that fails is tried again row by row; a row that fails then raises.  A row may get
    None instead of a vector."""

    def __init__(self, make: Callable[[], Callable[[pd.DataFrame], list[list[float]]]], dims: int):
        self.make, self.dims = make, dims

    def embed(self, items: DataFrame) -> DataFrame:
        return self.embed_rows(items)

    def embed_rows(self, items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        make, own = self.make, ["item", *keep]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for batch in batches:
                try:
                    got = model(batch)
                except Exception:
                    got = [model(batch.iloc[i : i + 1])[0] for i in range(len(batch))]
                vectors = pd.Series([None if v is None else list(map(float, v)) for v in got], dtype=object)
                yield batch[own].reset_index(drop=True).assign(embedding=vectors)

        kinds = StructType([*[items.schema[c] for c in own], StructField("embedding", ArrayType(FloatType()))])
        return items.mapInPandas(run, kinds)


class Decoder(Protocol):
    """How files become what an embedder reads, in transforms of tables; all but ``thumbnails`` are needed for their kind of file
    alone.  A row that can't be read is left out and counts as failed."""

    def pictures(self, files: DataFrame) -> DataFrame:
        """files (path, mtime, size and others) with what the embedder reads."""

    def videos(self, files: DataFrame) -> DataFrame:
        """files with fps and frame_count."""

    def frames(self, frames: DataFrame) -> DataFrame:
        """path, pos, frame to path, pos, item and what the embedder reads."""

    def documents(self, files: DataFrame) -> DataFrame:
        """files with page_count."""

    def pages(self, pages: DataFrame) -> DataFrame:
        """file_path, parent_document, page_number and others with item and what the embedder reads."""

    def thumbnails(self, files: DataFrame, side: int) -> DataFrame:
        """records' file_path, name (of the thumbnail) and others to name, content."""


def decode(files: DataFrame, decoder: Callable[[str, bytes], dict | None], schema: str) -> DataFrame:
    """files (path, content) through a decoder; what can't be decoded is a row of nulls but for its path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append({"path": path, **(decoder(path, bytes(content)) or {})})
                except Exception:
                    rows.append({"path": path})
            names = [part.split()[0] for part in f"path string, {schema}".split(", ")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def page_rows(documents: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """documents (path, page_count) as a row a page: parent_document, page_number, file_path."""
    pages = documents.select(F.col("path").alias("parent_document"), F.explode(S.pages(F.col("page_count"), most)).alias("page_number"))
    return pages.withColumn("file_path", F.concat("parent_document", F.lit("#page="), F.col("page_number").cast("string")))


def write_thumbnails(pictures: DataFrame, folder: str) -> None:
    """pictures (name, content): one file each in a folder that all executors reach, on any store that pyarrow opens.  Each is
    written under another name and then moved, so a repeated task replaces a file by an equal one."""

    def put(batches):
        import os
        import uuid

        from pyarrow import fs

        store, root = (fs.LocalFileSystem(), folder.removeprefix("file://")) if "://" not in folder or folder.startswith("file:") else fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as sink:
                    sink.write(bytes(content))
                store.move(draft, f"{root}/{os.path.basename(name)}")
            yield batch[["name"]]

    pictures.select("name", "content").mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()
