"""Token ids as Arrow files of fixed-size lists: equal-length sequences with masks, readable in place.

Documents are dealt by range of doc_id (nulls first); each partition concatenates its documents' ids, cuts the run into
rows of ``LENGTH`` ids and writes an Arrow file whose batches hold a fixed-size list of ids (uint16 if the vocabulary's
ids fit, else uint32) and a fixed-size list of booleans, false on the padding of the last row.  Row r of a file is ``LENGTH`` ids at a
known offset, so a memory-mapped reader gets it without a copy.  A second Arrow file holds each document's id, first
position in its part and count.  The parts' totals (one number a file) give the positions over the whole corpus.

Edge cases: a null or empty text is the end id alone; repeated ids keep one entry each, side by side in any order; an
empty table gives no rows; a document longer than a row runs over several rows; other columns, of any names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, byte_letters
from .common import documents, id_text, open_store, per_worker, publish, shared_folder, slices

LENGTH = 2048
ROWS = 256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def open_arrow(uri: str) -> pa.RecordBatchFileReader:
    """Memory-mapped where the store is a file system, streamed otherwise."""
    from pyarrow import fs

    store, path = open_store(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


class Packer:
    """Writes a run of ids as fixed-size rows, holding less than one batch of them."""

    def __init__(self, sink, dtype, length: int):
        self.length, self.dtype = length, np.dtype(dtype)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        if self.size >= self.length * ROWS:
            run = np.concatenate(self.held)
            whole = len(run) // (self.length * ROWS) * self.length * ROWS
            for at in range(0, whole, self.length * ROWS):
                self._emit(run[at : at + self.length * ROWS], self.length * ROWS)
            self.held, self.size = [run[whole:]], len(run) - whole

    def _emit(self, run: np.ndarray, real: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(run), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(run)) < real), self.length)
        self.writer.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def close(self) -> None:
        if self.size:
            run = np.concatenate(self.held)
            self._emit(np.concatenate([run, np.zeros(-len(run) % self.length, self.dtype)]), len(run))
        self.writer.close()


def tokenizer_encoder(path: str) -> Encoder:
    """The tokenizers library's byte-level BPE model behind the chunk memo.

    Pre-tokens are matched here and merged by the library's model, as its own pipeline does for a byte-level
    pre-tokenizer without normaliser; special strings inside a text are their special ids, the library's default.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    model, table = whole.model, {b: ord(c) for b, c in enumerate(byte_letters())}

    def encode_words(words):
        return [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(table))] for w in words]

    specials = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    return Encoder(encode_words, PATTERN, specials)


def id_dtype(path: str, end_id: int) -> type:
    """The narrowest unsigned type that holds every id of the vocabulary and the end id."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return np.uint16 if max(end_id, *vocabulary.values()) <= np.iinfo(np.uint16).max else np.uint32


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Encode and write; returns one row per part: part, n_ids, ids_path, index_path.  The part numbers follow doc_id."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    dtype = id_dtype(tokenizer, end_id)

    def run(batches):
        encoder = per_worker(("tokenizer", tokenizer), lambda: tokenizer_encoder(tokenizer))
        part, end = TaskContext.get().partitionId(), np.array([end_id], dtype=np.uint32)
        doc_ids, starts, counts, total = [], [], [], 0

        def write(sink):
            nonlocal total
            packer = Packer(sink, dtype, length)
            for batch in batches:
                doc_ids.append(batch.column(0))
                for found in (x for _, buf, offsets in slices(batch, "text") for x in encoder.encode(buf, offsets)):
                    ids = np.concatenate([found, end])
                    packer.add(ids)
                    starts.append(total)
                    counts.append(len(ids))
                    total += len(ids)
            packer.close()

        ids_path, index_path = f"{folder}/part-{part:06d}.arrow", f"{folder}/part-{part:06d}.index.arrow"
        publish(ids_path, write)
        if not total:
            return
        index = pa.table({"doc_id": pa.chunked_array(doc_ids), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})

        def write_index(sink):
            with pa.ipc.new_file(sink, index.schema) as writer:
                writer.write_table(index, max_chunksize=1 << 16)

        publish(index_path, write_index)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([ids_path]), pa.array([index_path])], names=["part", "n_ids", "ids_path", "index_path"])

    dealt = id_text(docs, id_col, text_col).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return dealt.mapInArrow(run, "part int, n_ids long, ids_path string, index_path string")


def read_token_files(parts: list, spark: SparkSession, length: int = LENGTH) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the written files; ``parts`` are the rows that the writer returned."""
    base, rows = 0, []
    for row in sorted(parts, key=lambda r: r["part"]):
        rows.append((row["ids_path"], row["index_path"], base))
        base += row["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for ids_path, index_path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, index = open_arrow(ids_path), open_arrow(index_path)
                span = length * ROWS
                held: tuple[int, np.ndarray | None] = (-1, None)
                for k in range(index.num_record_batches):
                    rows = index.get_batch(k)
                    starts, counts = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                    sums = []
                    for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
                        crc, at = 0, s
                        while at < s + n:
                            if held[0] != at // span:
                                held = (at // span, ids.get_batch(at // span).column(0).flatten().to_numpy())
                            low = at % span
                            high = min(span, low + s + n - at)
                            crc = zlib.crc32(held[1][low:high].astype("<u4").tobytes(), crc)
                            at += high - low
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(starts + base, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "ids_path string, index_path string, base long").repartition(len(rows))
    return files.mapInArrow(run, schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_token_files(parts.collect(), spark)


QUERIES = {"op8_token_files": op8_token_files}
ORACLE: dict[str, str] = {}
