"""Shared pieces of the text operators: Arrow batches as byte buffers, vectorised word hashes, fixed-size filters.

Texts are read as UTF-8 bytes.  The word class ``[^\\x20\\x09-\\x0D]+`` and the A-Z lower-casing touch ASCII bytes
only, so both can be done on bytes without decoding.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = pow(_PRIME, -1, 1 << 64)
        for name, base in (("p", _PRIME), ("q", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"][:n], _powers["q"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """``c`` such that ``span_hash(c, s, e)`` depends on the bytes s..e alone."""
    p, _ = _power(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = _power(len(c))
    return mix64((c[end] - c[start]) * q[start] + (end - start).astype(np.uint64))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Split a batch by text bytes: yields (rows as a smaller batch, byte buffer, row offsets into the buffer).

    A null text is an empty one.  A single text above the limit forms a slice of its own.
    """
    column = batch.column(batch.schema.get_field_index(text))
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(raw, raw[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield batch.slice(at, to - at), data[raw[at] : raw[to]], raw[at : to + 1] - raw[at]
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry at the end)."""
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def run_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = mix64(out * U64(0x2545F4914F6CDD1D) + words[j : j + n])
    return out


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries, in two linear passes over blocks of w."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    if w == 1:
        return values.copy()
    pad = (-len(values)) % w
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


# ---- filters and sketches of a fixed size, merged on the executors ----

PARTS = 64


def merge_blobs(parts: DataFrame, kind: str, entries: int) -> DataFrame:
    """Merge (part int, blob binary) rows per part: ``or`` of bit sets (uint8) or ``add`` of counters (uint32).

    Streaming, with one array of ``entries`` per part in memory, so many senders don't form a large group.
    """
    dtype = np.uint8 if kind == "or" else np.uint32

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(blob), dtype=dtype)
                if part not in held:
                    held[part] = np.zeros(entries, dtype=dtype)
                held[part] = held[part] | got if kind == "or" else held[part] + np.minimum(got, U64(0xFFFFFFFF) - held[part]).astype(dtype)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())],
            names=["part", "blob"],
        )

    return parts.repartition(PARTS, "part").mapInArrow(merge, "part int, blob binary")


def gather_blobs(merged: DataFrame, kind: str, entries: int) -> np.ndarray:
    """The merged arrays end to end; PARTS rows of a fixed size reach the driver."""
    out = np.zeros(PARTS * entries, dtype=np.uint8 if kind == "or" else np.uint32)
    for part, blob in merged.collect():
        out[part * entries : (part + 1) * entries] = np.frombuffer(zlib.decompress(blob), dtype=out.dtype)
    return out


def split_blobs(array: np.ndarray) -> pa.RecordBatch:
    pieces = np.split(array, PARTS)
    keep = [i for i, x in enumerate(pieces) if x.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array(keep, pa.int32()), pa.array([zlib.compress(pieces[i].tobytes(), 1) for i in keep], pa.binary())], names=["part", "blob"]
    )


MOST_BLOOM_BITS = 28


def bloom_bits(keys: int) -> int:
    """16 bits a key, between 64 KB and 32 MB.  Beyond that the filter lets more through; it never loses a key."""
    return min(MOST_BLOOM_BITS, max(19, int(max(keys, 1) * 16 - 1).bit_length()))


def bloom_slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = mix64(hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes)
    return np.stack([h >> U64(64 - bits), (h >> U64(4)) & U64((1 << bits) - 1)])


def bloom_has(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """No false negatives; false positives cost work, never results."""
    bits = (len(bloom) * 8 - 1).bit_length()
    out = np.ones(len(hashes), dtype=bool)
    for slot in bloom_slots(hashes, bits):
        out &= (bloom[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1
    return out


def build_bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over one long column, built and merged on the executors; ``keys`` is read twice."""
    bits = bloom_bits(keys.count())

    def local(batches):
        bloom = np.zeros(1 << (bits - 3), dtype=np.uint8)
        some = False
        for batch in batches:
            for slot in bloom_slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                np.bitwise_or.at(bloom, slot >> U64(3), np.left_shift(np.uint8(1), (slot & U64(7)).astype(np.uint8)))
                some = True
        if some:
            yield split_blobs(bloom)

    parts = keys.mapInArrow(local, "part int, blob binary")
    entries = (1 << (bits - 3)) // PARTS
    return gather_blobs(merge_blobs(parts, "or", entries), "or", entries)


def prepare(spark: SparkSession) -> None:
    """Set the checkpoint folder that the cluster names; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def open_store(uri: str):
    """A pyarrow filesystem and the path within it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


_made: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder, which the driver and all executors share."""
    prepare(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    _made.append(f"{root}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made_folders() -> int:
    """How many shared folders this driver has made and not removed: a mark for ``remove_folders``."""
    return len(_made)


def remove_folders(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Remove the shared folders made since the mark, but the last ``keep``: for a caller that has stored its result there."""
    doomed = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    for uri in doomed:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def publish(uri: str, write) -> None:
    """Write a file under another name, then move it: a repeated task replaces the file by an equal one."""
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as sink:
        write(sink)
    store.move(draft, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table under the shared checkpoint folder and read it back: as ``saved``, but columnar and compressed."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_worker: dict = {}


def per_worker(key: tuple, make):
    """``make()``, kept for the later tasks of the same Python worker (the last few keys only)."""
    if key not in _worker:
        while len(_worker) >= 4:
            _worker.pop(next(iter(_worker)))
        _worker[key] = make()
    return _worker[key]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under names of its own; other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
