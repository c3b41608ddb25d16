"""Embedding whitening from an exact scatter matrix in a residue number system.

An entry c is the integer ``x = floor(SCALE * c) + SHIFT``.  Sums of x are exact; with n vectors and sums S every task centres its
rows as ``n * x - S`` modulo several primes, multiplies the residues as double matrices (all partial sums stay below 2^53, so the
products are exact), and adds tiles up modulo each prime.  The tiles of all tasks are added up by tile, prime and salt, then by tile,
where Chinese remaindering gives the integers of the scatter matrix; divided by n^3 they are the covariance, each entry correctly
rounded.  The primes are as many as the sums' bound asks for.  The driver gets the sums of each dimension and the
covariance (dims^2 doubles), whose eigenvectors it takes by ``eigh``.

Defined results: a vector that is null, or holds a null, a non-finite entry or one beyond +-2^52 (whose x a long doesn't hold with
room to spare), is dropped, and so is one of another length than most have (the longer, on a tie); an empty vector has no components, so a
table of empty vectors gives no rows.  Null and repeated ids are kept, a row each; ties and repeated vectors count as often as they are there.  An
empty table gives no rows.  Where eigenvalues vanish (fewer distinct vectors than dimensions) ``whitened`` is null for these
components, and they don't count in ``identity_error`` (null, if none is left); ``explained`` is null where all vectors are equal.  ``deviation`` is null
beyond 64 bits; ``deviation_text`` always has its digits.  Other columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
MOST_ENTRY = float(1 << 52)
PRIME_BITS = 20
BLOCK_ROWS = 8192  # centred residues are below 2^19 and their products below 2^38, so sums stay below 2^51
TILE = 256
SALTS = 16
ROWS_PER_TILE_ROW = 5  # a task takes so many times dims * primes rows at least, so that its tiles are small beside its input


def primes(bound: int) -> list[int]:
    """The greatest primes below 2^PRIME_BITS, as many as it takes for their product to exceed the bound."""
    out: list[int] = []
    p = (1 << PRIME_BITS) - 1
    while math.prod(out) <= bound:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
        p -= 2
    return out


def rebuilt(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers (Python's, in an object array) of least absolute value with these residues, by mixed radix digits."""
    value = residues[0].astype(object)
    product = moduli[0]
    for r, p in zip(residues[1:], moduli[1:], strict=True):
        digit = ((r.astype(np.int64) - (value % p).astype(np.int64)) * pow(product, -1, p)) % p
        value = value + digit.astype(object) * product
        product *= p
    return np.where(value > product // 2, value - product, value)


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """The rows' x as a matrix of longs."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


@dataclass
class Moments:
    """n vectors; of each dimension the sum, and the largest difference of two entries over all of them."""

    n: int
    sums: list[int]
    spread: int
    largest: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    def moduli(self) -> list[int]:
        """Centred entries are n * spread at most, so entries of the scatter matrix are n times the square of that."""
        return primes(2 * self.n * (self.n * self.spread) ** 2 + 1)


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: the rows that count, of one length."""
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= MOST_ENTRY))
    fine = rows.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    lengths = fine.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1)
    most = lengths.first()
    return fine.where(F.size("v") == (most.dims if most else 0))


def moments(rows: DataFrame) -> Moments:
    """Exact sums by task, then by dimension; a row of each dimension reaches the driver."""

    def local(batches):
        n, total, low, high = 0, None, None, None
        for batch in batches:
            if not batch.num_rows or not len(batch.column(0)[0]):
                continue
            x = integers(batch.column(0), len(batch.column(0)[0]))
            part = (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
            n, total = n + len(x), part if total is None else total + part
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            k = len(total)
            columns = [pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array([str(t) for t in total]), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, names=["pos", "n", "total", "low", "high"])

    parts = rows.select("v").mapInArrow(local, "pos int, n long, total string, low long, high long")
    sums = parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    got = sorted(sums.collect())
    if not got:
        return Moments(0, [], 0, 0)
    return Moments(got[0].n, [int(r.total) for r in got], max(r.high - r.low for r in got), max(max(abs(r.low), abs(r.high)) for r in got))


def tile_spans(dims: int) -> list[tuple[slice, slice]]:
    """The tiles on and above the diagonal."""
    cuts = [slice(a, min(a + TILE, dims)) for a in range(0, dims, TILE)]
    return [(a, b) for i, a in enumerate(cuts) for b in cuts[i:]]


def covariance_tiles(rows: DataFrame, m: Moments) -> DataFrame:
    """tile, entries: the covariance (divisor n) of each tile as row-major doubles."""
    moduli, spans, dims, n, sums = m.moduli(), tile_spans(m.dims), m.dims, m.n, m.sums
    least = ROWS_PER_TILE_ROW * dims * len(moduli)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / least))

    def multiply(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = integers(batch.column(0), dims)
            for at in range(0, len(x), BLOCK_ROWS):
                for k, p in enumerate(moduli):
                    r = ((n % p) * (x[at : at + BLOCK_ROWS] % p) - np.array([s % p for s in sums])) % p
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    for t, (a, b) in enumerate(spans):
                        product = (r[:, a].T @ r[:, b]).astype(np.int64)
                        held[t, k] = ((held[t, k] + product if (t, k) in held else product) % p).astype(np.uint32)
        yield from _rows(held, TaskContext.get().partitionId() % SALTS)

    def add(batches):
        merged: dict[int, dict] = {}
        for batch in batches:
            for t, k, salt, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = merged.setdefault(salt, {})
                got = np.frombuffer(blob, np.uint32).astype(np.int64)
                held[t, k] = ((held[t, k] + got) % moduli[k]).astype(np.uint32) if (t, k) in held else got.astype(np.uint32)
        for salt, held in merged.items():
            yield from _rows(held, salt)

    def remainder(tile: pa.Table) -> pa.Table:
        parts = [np.zeros(0)] * len(moduli)
        for k, blob in zip(tile["prime"].to_pylist(), tile["blob"].to_pylist(), strict=True):
            got = np.frombuffer(blob, np.uint32).astype(np.int64)
            parts[k] = (parts[k] + got) % moduli[k] if len(parts[k]) else got
        exact = rebuilt(parts, moduli)
        return pa.table({"tile": pa.array(tile["tile"].to_pylist()[:1], pa.int32()), "entries": pa.array([(exact / n**3).astype(np.float64).tobytes()], pa.binary())})

    kind = "tile int, prime int, salt int, blob binary"
    parts = rows.select("v").coalesce(tasks).mapInArrow(multiply, kind).repartition("tile", "prime", "salt").mapInArrow(add, kind)
    return parts.groupBy("tile").applyInArrow(remainder, "tile int, entries binary")


def _rows(held: dict[tuple[int, int], np.ndarray], salt: int):
    for (t, k), x in held.items():
        columns = [pa.array([v], pa.int32()) for v in (t, k, salt)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], names=["tile", "prime", "salt", "blob"])


def covariance(rows: DataFrame, m: Moments) -> np.ndarray:
    """The whole matrix on the driver: dims^2 doubles."""
    out, spans = np.zeros((m.dims, m.dims)), tile_spans(m.dims)
    for r in covariance_tiles(rows, m).toLocalIterator():
        a, b = spans[r.tile]
        out[a, b] = np.frombuffer(r.entries).reshape(a.stop - a.start, -1)
        out[b, a] = out[a, b].T
    return out


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def projected(rows: DataFrame, m: Moments, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation, deviation_text, w (whitened, an entry a component; null where the eigenvalue vanishes)."""
    n, sums, dims = m.n, m.sums, m.dims
    use = values > max(values.max(initial=0.0), 0.0) * dims * np.finfo(float).eps
    scale = np.sqrt(np.where(use, values, 1.0))
    # within these bounds longs hold the centred entries, and the sum of their squares
    short, fits = n * m.largest < 1 << 61, dims * (n * m.spread) ** 2 < 1 << 63

    def work(batches):
        for batch in batches:
            x = integers(batch.column(1), dims)
            d = n * x - np.array(sums, dtype=np.int64) if short else n * x.astype(object) - np.array(sums, dtype=object)
            far = (d * d).sum(axis=1).tolist() if fits and short else [sum(e * e for e in row) for row in d.tolist()]
            w = (d.astype(np.float64) / n) @ vectors / scale
            w = pa.array(w.ravel(), mask=np.broadcast_to(~use, w.shape).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(use)), w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f if f < 1 << 63 else None for f in far], pa.int64()), pa.array(map(str, far), pa.string()), lists],
                names=["vec_id", "deviation", "deviation_text", "w"],
            )

    return rows.select("vec_id", "v").mapInArrow(work, "vec_id long, deviation long, deviation_text string, w array<double>")


def identity_error(white: DataFrame, use: list[int]) -> float | None:
    """Largest absolute entry of w's covariance (components ``use``; centred first, divisor n) minus the identity."""
    if not use:
        return None
    mean = white.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in use]).first()
    centred = {i: F.col("w")[i] - F.lit(mean[f"m{i}"]) for i in use}
    pairs = [(i, j) for i in use for j in use if i <= j]
    got = white.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: RESULT.  The whitened vectors are stored once, and the error is measured on them."""
    rows = usable(embeddings, id_col, vector_col)
    m = moments(rows)
    if not m.n:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    v = covariance(rows, m)
    values, vectors = components(v, most)
    white = stored(projected(rows, m, values, vectors), "whitened")
    trace = float(np.trace(v))
    use = [i for i, e in enumerate(values) if e > max(values[0], 0.0) * m.dims * np.finfo(float).eps]
    error = identity_error(white, use)
    explained = F.array(*[F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in values])
    each = white.select("vec_id", F.posexplode("w").alias("at", "whitened"), "deviation", "deviation_text")
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_text",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLE: dict[str, str] = {}
