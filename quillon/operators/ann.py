"""Approximate search: inverted lists, sign hashes, product quantisation.

Training uses at most ``TRAINING_SAMPLE`` vectors (``ROWS_PER_CENTER`` for each of many lists) and ``SAMPLE_BYTES`` of them on the
driver; every row is indexed.  How much a query reads (lists, flipped signs, candidates) is fitted on the sample: the least that finds
``RECALL`` of the exact answers of ``ASKED`` sample vectors.  Assigning rows is a matrix product a batch.  The assigned tables are made to be stored partitioned or
sorted by list or bucket, so that a query's filter prunes the scan to the ones it probes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import TOP_K, TRAINING_SAMPLE
from .search import BLOCK_BYTES, SAME, Best, _pairs, batch_topk, best_of, dots, flat_topk, meet, part_rows, ranked, tiles

SAMPLE_BYTES = 64 << 20
RECALL, KEPT = 0.95, 0.975  # of the exact answers: in the lists that are read; of these, among the rows that codes let through
ASKED = 200
LEAST_LISTS, FLAT_LISTS, ROWS_PER_CENTER, CELL_ROWS = 100, 1024, 40, 20_000
MODEL_BYTES = 256 << 20
DRIFT, GROWTH = 1.1, 4.0


def sampled(vectors: DataFrame, most: int = TRAINING_SAMPLE) -> DataFrame:
    """The rows whose hashed ids come first: the same on every run.  They are first cut by a hash threshold from the count, so that
    partitions send about as many rows as are wanted in all."""
    rows = vectors.where("embedding is not null")
    n, order = rows.count(), F.xxhash64("vector_id")
    share = (1.25 * most + 1000) / max(n, 1)
    if share < 1:
        rows = rows.where(order <= -(1 << 63) + int(share * (1 << 64)))
    return rows.orderBy(order, "vector_id").limit(most)


def sample_matrix(vectors: DataFrame, most: int = TRAINING_SAMPLE) -> np.ndarray:
    """The sample on the driver, SAMPLE_BYTES of doubles at most."""
    first = vectors.where("embedding is not null").select(F.size("embedding").alias("n")).first()
    if first is None:
        return np.zeros((0, 1))
    rows = sampled(vectors, min(most, max(1, SAMPLE_BYTES // (8 * first.n)))).select("embedding").toArrow()["embedding"]
    return rows.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)


def least_training(nlist: int) -> int:
    return max(10 * nlist, 1000)


def lists_for(rows: int, dims: int = 64) -> int:
    """How many inverted lists: the square root of the rows, a hundred at least, and MODEL_BYTES of centres at most, since every task
    holds them; lists are then longer, and read by more tasks."""
    return max(LEAST_LISTS, min(int(np.sqrt(rows)), MODEL_BYTES // (8 * dims)))


def drifted(notes: dict, stats: list[dict], fixed_lists: bool = False) -> bool:
    """Whether centres should be trained again: the rows now lie further from their centres (1 - cosine, over all segments) than DRIFT
    times what they did in training, or, unless the number of lists is set, there are GROWTH times as many."""
    rows = sum(s["rows"] for s in stats)
    loss = sum(s["rows"] * (s["loss"] or 0.0) for s in stats) / max(rows, 1)
    return loss > DRIFT * notes["loss"] + 1e-6 or (not fixed_lists and rows > GROWTH * notes["rows"])


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def spherical(points: np.ndarray, k: int, seed: int = 17, steps: int = 12) -> np.ndarray:
    """k-means by direction, for the few points of one cell."""
    points = unit(points)
    centers = points[np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(steps):
        own = np.argmax(points @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        used = np.bincount(own, minlength=len(centers)) > 0
        centers[used] = unit(sums[used])
    return centers


def k_means(vectors: DataFrame, k: int, seed: int = 17) -> np.ndarray:
    points = sampled(vectors).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=15, distanceMeasure="cosine").fit(points).clusterCenters())


def centroids(vectors: DataFrame, k: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray | None]:
    """The centres, and for each the coarse centre it lies under where there are over FLAT_LISTS.

    Then coarse centres are trained first, a square root of as many, and every cell of theirs is divided, by a bounded sample of its
    own, into a number of centres that follows its share of the rows: where most rows are, most lists are."""
    if k <= FLAT_LISTS:
        return k_means(vectors, k, seed), None
    coarse = Ivf(k_means(vectors, int(np.ceil(np.sqrt(k))), seed))
    points = coarse.assign(sampled(vectors, ROWS_PER_CENTER * k))
    counts = {r.list_id: r["count"] for r in points.groupBy("list_id").count().collect()}
    total = sum(counts.values())
    share = F.create_map(*[F.lit(x) for i, n in counts.items() for x in (i, min(1.0, CELL_ROWS / n))])
    few = points.where(F.pmod(F.xxhash64("vector_id", F.lit(1)), F.lit(1 << 20)) < F.try_element_at(share, F.col("list_id")) * (1 << 20))

    def divide(cell: pa.Table) -> pa.Table:
        own = cell["list_id"][0].as_py()
        column = cell["embedding"].combine_chunks()
        matrix = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
        found = spherical(matrix, max(1, round(k * counts[own] / total)), seed)
        return pa.table({"owner": pa.array([own] * len(found), pa.int32()), "center": pa.array(found.tolist(), pa.list_(pa.float64()))})

    rows = few.groupBy("list_id").applyInArrow(divide, "owner int, center array<double>").collect()
    rows.sort(key=lambda r: (r.owner, r.center))
    return np.array([r.center for r in rows]), np.array([coarse.centers[r.owner] for r in rows])


def exact_best(sample: np.ndarray, k: int = TOP_K) -> tuple[np.ndarray, np.ndarray]:
    """ASKED rows of the sample as queries, and the places of the exact best k of each."""
    asked = sample[:: max(1, len(sample) // ASKED)]
    k = min(k, max(1, len(sample) // 10))
    best = np.argpartition(-(asked @ sample.T), k - 1, axis=1)[:, :k] if len(sample) else np.zeros((0, 0), int)
    return asked, best


def least_effort(sample: np.ndarray, efforts: Sequence[int], candidates: Callable[[np.ndarray, int], np.ndarray], k: int = TOP_K) -> int:
    """The least of the efforts (ascending) whose candidates (a boolean over the sample) hold RECALL of the exact best k."""
    asked, best = exact_best(sample, k)
    for effort in efforts:
        found = [candidates(q, effort)[b].mean() for q, b in zip(asked, best, strict=True)]
        if not found or np.mean(found) >= RECALL:
            return effort
    return efforts[-1]


def by_batch(vectors: DataFrame, columns: str, work: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    """vector_id, embedding and the columns that ``work`` makes of a batch's matrix; rows without a vector go."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *work(matrix)], names=["vector_id", "embedding", *names])

    return vectors.where("embedding is not null").select("vector_id", "embedding").mapInArrow(run, f"vector_id long, embedding array<float>, {columns}")


class Ivf:
    """Inverted lists: a vector belongs to the list of its nearest centre; a query reads the ``nprobe`` nearest lists.

    With ``above`` (each centre's coarse centre) a vector looks for the nearest coarse centre first, then among those below it."""

    def __init__(self, centers: np.ndarray, nprobe: int = 10, above: np.ndarray | None = None, scale: np.ndarray | None = None, loss: float = 0.0):
        self.centers, self.nprobe, self.loss = unit(centers), nprobe, loss
        self.scale = np.ones(len(centers)) if scale is None else scale
        self.coarse, self.owner = (None, None) if above is None else np.unique(unit(above), axis=0, return_inverse=True)

    @classmethod
    def train(cls, vectors: DataFrame, nlist: int = LEAST_LISTS) -> Ivf:
        """Also fits how many lists a query reads, where the rows of a list lie on average, and how far rows are from their centres."""
        centers, above = centroids(vectors, nlist)
        made, sample = cls(centers, above=above), sample_matrix(vectors)
        if len(sample):
            lists = made.lists(sample)
            along = (sample * made.centers[lists]).sum(1)
            sizes = np.bincount(lists, minlength=len(made.centers))
            made.scale = np.where(sizes > 0, np.bincount(lists, along, len(made.centers)) / np.maximum(sizes, 1), 1.0)
            made.loss = float(np.mean(1 - along / np.maximum(np.linalg.norm(sample, axis=1), 1e-12)))
            asked, best = exact_best(sample)
            order = np.argsort(-(asked @ made.centers.T), axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(len(made.centers))[None, :], axis=1)
            ranks = np.sort(np.take_along_axis(place, lists[best], axis=1), axis=None)
            made.nprobe = int(ranks[int(np.ceil(RECALL * len(ranks) - 1e-9)) - 1]) + 1  # so many lists hold RECALL of all exact answers
        return made

    def table(self, spark: SparkSession) -> DataFrame:
        """list_id, center, nprobe and more: what ``load`` reads."""
        above = [None] * len(self.centers) if self.coarse is None else self.coarse[self.owner].tolist()
        rows = [(i, c.tolist(), self.nprobe, a, float(s), self.loss) for i, (c, a, s) in enumerate(zip(self.centers, above, self.scale, strict=True))]
        return spark.createDataFrame(rows, "list_id int, center array<double>, nprobe int, above array<double>, scale double, loss double")

    @classmethod
    def load(cls, table: DataFrame) -> Ivf:
        rows = table.orderBy("list_id").collect()
        above = None if rows[0].above is None else np.array([r.above for r in rows])
        return cls(np.array([r.center for r in rows]), rows[0].nprobe, above, np.array([r.scale for r in rows]), rows[0].loss)

    def lists(self, matrix: np.ndarray) -> np.ndarray:
        if self.coarse is None:
            return np.argmax(matrix @ self.centers.T, axis=1)
        first, out = np.argmax(matrix @ self.coarse.T, axis=1), np.zeros(len(matrix), dtype=np.int64)
        for cell in np.unique(first):
            rows, own = np.flatnonzero(first == cell), np.flatnonzero(self.owner == cell)
            out[rows] = own[np.argmax(matrix[rows] @ self.centers[own].T, axis=1)]
        return out

    def measured(self, vectors: DataFrame) -> DataFrame:
        """Adds list_id and __loss, one less the cosine with the centre."""

        def work(m: np.ndarray) -> list[pa.Array]:
            lists = self.lists(m)
            loss = 1 - (m * self.centers[lists]).sum(1) / np.maximum(np.linalg.norm(m, axis=1), 1e-12)
            return [pa.array(lists.astype(np.int32)), pa.array(loss)]

        return by_batch(vectors, "list_id int, __loss double", work)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """Adds list_id."""
        return self.measured(vectors).drop("__loss")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Assigned rows by list, to be written: a list is one task's or, where it is large, cut into as many as its bytes ask for."""
        rows = rows.hint("rebalance", "list_id")
        return rows if self.folders() else rows.sortWithinPartitions("list_id")

    def folders(self) -> list[str]:
        """A folder for each list, up to FLAT_LISTS of them; beyond, files are sorted by list and pruned by their statistics."""
        return ["list_id"] if len(self.centers) <= FLAT_LISTS else []

    def probes(self, query: Sequence[float], nprobe: int) -> list[int]:
        return np.argsort(-(self.centers @ np.asarray(query, dtype=float)), kind="stable")[:nprobe].tolist()

    def search(self, assigned: DataFrame, query: Sequence[float], k: int = TOP_K, nprobe: int | None = None) -> DataFrame:
        return flat_topk(assigned.where(F.col("list_id").isin(self.probes(query, nprobe or self.nprobe))), query, k)

    def routed(self, assigned: DataFrame, queries: DataFrame, k: int = TOP_K, nprobe: int | None = None) -> DataFrame:
        """query_id, vector_id, score, rank for every row of queries (query_id, embedding): a query goes to the lists that it probes
        and meets no others, so vectors are exchanged once (a list's only if it is probed) and a query ``nprobe`` times, once for every part of a list.

        Lists are cut into parts of a bounded number of bytes, and the queries of a list into blocks; how many, the lists' counts say."""
        kept = assigned.where("embedding is not null").select("vector_id", "embedding", "list_id")
        return best_of(_routed(self.probing(queries, nprobe or self.nprobe), kept, part_rows(len(self.centers[0])), lambda key, ids, matrix: Best(ids, matrix, k)), k)

    def probing(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """query_id, embedding, list_id: a row for each list that a query reads."""
        centers = self.centers

        def probe(matrix: np.ndarray) -> list[pa.Array]:
            best = np.argsort(-(matrix @ centers.T), axis=1, kind="stable")[:, :nprobe]
            return [pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))]

        asked = by_batch(queries.select(F.col("query_id").alias("vector_id"), "embedding"), "lists array<int>", probe)
        return asked.select(F.col("vector_id").alias("query_id"), "embedding", F.explode("lists").alias("list_id"))


def _routed(asked: DataFrame, kept: DataFrame, per_part: int, make) -> DataFrame:
    """Pairs of asked (query_id, embedding, list_id) with what is kept (vector_id, embedding, list_id) of the same list, in cells of
    ``per_part`` rows and BLOCK_BYTES of queries at most; ``make`` as for ``meet``, the list first in its key."""
    dims = F.greatest(F.max(F.size("embedding")), F.lit(1))
    cells = kept.groupBy("list_id").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
    blocks = asked.groupBy("list_id").agg(F.ceil(F.count("*") * dims * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    shape = cells.join(blocks, "list_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    q = asked.join(shape, "list_id").withColumn("block", own("query_id", "blocks")).withColumn("part", each("parts"))
    v = kept.join(shape, "list_id").withColumn("part", own("vector_id", "parts")).withColumn("block", each("blocks"))
    v = v.select(*[F.col(c).alias(c) for c in ("vector_id", "embedding", "list_id", "part", "block")])  # columns of its own: both sides have the shape's
    return meet(q.groupBy("list_id", "part", "block"), v.groupBy("list_id", "part", "block"), make)


class SignHashes:
    """Buckets of the signs of random projections, several tables; a query also probes buckets at one flipped sign."""

    def __init__(self, dims: int, bits: int = 5, tables: int = 8, seed: int = 5, flips: int = 3):
        self.planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
        self.seed, self.flips = seed, flips

    @classmethod
    def train(cls, vectors: DataFrame, dims: int, **shape) -> SignHashes:
        """The planes are fixed; how many signs a query flips is fitted."""
        made, sample = cls(dims, **shape), sample_matrix(vectors, 10_000)
        buckets = made.buckets(sample) if len(sample) else np.zeros((0, len(made.planes)), int)
        made.flips = least_effort(sample, range(made.planes.shape[1] + 1), lambda q, n: np.isin(buckets, made.probes(q, n)).any(axis=1))
        return made

    def table(self, spark: SparkSession) -> DataFrame:
        """tables, bits, dims, seed, flips: what ``load`` reads; the planes follow from them."""
        return spark.createDataFrame([(*self.planes.shape, self.seed, self.flips)], "tables int, bits int, dims int, seed int, flips int")

    @classmethod
    def load(cls, table: DataFrame) -> SignHashes:
        r = table.first()
        return cls(r.dims, r.bits, r.tables, r.seed, r.flips)

    def buckets(self, matrix: np.ndarray) -> np.ndarray:
        """A number for each row and table; tables don't share numbers."""
        tables, bits, _ = self.planes.shape
        signs = np.einsum("tbd,nd->ntb", self.planes, matrix) >= 0
        return (signs << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """The postings: a row for each vector and table, with bucket."""
        rows = by_batch(vectors, "buckets array<int>", lambda m: [pa.array(list(self.buckets(m).astype(np.int32)), pa.list_(pa.int32()))])
        return rows.select("vector_id", "embedding", F.explode("buckets").alias("bucket"))

    def probes(self, query: Sequence[float], flips: int) -> list[int]:
        bits, out = self.planes.shape[1], []
        for t, row in enumerate(self.planes @ np.asarray(query, dtype=float)):
            code = sum(1 << b for b, s in enumerate(row) if s >= 0)
            out += [(t << bits) + c for c in (code, *(code ^ (1 << int(b)) for b in np.argsort(np.abs(row))[:flips]))]
        return out

    def search(self, postings: DataFrame, query: Sequence[float], k: int = TOP_K, flips: int | None = None) -> DataFrame:
        near = postings.where(F.col("bucket").isin(self.probes(query, self.flips if flips is None else flips)))
        scored = near.select("vector_id", V.dot(F.col("embedding"), V.literal(query)).alias("score"))
        # a vector comes up once a table at most, so the best k * tables rows hold the best k vectors
        return ranked(ranked(scored, k * len(self.planes)).select("vector_id", "score").distinct(), k)


class Pq:
    """Product quantisation: each stretch of dimensions becomes the number of its nearest centre; a query looks its inner
    products with the centres up in a table.  ``refine`` times k candidates get their exact scores.

    With ``lists`` the codes are kept by inverted list and a query reads the nearest lists alone.  What is coded then is the difference
    from where the rows of the list lie on average; the list is one more code, whose table holds the query's inner products with
    these places."""

    def __init__(self, books: list[np.ndarray], lists: Ivf | None = None, refine: int = 10):
        self.books, self.lists, self.refine = books, lists, refine

    @classmethod
    def train(cls, vectors: DataFrame, m: int = 8, bits: int = 8, nlist: int = 0, lists: Ivf | None = None) -> Pq:
        sample = sample_matrix(vectors, min(TRAINING_SAMPLE, 200 << bits))
        if sample.shape[1] % m:
            raise ValueError(f"{sample.shape[1]} dimensions don't divide into {m} codes")
        lists = lists or (Ivf.train(vectors, nlist) if nlist else None)
        made, rng = cls([], lists), np.random.default_rng(3)
        for part in np.split(made.rest(sample[: 50 << bits])[0], m, axis=1):
            centers = part[rng.choice(len(part), min(1 << bits, len(part)), replace=False)]
            for _ in range(10):
                own = np.argmin(((part**2).sum(1)[:, None] - 2 * part @ centers.T + (centers**2).sum(1)), axis=1)
                for c in range(len(centers)):
                    if (own == c).any():
                        centers[c] = part[own == c].mean(0)
            made.books.append(centers)
        codes, k = made.codes(sample), min(20, max(1, len(sample) // 10))

        def kept(q: np.ndarray, refine: int) -> np.ndarray:
            rough = sum(t[codes[:, i]] for i, t in enumerate(made.tables(q)))
            out = np.zeros(len(sample), dtype=bool)
            out[np.argsort(-rough, kind="stable")[: refine * k]] = True
            return out

        made.refine = least_effort(sample, (2, 5, 10, 20, 40), kept, k)
        return made

    def table(self, spark: SparkSession) -> DataFrame:
        """part, code, center, refine: what ``load`` reads beside the lists."""
        return spark.createDataFrame([(p, c, row.tolist(), self.refine) for p, book in enumerate(self.books) for c, row in enumerate(book)], "part int, code int, center array<double>, refine int")

    @classmethod
    def load(cls, table: DataFrame, lists: DataFrame | Ivf | None = None) -> Pq:
        rows = table.orderBy("part", "code").collect()
        books = [np.array([r.center for r in rows if r.part == p]) for p in range(rows[-1].part + 1)]
        return cls(books, Ivf.load(lists) if isinstance(lists, DataFrame) else lists, rows[0].refine)

    def places(self) -> np.ndarray:
        return self.lists.centers * self.lists.scale[:, None]

    def rest(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """What is coded, and the rows' lists."""
        if self.lists is None:
            return matrix, None
        own = self.lists.lists(matrix)
        return matrix - self.places()[own], own

    def codes(self, matrix: np.ndarray) -> np.ndarray:
        rest, own = self.rest(matrix)
        width = self.books[0].shape[1]
        out = [np.argmin((b**2).sum(1) - 2 * rest[:, i * width : (i + 1) * width] @ b.T, axis=1) for i, b in enumerate(self.books)]
        return np.stack(out if own is None else [*out, own], axis=1)

    def tables(self, query: Sequence[float]) -> list[np.ndarray]:
        """Inner products with the centres of each stretch and, last, with the places of the lists."""
        q = np.asarray(query, dtype=float)
        out = [b @ part for b, part in zip(self.books, q.reshape(len(self.books), -1), strict=True)]
        return out if self.lists is None else [*out, self.places() @ q]

    def encode(self, vectors: DataFrame) -> DataFrame:
        """Adds codes (array<int>) and, with lists, list_id."""

        def work(m: np.ndarray) -> list[pa.Array]:
            codes = self.codes(m).astype(np.int32)
            own = [pa.array(list(codes), pa.list_(pa.int32()))]
            return own if self.lists is None else [*own, pa.array(np.ascontiguousarray(codes[:, -1]))]

        return by_batch(vectors, "codes array<int>" + ("" if self.lists is None else ", list_id int"), work)

    def search(self, encoded: DataFrame, query: Sequence[float], k: int = TOP_K, refine: int | None = None, nprobe: int | None = None) -> DataFrame:
        if self.lists is not None:
            encoded = encoded.where(F.col("list_id").isin(self.lists.probes(query, nprobe or self.lists.nprobe)))
        rough = sum((F.element_at(V.literal(t), F.col("codes")[i] + 1) for i, t in enumerate(self.tables(query))), F.lit(0.0))
        best = encoded.withColumn("__rough", rough).orderBy(F.desc("__rough"), "vector_id").limit((refine or self.refine) * k)
        return ranked(best.select("vector_id", V.dot(F.col("embedding"), V.literal(query)).alias("score")), k)

    def batch(self, encoded: DataFrame, queries: DataFrame, k: int = TOP_K, refine: int | None = None, nprobe: int | None = None) -> DataFrame:
        """query_id, vector_id, score, rank for a table of queries (query_id, embedding): each goes to the lists that it probes and ranks
        the codes there; the best ``refine`` times k of each list (of each part of a large one) get their exact scores where they lie, among
        them all that are the best ``refine`` times k of the lists together.  The best k leave a task."""
        held = (refine or self.refine) * k
        return best_of(self._met(encoded, queries, nprobe, lambda ids, matrix: Rough(ids, matrix, self.books, k, held)), k)

    def fitted(self, encoded: DataFrame, k: int = TOP_K, nprobe: int | None = None) -> int:
        """The least refine with which a batch scores KEPT of the exact best k of ASKED sampled vectors that are in the lists probed: what it takes grows
        with the lists, so it is measured on the whole table, which a sample of the rows can't tell."""
        asked = sampled(encoded, ASKED).select(F.col("vector_id").alias("query_id"), "embedding")
        exact = batch_topk(encoded, asked, k).groupBy("query_id").agg(F.min("score").alias("least")).collect()  # ASKED rows
        least = {r.query_id: r.least - SAME for r in exact}
        found = best_of(self._met(encoded, asked, nprobe, lambda ids, matrix: Places(ids, matrix, self.books, k, least)), k)
        places = sorted(r.vector_id for r in found.select("vector_id").collect())  # k for each that is asked
        return math.ceil((places[math.ceil(KEPT * len(places) - 1e-9) - 1] + 1) / k) if places else self.refine

    def _met(self, encoded: DataFrame, queries: DataFrame, nprobe: int | None, make) -> DataFrame:
        """What ``make(query ids, matrix)`` finds in each list that the queries probe; its rows are codes and, behind them, the vector."""
        rows = encoded.select("vector_id", F.concat(F.slice("codes", 1, len(self.books)).cast("array<float>"), "embedding").alias("embedding"), "list_id")
        per_part = part_rows(len(self.books) + sum(b.shape[1] for b in self.books))
        return _routed(self.lists.probing(queries, nprobe or self.lists.nprobe), rows, per_part, lambda _, ids, matrix: make(ids, matrix))


class Rough:
    """The best k of each query among the ``held`` rows of a list that are best by their codes.

    Products with the coded places are products with the rows' decoded rests: the place of the list adds the same to all of its rows."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, books: list[np.ndarray], k: int, held: int):
        self.ids, self.matrix, self.books, self.k, self.held = ids, matrix.astype(np.float64), books, k, held

    def add(self, own: np.ndarray, rows: np.ndarray):
        order, m = np.argsort(own, kind="stable"), len(self.books)
        own, codes, rows = own[order], rows[order, :m].astype(np.int64), rows[order, m:]
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1).astype(np.float32)
        for some in tiles(len(self.ids), len(own)):
            yield self.found(some, own, rows, self.matrix[some].astype(np.float32) @ decoded.T)

    def found(self, some: slice, own: np.ndarray, rows: np.ndarray, rough: np.ndarray) -> pa.RecordBatch:
        n = rough.shape[1]
        held, k = min(self.held, n), min(self.k, self.held, n)
        best = np.argpartition(rough, n - held, axis=1)[:, n - held :]
        score = dots(rows, best.ravel(), self.matrix[some], np.repeat(np.arange(len(best)), held)).reshape(best.shape)
        q, at = np.nonzero(score >= np.partition(score, held - k, axis=1)[:, held - k, None])  # with all that tie with the last
        v, score = best[q, at], score[q, at]
        order = np.lexsort((v, -score, q))  # rows are by id
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
        return _pairs(self.ids[some][q[order]], own[v[order]], score[order])

    def end(self):
        return ()


class Places(Rough):
    """For each query the places, by the codes, of the k best rows of a list among those that score ``least`` at least, in place of their ids.  A row
    comes behind all that have its codes, since any of them may be let through before it."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, books: list[np.ndarray], k: int, least: dict[int, float]):
        super().__init__(ids, matrix, books, k, k)
        self.least = least

    def found(self, some: slice, own: np.ndarray, rows: np.ndarray, rough: np.ndarray) -> pa.RecordBatch:
        score, k = self.matrix[some] @ rows.T.astype(np.float64), min(self.k, rough.shape[1])
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(score, best, 1)
        own_rough = np.take_along_axis(rough, best, 1)
        place = np.stack([(rough >= own_rough[:, i, None]).sum(axis=1) - 1 for i in range(k)], axis=1)
        q, at = np.nonzero(score >= np.array([self.least[i] for i in self.ids[some].tolist()])[:, None])
        return _pairs(self.ids[some][q], place[q, at], score[q, at])
