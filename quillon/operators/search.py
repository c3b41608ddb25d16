"""Inner-product search over vector tables.

One query is a literal array: the scan scores every row and keeps its best k before anything is exchanged.  Many queries
are worked through in matrix products of bounded size; a task sends its best k for a query.  Query sets up to ``BLOCK_BYTES`` go
out with the tasks, so the vectors stay where they are; larger ones are cut into blocks and the vectors into parts, both in
Spark and by bytes, and every pair of a block and a part is one bounded group.  That reads every vector for every query, as exact search
must; ``ann.Ivf.routed`` sends queries to the lists they probe instead.

A row without a vector (null) is never a hit, and a query without one has none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import MOST_K, TOP_K

BLOCK_BYTES = 8 << 20
PART_ROWS, PART_BYTES = 100_000, 64 << 20
STEP_QUERIES, STEP_CELLS = 512, 500_000
TILE_CELLS, STEP_BYTES = 4 << 20, 1 << 20
SAME = 1e-9  # scores so near are equal: the same products, added up in another order


def ranked(rows: DataFrame, k: int | None = None, *ties: str) -> DataFrame:
    """rows (with score) in order, at most k, with their rank from 1."""
    order = [F.desc("score"), *(F.asc(t) for t in ties or ("vector_id",))]
    best = rows.orderBy(*order).limit(k) if k is not None else rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def shown_best(rows: DataFrame, k: int, digits: int, *ties: str) -> DataFrame:
    """Of rows that are in order (score, rank) those whose score rounded to ``digits`` comes first, at most k, that score in place of the
    exact one: rows that show the same score are cut by the ties alone.  Ranks stay, so they may have gaps there."""
    shown = F.round("score", digits)
    return rows.withColumn("score", shown).orderBy(F.desc("score"), *(F.asc(t) for t in ties or ("vector_id",))).limit(k)


def within_shown(rows: DataFrame, k: int, digits: int, *ties: str) -> DataFrame:
    """``shown_best`` with the ranks of rows of any number: the k best are ranked with all that show the same score as the last of them."""
    order = [F.desc("score"), *(F.asc(t) for t in ties or ("vector_id",))]
    last = rows.orderBy(*order).limit(k).agg(F.min(F.round("score", digits)).alias("__last"))
    near = rows.join(F.broadcast(last), F.round("score", digits) >= F.col("__last")).drop("__last")
    return shown_best(near.withColumn("rank", F.row_number().over(Window.orderBy(*order))), k, digits, *ties)


def flat_topk(vectors: DataFrame, query: Sequence[float], k: int = TOP_K) -> DataFrame:
    """vector_id, score, rank of the k vectors with the largest inner product; ties by id."""
    return ranked(scored(vectors, query), k)


def scored(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """vector_id, score of every vector."""
    return vectors.where("embedding is not null").select("vector_id", V.dot(F.col("embedding"), V.literal(query)).alias("score"))


def check_dims(vectors: DataFrame, dims: int) -> DataFrame:
    """Fails at run time on a vector of another length."""
    return vectors.where(F.assert_true(F.size("embedding") == dims, F.lit(f"a vector doesn't have {dims} dimensions")).isNull())


def stored_vector(vectors: DataFrame, vector_id: int) -> list[float]:
    row = vectors.where(F.col("vector_id") == vector_id).select("embedding").first()
    if row is None:
        raise KeyError(vector_id)
    return list(row.embedding)


def part_rows(dims: int) -> int:
    """How many vectors meet a block of queries in one group: PART_BYTES of floats at most."""
    return max(1, min(PART_ROWS, PART_BYTES // (4 * max(dims, 1))))


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, vector_id, score, rank for every row of queries (query_id, embedding)."""
    return best_of(_in_blocks(vectors, queries, lambda ids, matrix: Best(ids, matrix, k)), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query's pairs, with their rank."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def within(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """query_id, vector_id, score of all pairs whose inner product is at least so large."""
    return _in_blocks(vectors, queries, lambda ids, matrix: _Near(ids, matrix, least))


SCORED = "query_id long, vector_id long, score double"


def _in_blocks(vectors: DataFrame, queries: DataFrame, make) -> DataFrame:
    """``make(query ids, matrix)`` gives an object with ``add(vector ids, matrix)`` and ``end()``, which yield batches of pairs."""
    vectors = vectors.where("embedding is not null").select("vector_id", "embedding")
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    count, dims = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    if count * dims * 8 <= BLOCK_BYTES:
        rows = asked.collect()  # BLOCK_BYTES at most
        ids, matrix = np.array([r.query_id for r in rows], dtype=np.int64), np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), dims)

        def local(batches):
            held = make(ids, matrix)
            for batch in batches if len(ids) else ():
                yield from held.add(*_matrix(batch))
            yield from held.end()

        return vectors.mapInArrow(local, SCORED)
    blocks, parts = math.ceil(count * dims * 8 / BLOCK_BYTES), math.ceil(vectors.count() / part_rows(dims))

    def cells(rows: DataFrame, id_col: str, own: str, others: str, n_own: int, n_others: int) -> DataFrame:
        placed = rows.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(n_own)).cast("int"))
        return placed.withColumn(others, F.explode(F.sequence(F.lit(0), F.lit(n_others - 1)))).groupBy("block", "part")

    return meet(cells(asked, "query_id", "block", "part", blocks, max(parts, 1)), cells(vectors, "vector_id", "part", "block", max(parts, 1), blocks), lambda _, ids, matrix: make(ids, matrix))


def meet(queries, vectors, make) -> DataFrame:
    """Pairs of what two grouped tables (query_id, embedding; vector_id, embedding) hold under the same key; ``make`` gets the key
    first, see ``_in_blocks``."""

    def one(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return pa.Table.from_batches([], schema=_PAIR)
        held = make(key, *_matrix(queries.select(["query_id", "embedding"]).combine_chunks()))
        return pa.Table.from_batches([*held.add(*_matrix(vectors.select(["vector_id", "embedding"]).combine_chunks())), *held.end()], schema=_PAIR)

    return queries.cogroup(vectors).applyInArrow(one, SCORED)


_PAIR = pa.schema([("query_id", pa.int64()), ("vector_id", pa.int64()), ("score", pa.float64())])


def _matrix(rows) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column(0).to_numpy() if isinstance(rows, pa.Table) else rows.column(0).to_numpy(zero_copy_only=False)
    column = rows.column(1).combine_chunks() if isinstance(rows, pa.Table) else rows.column(1)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 1)


def _pairs(query_ids: np.ndarray, vector_ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(vector_ids), pa.array(scores)], names=["query_id", "vector_id", "score"])


class Best:
    """The best k of each query over all that is added: a score matrix of ``STEP_CELLS`` at most, of ``STEP_QUERIES`` queries, beside the k held."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix.astype(np.float64), k
        self.tiles = _tiles(len(ids))
        self.held = [(np.zeros((t.stop - t.start, 0)), np.zeros((t.stop - t.start, 0), dtype=np.int64)) for t in self.tiles]

    def scores(self, some: slice, rows: np.ndarray) -> np.ndarray:
        return self.matrix[some] @ rows.T

    def steps(self, rows: np.ndarray):
        """The rows of a step, as ``scores`` takes them."""
        return rows.astype(np.float64)

    def add(self, own: np.ndarray, rows: np.ndarray):
        for step in _row_steps(len(own), self.tiles):
            ids, part = own[step], self.steps(rows[step])
            for i, some in enumerate(self.tiles):
                self.held[i] = self._better(*self.held[i], ids, self.scores(some, part))
        return ()

    def _better(self, held: np.ndarray, held_ids: np.ndarray, own: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(score)
        if held.shape[1] < self.k:
            if score.shape[1] > self.k:
                # the k best scores; all that tie with the last of them are looked at, so the least ids win
                cut = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
                keep = np.flatnonzero((score >= cut[:, None]).any(axis=0))
                own, score = own[keep], score[:, keep]
            score = np.concatenate([held, score], axis=1)
            ids = np.concatenate([held_ids, np.broadcast_to(own, (n, len(own)))], axis=1)
            best = np.lexsort((ids, -score), axis=1)[:, : self.k]
            return np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
        q, v = np.nonzero(score >= held[:, -1:])  # most rows are below the k best that a query holds
        if not len(q):
            return held, held_ids
        again = np.unique(q)
        query = np.concatenate([np.repeat(again, self.k), q])
        scores, ids = np.concatenate([held[again].ravel(), score[q, v]]), np.concatenate([held_ids[again].ravel(), own[v]])
        order = np.lexsort((ids, -scores, query))
        best = order[np.searchsorted(query[order], again)[:, None] + np.arange(self.k)]
        held[again], held_ids[again] = scores[best], ids[best]
        return held, held_ids

    def end(self):
        width = max((s.shape[1] for s, _ in self.held), default=0)
        if width:
            yield _pairs(np.repeat(self.ids, width), np.concatenate([i.ravel() for _, i in self.held]), np.concatenate([s.ravel() for s, _ in self.held]))


_Best = Best


def _tiles(n: int) -> list[slice]:
    return [slice(at, min(at + STEP_QUERIES, n)) for at in range(0, n, STEP_QUERIES)]


def _row_steps(n: int, tiles: list[slice]) -> list[slice]:
    step = max(1, STEP_CELLS // max((t.stop - t.start for t in tiles), default=1))
    return [slice(at, at + step) for at in range(0, n, step)]


def tiles(n: int, width: int) -> list[slice]:
    """Slices of n queries that meet ``width`` rows at once: TILE_CELLS at most."""
    step = max(1, min(STEP_QUERIES, TILE_CELLS // max(width, 1)))
    return [slice(at, at + step) for at in range(0, n, step)]


def dots(matrix: np.ndarray, rows: np.ndarray, queries: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Inner products of pairs (places of a row and of a query), STEP_BYTES of vectors at a time."""
    out = np.empty(len(rows), dtype=queries.dtype)
    step = max(1, STEP_BYTES // (8 * matrix.shape[1]))
    for at in range(0, len(rows), step):
        own = slice(at, at + step)
        out[own] = np.einsum("nd,nd->n", matrix.take(rows[own], axis=0).astype(queries.dtype, copy=False), queries.take(asked[own], axis=0))
    return out


class _Near:
    """All pairs at or above the least score."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, least: float):
        self.ids, self.matrix, self.least = ids, matrix.astype(np.float64), least
        self.tiles = _tiles(len(ids))

    def add(self, own: np.ndarray, rows: np.ndarray):
        for step in _row_steps(len(own), self.tiles):
            part = rows[step].astype(np.float64)
            for some in self.tiles:
                score = self.matrix[some] @ part.T
                q, v = np.nonzero(score >= self.least)
                if len(q):
                    yield _pairs(self.ids[some][q], own[step][v], score[q, v])

    def end(self):
        return ()


def with_records(hits: DataFrame, records: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """Hits with their records, hits without one gone; with ``on_disk`` (path), those whose file is gone too.

    A page counts as there when its document is.  Hits that were cut at k carry that limit in their plan, so the planner
    broadcasts them when they are few and exchanges them otherwise.
    """
    out = records.join(hits, "vector_id")
    if on_disk is not None:
        out = out.withColumn("__file", F.coalesce("parent_document", "file_path"))
        out = out.join(on_disk.select(F.col("path").alias("__file")), "__file", "left_semi").drop("__file")
    return out


def exclude(vectors: DataFrame, query: Sequence[float], negatives: Sequence[Sequence[float]], threshold: float = 0.3, k: int = TOP_K) -> DataFrame:
    """vector_id, score, rank: of min(3k, MOST_K) candidates those whose inner product with every negative is below the
    threshold, the best k."""
    if not negatives:
        return flat_topk(vectors, query, k)
    near = [V.dot(F.col("embedding"), V.literal(n)) >= threshold for n in negatives]
    bad = near[0]
    for test in near[1:]:
        bad = bad | test
    scored = vectors.where("embedding is not null").select("vector_id", V.dot(F.col("embedding"), V.literal(query)).alias("score"), "embedding")
    candidates = scored.orderBy(F.desc("score"), "vector_id").limit(min(3 * k, MOST_K))
    return ranked(candidates.where(~bad).select("vector_id", "score"), k)


def exclude_batch(vectors: DataFrame, queries: DataFrame, negatives: DataFrame, threshold: float = 0.3, k: int = TOP_K) -> DataFrame:
    """query_id, vector_id, score, rank: as ``exclude`` for every row of queries (query_id, embedding), each with the negatives of its own in
    a table (query_id, embedding), any number of them.

    An anti join by inner products: a query's candidates meet its negatives in matrix products, a block of negatives at a time, and
    those that any block finds near go."""
    candidates = batch_topk(vectors, queries, min(3 * k, MOST_K)).drop("rank")
    held = vectors.where("embedding is not null").select("vector_id", "embedding").join(candidates.select("query_id", "vector_id"), "vector_id")
    unwanted = negatives.where("embedding is not null").select("query_id", "embedding").distinct()
    dims = F.greatest(F.max(F.size("embedding")), F.lit(1))
    blocks = unwanted.groupBy("query_id").agg(F.ceil(F.count("*") * dims * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = unwanted.join(blocks, "query_id").withColumn("block", F.pmod(F.xxhash64("embedding"), F.col("blocks")).cast("int"))
    met = held.join(blocks, "query_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*[F.col(c).alias(c) for c in ("query_id", "vector_id", "embedding", "block")])  # columns of its own: both sides have those of blocks

    def near(key, unwanted: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if unwanted.num_rows and held.num_rows:
            (_, bad), (ids, rows) = _matrix(unwanted.select(["query_id", "embedding"]).combine_chunks()), _matrix(held.select(["vector_id", "embedding"]).combine_chunks())
            out = ids[((bad.astype(np.float64) @ rows.astype(np.float64).T) >= threshold).any(axis=0)]
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(out), pa.int64()), "vector_id": pa.array(out, pa.int64())})

    gone = dealt.groupBy("query_id", "block").cogroup(met.groupBy("query_id", "block")).applyInArrow(near, "query_id long, vector_id long")
    return best_of(candidates.join(gone.distinct(), ["query_id", "vector_id"], "left_anti"), k)


def merge_indexes(results: Sequence[DataFrame], k: int = TOP_K, normalise: bool = True) -> DataFrame:
    """Result sets (file_path, score, others) of several indexes: scores scaled to 0..1 within each, the higher one kept
    for a path (the earlier set on ties), the best k."""
    tagged = [r.drop("rank").withColumn("__set", F.lit(i)) for i, r in enumerate(results)]
    rows = tagged[0]
    for r in tagged[1:]:
        rows = rows.unionByName(r)
    if normalise:
        own = Window.partitionBy("__set")
        low, high = F.min("score").over(own), F.max("score").over(own)
        rows = rows.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "__set", "vector_id"))
    return ranked(rows.withColumn("__place", place).where("__place = 1").drop("__place", "__set"), k, "file_path")


