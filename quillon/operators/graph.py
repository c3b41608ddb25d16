"""A nearest-neighbour graph of vectors, built and searched in parts.

Spark deals the vectors into parts by their hashed ids, ``GRAPH_ROWS`` of them and ``search.PART_BYTES`` at most, and a part is a graph of its
own: every vector's ``k`` nearest within the part, by matrix products of bounded size, and of those that point at it its ``k`` nearest, so a hub has
no more edges than twice another.  Building compares a vector with the rows of its part, so it grows as the rows; NN-descent by joins
(``rounds``) is there for callers that ask for it.  A search sends each block of queries to each
part and walks there: the best unseen vectors of a query's beam are opened, the neighbours that are new to it are scored, until the beam holds none that is
unopened.  The best of all parts are merged.  A part's edges and vectors are exchanged once for each block of queries, and a pair that is scored never is:
what leaves a task is the best ``k`` of a query.

A walk scores a few hundredths of a large part, but it visits every part, so work grows as the rows do, as with exact search, at a fraction of its products.
Copies of a vector are dealt out like others; more than ``k`` copies within a part may be neighbours of each other alone, and a walk finds other vectors
from its other entries.  A vector that is null is in no graph.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TOP_K
from ..sources.scratch import Scratch
from .ann import ASKED, RECALL, by_batch, sampled
from .search import BLOCK_BYTES, SAME, SCORED, batch_topk, best_of, dots, part_rows, tiles

NEIGHBOURS, GRAPH_ROWS = 16, 25_000
CELL_ROWS, TREES, SETTLED = 128, 4, 0.01
BEAM, WIDTH, ENTRIES = 64, 16, 512
MOST_OPENED = 2 << 20
EDGES = "src long, dst long, score double"


def _shape(vectors: DataFrame) -> tuple[int, int, int]:
    """How many dimensions, rows and parts; these follow from the table, so a search finds those of the build."""
    rows, dims = vectors.where("embedding is not null").agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    return dims, rows, max(1, math.ceil(rows / min(GRAPH_ROWS, part_rows(dims))))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("vector_id"), F.lit(parts)).cast("int")


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def nearest(edges: DataFrame, k: int, by: str = "src", other: str = "dst") -> DataFrame:
    """The k best edges of each vector."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), other))
    return edges.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def _within(ids: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the places of the k others with the largest inner products."""
    n, k = len(ids), min(k, len(ids) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    best, found = np.empty((n, k), dtype=np.int64), np.empty((n, k))
    for some in tiles(n, n):
        score = matrix[some] @ matrix.T
        score[ids[some, None] == ids] = -np.inf
        best[some] = np.argpartition(score, n - k, axis=1)[:, n - k :]
        found[some] = np.take_along_axis(score, best[some], 1)
    fine = np.isfinite(found).ravel()
    return np.repeat(np.arange(n), k)[fine], best.ravel()[fine], found.ravel()[fine]


def _edges(ids: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's edges: to the k nearest, and back from each vector to the k nearest of those that point at it."""
    src, dst, score = _within(ids, matrix, k)
    order = np.lexsort((ids[src], -score, dst))
    back = order[np.arange(len(order)) - np.searchsorted(dst[order], dst[order]) < k]
    src, dst, score = np.concatenate([src, dst[back]]), np.concatenate([dst, src[back]]), np.concatenate([score, score[back]])
    once = np.unique(src * len(ids) + dst, return_index=True)[1]
    return ids[src[once]], ids[dst[once]], score[once]


def first_edges(vectors: DataFrame, dims: int, rows: int, parts: int, k: int, seed: int) -> DataFrame:
    """Neighbours within cells of about CELL_ROWS vectors of a part: the signs of random projections, cut further by a hash where a cell is large."""
    bits = max(0, math.ceil(math.log2(max(rows / parts, 1) / CELL_ROWS)))
    planes = np.random.default_rng(seed).normal(size=(TREES, bits, dims))

    def codes(matrix: np.ndarray) -> list[pa.Array]:
        signs = np.einsum("tbd,nd->ntb", planes, matrix) >= 0
        return [pa.array(list((signs << np.arange(bits)).sum(axis=2).astype(np.int64)), pa.list_(pa.int64()))]

    each = by_batch(vectors, "codes array<long>", codes).select("vector_id", "embedding", F.posexplode("codes").alias("tree", "code")).withColumn("owner", _part(parts))
    sizes = each.groupBy("owner", "tree", "code").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    cells = each.join(sizes, ["owner", "tree", "code"]).withColumn("part", F.pmod(F.xxhash64("vector_id", "tree"), F.col("parts")).cast("int"))

    def cell(rows: pa.Table) -> pa.Table:
        ids = rows["vector_id"].to_numpy()
        src, dst, score = _within(ids, _floats(rows["embedding"]), k)
        return pa.table({"src": pa.array(ids[src]), "dst": pa.array(ids[dst]), "score": pa.array(score)})

    found = cells.select("owner", "tree", "code", "part", "vector_id", "embedding").groupBy("owner", "tree", "code", "part").applyInArrow(cell, EDGES)
    return nearest(found.groupBy("src", "dst").agg(F.max("score").alias("score")), k)


def introduced(edges: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Edges between the neighbours of each vector: the best k of each within them."""
    back = nearest(edges, 2 * k, "dst", "src")
    known = edges.select(F.col("src").alias("pivot"), F.col("dst").alias("vector_id")).union(back.select("dst", "src")).union(edges.select("src", "src")).distinct()
    groups = known.join(vectors, "vector_id").groupBy("pivot").agg(F.collect_list("vector_id").alias("ids"), F.collect_list("embedding").alias("rows"))

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            ids, rows = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                own = ids[i].values.to_numpy()
                matrix = rows[i].values.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(own), -1)
                src, dst, score = _within(own, matrix, k)
                for column, part in zip(out, (own[src], own[dst], score), strict=True):
                    column.append(part)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["src", "dst", "score"])

    return groups.select("ids", "rows").mapInArrow(run, EDGES)


def build(vectors: DataFrame, scratch: Scratch, k: int = NEIGHBOURS, rounds: int | None = None, seed: int = 7) -> DataFrame:
    """src, dst, score: the k nearest of every vector (vector_id, embedding; ids are unique) within its part, and of those that point at it.

    Without ``rounds`` neighbours are exact; with them they are what so many rounds of NN-descent find."""
    vectors = vectors.where("embedding is not null").select("vector_id", "embedding")
    dims, rows, parts = _shape(vectors)
    if rounds is not None:
        return _descended(vectors, scratch, dims, rows, parts, k, rounds, seed)

    def one(rows: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("src", "dst", "score"), map(pa.array, _edges(rows["vector_id"].to_numpy(), _floats(rows["embedding"]), k)), strict=True)))

    return scratch.saved(vectors.withColumn("part", _part(parts)).groupBy("part").applyInArrow(one, EDGES))


def _descended(vectors: DataFrame, scratch: Scratch, dims: int, rows: int, parts: int, k: int, rounds: int, seed: int) -> DataFrame:
    """A first graph from cells, then rounds in which the neighbours of every vector, forward and backward, are made known to each other;
    it ends when few edges change."""
    edges = scratch.saved(first_edges(vectors, dims, rows, parts, k, seed))
    for _ in range(rounds):
        both = edges.unionByName(introduced(edges, vectors, k))
        better = scratch.saved(nearest(both.groupBy("src", "dst").agg(F.max("score").alias("score")), k))
        changed = better.join(edges, ["src", "dst"], "left_anti").count()
        edges = better
        if changed <= SETTLED * max(1, rows) * k:
            break
    back = nearest(edges, k, "dst", "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")
    return scratch.saved(edges.unionByName(back).distinct())


class _Cell:
    """A part: its rows by id, their vectors, the places of their neighbours, and where walks begin."""

    def __init__(self, rows: pa.Table, entries: int):
        ids = rows["vector_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], _floats(rows["embedding"])[order]
        n, near = len(ids), rows["near"].combine_chunks().take(pa.array(order))
        src, dst = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False)), near.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.ids, dst), n - 1)
        known = self.ids[at] == dst
        src, at = src[known], at[known]
        sizes = np.bincount(src, minlength=n)
        self.near = np.full((n, max(1, sizes.max())), n, dtype=np.int32)  # n: no neighbour
        self.near[src, np.arange(len(src)) - (np.cumsum(sizes) - sizes)[src]] = at
        self.entries = np.sort(np.random.default_rng(7).permutation(n)[:entries])

    def walk(self, queries: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the best that each query finds, ``beam`` at most, n for none; and which rows were scored for it."""
        n, t = len(self.ids), len(queries)
        seen, first = np.zeros(t * (n + 1), dtype=bool), np.empty(t * (n + 1), dtype=np.int32)
        marks = seen.reshape(t, n + 1)
        marks[:, n] = marks[:, self.entries] = True
        best = np.tile(self.entries.astype(np.int32), (t, 1))
        score = queries @ self.matrix[self.entries].T
        best, score, fresh = _cut(beam, best, score, np.ones(best.shape, dtype=bool))
        width = max(1, min(width, MOST_OPENED // (t * self.near.shape[1])))
        while True:
            q, at = np.nonzero(fresh & (np.cumsum(fresh, axis=1) <= width))
            if not len(q):
                return best, marks[:, :n]
            fresh[q, at] = False
            met = ((q * (n + 1))[:, None] + self.near.take(best[q, at], axis=0)).ravel()
            met = met[~seen.take(met)]
            turn = np.arange(len(met), dtype=np.int32)
            first[met] = turn
            met = met[first.take(met) == turn]  # a row once, whoever its neighbours are
            seen[met] = True
            q, v = np.divmod(met, n + 1)
            found = dots(self.matrix, v, queries, q)
            if score.shape[1] >= beam:
                better = found > score[q, beam - 1]
                q, v, found = q[better], v[better], found[better]
            if len(q):
                place = np.arange(len(q)) - np.searchsorted(q, q)
                shape = t, place.max() + 1
                more, scores, opened = np.full(shape, n, dtype=np.int32), np.full(shape, -np.inf, dtype=score.dtype), np.zeros(shape, dtype=bool)
                more[q, place], scores[q, place], opened[q, place] = v, found, True
                best, score, fresh = _cut(beam, np.concatenate([best, more], axis=1), np.concatenate([score, scores], axis=1), np.concatenate([fresh, opened], axis=1))

    def scored(self, queries: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return dots(self.matrix, v, queries.astype(np.float64), q)


def _cut(beam: int, best: np.ndarray, score: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1), np.take_along_axis(fresh, order, 1)


def _opened(beam: int) -> int:
    """A wider beam opens more at a time."""
    return max(WIDTH, beam * WIDTH // BEAM)


def _met(edges: DataFrame, vectors: DataFrame, queries: DataFrame, schema: str, work: Callable) -> DataFrame:
    """What ``work(cell, query ids, their vectors)`` yields (arrays of the schema's columns) for each tile of queries in each part."""
    vectors = vectors.where("embedding is not null").select("vector_id", "embedding")
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    (dims, _, parts), entries, names = _shape(vectors), ENTRIES, [c.split()[0] for c in schema.split(", ")]
    blocks = max(1, math.ceil(asked.count() * dims * 8 / BLOCK_BYTES))
    near = edges.groupBy(F.col("src").alias("vector_id")).agg(F.collect_list("dst").alias("near"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.join(near, "vector_id", "left").withColumn("part", _part(parts)).withColumn("block", each(blocks))
    sent = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    sent = sent.select(*[F.col(c).alias(c) for c in sent.columns])  # columns of its own: queries may be rows of the vectors

    def one(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in names]
        if asked.num_rows and rows.num_rows:
            cell, ids, matrix = _Cell(rows, entries), asked["query_id"].to_numpy(), _floats(asked["embedding"])
            for some in tiles(len(ids), len(cell.ids)):
                for column, part in zip(out, work(cell, ids[some], matrix[some]), strict=True):
                    column.append(part)
        return pa.table({c: pa.array(np.concatenate(o) if o else []) for c, o in zip(names, out, strict=True)}).cast(kind)

    kind = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in schema.split(", ")])
    return sent.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(one, schema)


def walk(edges: DataFrame, vectors: DataFrame, queries: DataFrame, scratch: Scratch, beam: int = BEAM) -> DataFrame:
    """query_id, vector_id, score of all that was scored for each query (query_id, embedding)."""
    width = _opened(beam)

    def work(cell: _Cell, ids: np.ndarray, matrix: np.ndarray):
        q, v = np.nonzero(cell.walk(matrix, beam, width)[1])
        return ids[q], cell.ids[v], cell.scored(matrix, q, v)

    return _met(edges, vectors, queries, SCORED, work)


def _pairs(cell: _Cell, matrix: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of what their walks found, with the scores: by query, from the best on, ties by id."""
    best = cell.walk(matrix, beam, width)[0]
    q, at = np.nonzero(best < len(cell.ids))
    v = best[q, at]
    score = cell.scored(matrix, q, v)
    order = np.lexsort((v, -score, q))
    return q[order], v[order], score[order]


def fitted(edges: DataFrame, vectors: DataFrame, scratch: Scratch, k: int = TOP_K) -> int:
    """The least beam, doubled from BEAM, with which walks find RECALL of the exact best k of ASKED sampled vectors: it grows with the table.

    One job: a part tries beam after beam until it finds all that it holds of the answers.  A row counts by its score, so those that tie with
    the last of the k are as good as it."""
    vectors = vectors.where("embedding is not null").select("vector_id", "embedding")
    asked = scratch.saved(sampled(vectors, ASKED).select(F.col("vector_id").alias("query_id"), "embedding"))
    exact = batch_topk(vectors, asked, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("wanted")).collect()  # ASKED rows
    least, wanted = {r.query_id: r.least - SAME for r in exact}, {r.query_id: r.wanted for r in exact}
    beams = [max(BEAM, k)]
    while beams[-1] < min(vectors.count(), GRAPH_ROWS):
        beams.append(2 * beams[-1])
    tried = [(beam, _opened(beam)) for beam in beams]

    def work(cell: _Cell, ids: np.ndarray, matrix: np.ndarray):
        bound = np.array([least[i] for i in ids.tolist()])
        whole = np.minimum(k, (matrix.astype(np.float64) @ cell.matrix.T >= bound[:, None]).sum(axis=1))
        out, found = [], np.zeros(len(ids), dtype=np.int64)
        for beam, width in tried:
            if (found < whole).any():
                q, _, score = _pairs(cell, matrix, beam, width)
                found = np.minimum(k, np.bincount(q[score >= bound[q]], minlength=len(ids)))
            out.append((ids, np.full(len(ids), beam), found))
        return (np.concatenate(c) for c in zip(*out, strict=True))

    found = _met(edges, vectors, asked, "query_id long, beam long, found long", work).groupBy("beam", "query_id").agg(F.sum("found").alias("found"))
    held = {beam: 0 for beam in beams}
    for r in found.collect():  # ASKED rows for each beam
        held[r.beam] += min(r.found, wanted[r.query_id])
    return next((beam for beam in beams if held[beam] >= RECALL * sum(wanted.values())), beams[-1])


def search(edges: DataFrame, vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = TOP_K, beam: int = BEAM) -> DataFrame:
    """query_id, vector_id, score, rank: about the best k for every row of queries."""
    beam = max(beam, k)
    width = _opened(beam)

    def work(cell: _Cell, ids: np.ndarray, matrix: np.ndarray):
        q, v, score = _pairs(cell, matrix, beam, width)
        few = np.arange(len(q)) - np.searchsorted(q, q) < k
        return ids[q[few]], cell.ids[v[few]], score[few]

    return best_of(_met(edges, vectors, queries, SCORED, work), k)
