"""Operators on result sets: rows with file_path, score, vector_id, media_type and a rank from 1."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions import words
from ..schema import KINDS, RERANK_INSTRUCTION
from .search import ranked


def of_kind(results: DataFrame, kind: str = "all") -> DataFrame:
    return results.where(F.col("media_type").isin(KINDS.get(kind, KINDS["all"])))


def above(results: DataFrame, least: float = 0.0) -> DataFrame:
    """The search filter: no filter at 0 or below, so negative scores pass then."""
    return results.where(F.col("score") >= least) if least > 0 else results


def filter_by_score(results: DataFrame, least: float = 0.1, most: int = 100) -> DataFrame:
    """Always filters, keeps the order, cuts."""
    return reranked(results.where(F.col("score") >= least).orderBy("rank").limit(most))


def reranked(results: DataFrame, *order) -> DataFrame:
    """Ranks from 1 in the order that stands (result sets are short)."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*(order or ("rank",)))))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)), allowMissingColumns=True)


def union(a: DataFrame, b: DataFrame, most: int = 100) -> DataFrame:
    """One row a path, the higher score; ties go to the row seen first."""
    seen = [F.col("__side"), F.col("rank")]
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), *seen))
    first = F.min(F.struct("__side", "rank")).over(Window.partitionBy("file_path"))
    kept = _both(a, b).withColumn("__first", first).withColumn("__place", place).where("__place = 1")
    order = [F.desc("score"), F.col("__first"), F.col("file_path")]
    return reranked(kept.orderBy(*order).limit(most), *order).drop("__side", "__place", "__first")


def intersection(a: DataFrame, b: DataFrame, most: int = 100) -> DataFrame:
    """Paths in both with the mean score; the other columns come from the first set.  Of a path twice in one set the last counts."""
    last = lambda df: df.withColumn("__place", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("rank")))).where("__place = 1").drop("__place", "rank")
    other = last(b).select("file_path", F.col("score").alias("__score"))
    joined = last(a).join(other, "file_path").withColumn("score", (F.col("score") + F.col("__score")) / 2).drop("__score")
    return ranked(joined, most, "file_path")


def concat(a: DataFrame, b: DataFrame, most: int = 100) -> DataFrame:
    """The first set, then the second."""
    rows = _both(a, b)
    return reranked(rows.orderBy("__side", "rank").limit(most), "__side", "rank").drop("__side")


def rerank(results: DataFrame, score: Column, k: int = 10, least: float = 0.0) -> DataFrame:
    """New scores (null: 0), those at the least or above, the best k; ties in the order before."""
    scored = results.withColumn("score", F.coalesce(score, F.lit(0.0))).where(F.col("score") >= least)
    order = [F.desc("score"), F.col("rank")]
    return reranked(scored.orderBy(*order).limit(k), *order)


def rerank_by_vector(results: DataFrame, vectors: DataFrame, query, k: int = 10, least: float = 0.0, scale: float = 10.0) -> DataFrame:
    """Second stage by the full vectors: sigmoid of the scaled inner product."""
    full = vectors.select("vector_id", F.col("embedding").alias("__full"))
    joined = full.join(results, "vector_id")  # a result set has a limit, so the planner sees its size
    return rerank(joined, V.sigmoid(scale * V.dot(F.col("__full"), V.literal(query))), k, least).drop("__full")


def judged_parts(found: DataFrame, text: str | None = None, instruction: str | None = None) -> Column | None:
    """The parts that a judging model reads for each result (its thumbnail), against another text or against what was searched, a
    text or a picture; None where there is nothing to judge against.  ``found`` is a tagged result set."""
    none = F.lit(None).cast("string")
    if (text or "").strip():
        query = F.lit(text), none, none
    else:
        row = found.select("query_type", "query_info").first()
        if row is None or not row.query_info or row.query_type not in ("text", "image"):
            return None
        query = (F.lit(row.query_info), none, none) if row.query_type == "text" else (none, F.lit(row.query_info), none)
    asked = F.lit(instruction if (instruction or "").strip() else RERANK_INSTRUCTION)
    return words.rerank_pair(asked, query, (none, F.col("thumbnail_path"), none))


def rerank_by_model(found: DataFrame, make: Callable[[], Callable[[list], list[float]]], text: str | None = None, k: int = 10, least: float = 0.0, instruction: str | None = None) -> DataFrame:
    """Second stage by a judging model, run by the executors: ``make()`` gives a function from lists of parts to scores.  A result set
    without a text or picture to judge against passes through unchanged."""
    parts = judged_parts(found, text, instruction)
    if parts is None:
        return found

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series([float(x) for x in model([list(p) for p in batch])])

    # not deterministic to the planner, so that a filter on the score doesn't ask the model again
    return rerank(found, F.pandas_udf(judge, "double").asNondeterministic()(parts), k, least)


def paths(results: DataFrame, most: int = 50, with_scores: bool = False) -> DataFrame:
    """One row: the paths in order, comma- and newline-separated."""
    line = F.format_string("%s\t%.4f", "file_path", "score") if with_scores else F.col("file_path")
    held = results.where(F.col("rank") <= most).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return held.select(F.array_join("l.line", ", ").alias("comma_text"), F.array_join("l.line", "\n").alias("line_text"))


def preview(results: DataFrame, columns: int = 5, size: int = 256, most: int = 25) -> DataFrame:
    """Where each result goes in a grid of pictures, and its label."""
    i = F.col("rank") - 1
    return results.where(F.col("rank") <= most).select(
        "rank", "file_path", (i % columns * size).cast("int").alias("x"), (F.floor(i / columns) * size).cast("int").alias("y"), F.format_string("%.3f", "score").alias("label")
    )


def padded_size(pictures: DataFrame) -> DataFrame:
    """pictures (width, height) with the common size that a batch is padded to."""
    whole = Window.partitionBy()
    return pictures.withColumn("pad_width", F.max("width").over(whole)).withColumn("pad_height", F.max("height").over(whole))


def tagged(results: DataFrame, query_type: str, query_info: str) -> DataFrame:
    """Results with what they answer: query_type, query_info."""
    return results.withColumn("query_type", F.lit(query_type)).withColumn("query_info", F.lit(query_info))


def combined(a: DataFrame, b: DataFrame, how: str = "union", most: int = 100) -> DataFrame:
    """Two tagged result sets as one, tagged ``combined`` with both infos."""
    info = F.concat(F.coalesce(a.agg(F.first("query_info")).scalar(), F.lit("")), F.lit(" + "), F.coalesce(b.agg(F.first("query_info")).scalar(), F.lit("")))
    rows = {"union": union, "intersection": intersection, "concat": concat}[how](a.drop("query_type", "query_info"), b.drop("query_type", "query_info"), most)
    return rows.withColumn("query_type", F.lit("combined")).withColumn("query_info", info)


def as_json(results: DataFrame) -> DataFrame:
    """rank and each result as a JSON object."""
    return results.select("rank", F.to_json(F.struct("file_path", "thumbnail_path", "score", "vector_id", "media_type")).alias("json"))
