"""Vector expressions over array<float> columns.  Elements are widened to double before they are multiplied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def truncate(v: Column, dims: int) -> Column:
    """The first dims, at unit length."""
    return normalize(F.slice(v, 1, dims))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def nearest_dim(want: int, known: Sequence[int]) -> int:
    return min(known, key=lambda d: (abs(d - want), d))


def last_unmasked(states: Column, mask: Column) -> Column:
    """The state at the last place whose mask is 1."""
    at = F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i + 1).otherwise(0)))
    return F.when(at > 0, F.get(states, at - 1))


def mean_vector(rows: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """keys, pos, mean: element-wise averages (hash aggregate with map-side sums)."""
    return rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def chunked_mean(frames: DataFrame, key: str, size: int = 8, order: str = "pos", vector: str = "embedding") -> DataFrame:
    """key, embedding: the mean of each chunk of frames at unit length, averaged again at unit length."""
    chunked = frames.withColumn("chunk", F.floor(F.col(order) / size))
    def joined(df, keys):
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("m")).select(*keys, normalize(F.col("m.mean")).alias("embedding"))
    parts = joined(mean_vector(chunked, [key, "chunk"], vector), [key, "chunk"])
    return joined(mean_vector(parts, [key]), [key])


def register(spark: SparkSession) -> None:
    """SQL function dot_ip(a, b)."""
    spark.sql(
        "create or replace temporary function dot_ip(a array<float>, b array<float>) returns double "
        "return aggregate(zip_with(a, b, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"
    )
