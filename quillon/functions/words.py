"""Text expressions: instructions, term lists, hashed text vectors."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..schema import INDEX_TYPES

MOST_WORDS = 1 << 17


def instruction(text: Column, default: str) -> Column:
    """Blank gives the default; a full stop is added unless the last character is punctuation."""
    said = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(default)).otherwise(F.trim(text))
    return F.when(said.rlike(r"\p{P}$"), said).otherwise(F.concat(said, F.lit(".")))


def terms(text: Column) -> Column:
    """Comma-separated terms, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def index_type(name: str) -> str:
    return INDEX_TYPES.get(name.lower().replace("-", "_"), "flat")


def kept_tokens(tokens: Column, special: Column, most: int, tail: int = 5) -> Column:
    """All special tokens, the first ``most`` others, and the last ``tail`` tokens."""
    n = F.size(tokens)
    plain = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~F.get(special, i))
    last = F.coalesce(F.get(plain, F.lit(most - 1)), n) if most > 0 else F.lit(-1)  # the place of the last plain token that stays
    pairs = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), (F.get(special, i) | (i >= n - tail) | (i <= last)).alias("keep")))
    return F.transform(F.filter(pairs, lambda p: p.keep), lambda p: p.t)


def conversation(text: Column, image: Column, video: Column, prompt: Column) -> Column:
    """Content parts of a model input: video before image, then text; a placeholder where there is nothing."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    media = F.when(video.isNotNull(), F.array(part("video", video))).when(image.isNotNull(), F.array(part("image", image))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    words = F.when(text.isNotNull(), F.array(part("text", text))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    parts = F.concat(media, words)
    return F.struct(prompt.alias("instruction"), F.when(F.size(parts) > 0, parts).otherwise(F.array(part("text", F.lit("NULL")))).alias("content"))


def local_uri(path: Column) -> Column:
    """A path without a web scheme is a local file."""
    return F.when(path.rlike("^(http|oss)"), path).otherwise(F.concat(F.lit("file://"), path))


def pair_parts(prefix: str, text: Column, image: Column, video: Column) -> Column:
    """One side of a pair to be judged: its prefix, then video, image and text where they are there, else a placeholder."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    there = lambda x: F.coalesce(x, F.lit("")) != ""
    own = [F.when(there(v), part(k, local_uri(v) if k != "text" else v)) for k, v in (("video", video), ("image", image), ("text", text))]
    found = F.array_compact(F.array(*own))
    return F.concat(F.array(part("text", F.lit(prefix))), F.when(F.size(found) > 0, found).otherwise(F.array(part("text", F.lit("NULL")))))


def rerank_pair(instruct: Column, query: tuple[Column, Column, Column], document: tuple[Column, Column, Column]) -> Column:
    """The parts that a pair scorer reads: instruction, query and document (each text, image, video)."""
    told = F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("<Instruct>: "), instruct).alias("value")))
    return F.concat(told, pair_parts("<Query>:", *query), pair_parts("\n<Document>:", *document))


class _Buckets(dict):
    """The hash bucket of each word that a task has met, MOST_WORDS of them at a time."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % self.dims
        return found


def hashed_counts(texts: DataFrame, id_col: str, text_col: str = "text", dims: int = 64, keep: Sequence[str] = ()) -> DataFrame:
    """id, n (array<long>), kept: word counts by hash bucket over all texts of an id with a word.  A text is counted in one pass where it
    lies; only counts are exchanged."""
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.struct(F.lit(0).alias("__"), *keep).alias("kept"), F.lower(text_col).alias("n"))
    kind = StructType([*rows.schema.fields[:2], StructField("n", ArrayType(LongType()))])

    def count(batches):
        find, buckets = re.compile("[a-z0-9]+").findall, _Buckets(dims)
        for batch in batches:
            lines, out = [], []
            for i, text in enumerate(batch.column(2)):
                words = find(text.as_py())
                if words:
                    lines.append(i)
                    out.append(np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=dims))
            if out:
                flat = pa.array(np.concatenate(out))
                counts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), flat)
                own = pa.array(lines)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), counts], names=[id_col, "kept", "n"])

    each = rows.mapInArrow(count, kind).groupBy(id_col).agg(F.collect_list("n").alias("all"), F.first("kept").alias("kept"))
    several = F.aggregate("all", F.array_repeat(F.lit(0).cast("long"), dims), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return each.select(id_col, F.when(F.size("all") == 1, F.col("all")[0]).otherwise(several).alias("n"), "kept")


def _square(n: Column) -> Column:
    return F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x * x)


def hashed_text(texts: DataFrame, id_col: str, text_col: str = "text", dims: int = 64) -> DataFrame:
    """id, bucket, weight: word counts by hash bucket at unit length (rows for buckets that occur)."""
    counts = hashed_counts(texts, id_col, text_col, dims).select(id_col, F.sqrt(_square(F.col("n"))).alias("size"), F.posexplode("n").alias("bucket", "n"))
    return counts.where("n > 0").select(id_col, F.col("bucket").cast("long").alias("bucket"), (F.col("n") / F.col("size")).alias("weight"))


def hashed_cosine(counts: DataFrame, asked: DataFrame) -> Column:
    """The cosine of column n with the counts of the one row asked: from whole numbers, so that equal texts have equal scores.  None: no row."""
    row = asked.select("n").first()
    if row is None:
        return F.lit(None).cast("double")
    dot = F.aggregate(F.zip_with("n", F.array(*[F.lit(x).cast("long") for x in row.n]), lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(dot > 0, dot / (F.sqrt(_square(F.col("n"))) * math.sqrt(sum(x * x for x in row.n))))


def hashed_vectors(texts: DataFrame, id_col: str, text_col: str = "text", dims: int = 64, kind: str = "float", keep: Sequence[str] = ()) -> DataFrame:
    """id, embedding: the same as dense arrays of float or double.  Columns to keep go along, those of one row for each id."""
    rows = hashed_counts(texts, id_col, text_col, dims, keep)
    return rows.select(id_col, unit_counts(kind).alias("embedding"), *[F.col("kept").getField(c).alias(c) for c in keep])


def unit_counts(kind: str = "float") -> Column:
    """Counts (column n) at unit length."""
    size = F.sqrt(_square(F.col("n")))
    return F.transform("n", lambda x: (x / size).cast(kind))
