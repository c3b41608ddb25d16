"""How filters interact: what each removes in every order in which they can be applied.

Every document gets the set of filters it fails as a bit mask.  Documents are counted by part and mask, all of them and those with
each label; a part's counts are one array of 32.  The subset-zeta transform of it (a sum for each bit in turn) holds at U how many documents fail
filters of U alone, so those that survive the filters F are at the complement of F.  What a step removes is the difference of two neighbouring
subsets, and a filter's sum over all orders weighs each such difference by the number of orders that pass it.

Equal texts meet by their SHA-256 in a hash aggregate that keeps the smallest id, so a large group of copies is added up before it is
exchanged; documents find out by (digest, id) whether they are that one, a key that no group of copies shares.  Rows without an id are
spread by their text.

Defined results: a null text is an empty one, a null source the part of the empty string.  A row without an id never fails E and makes
no other row fail; rows that share the smallest id of their text all pass.  A document has a label if any row of ``labels`` for its id says 1; documents without
labels, or with null ones, count in no label.  Empty tables give no rows; very long texts are taken whole; other columns aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SPACES = r"[\x20\x09-\x0D]+"


def failures(text: Column, words: Column) -> list[Column]:
    """A to D of a text without nulls: few words, few distinct ones, many capitals, a symbol."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return [n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_PERCENT * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask, n, digest: how many rows of an id, a part and a text there are, and what they fail.  Texts are read once; what is
    left of them (some 60 bytes a document) is stored, as it is read twice."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    own = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("text"), F.col("words")))), F.lit(0))
    counted = rows.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")).groupBy("digest", "doc_id", "part", "own").agg(F.count("*").alias("n"))
    counted = stored(counted, "failures")
    first = counted.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return counted.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"), "n", "digest")


def mask_counts(judged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, and an array of 32 counts by mask of all documents, of the good and of the toxic ones."""
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null and (good or toxic)")
    marked = marked.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    rows = judged.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)).join(marked, ["doc_id", "spread"], "left")
    counts = rows.groupBy("part", "mask").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))])
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("all", "good", "toxic").alias("c")))).alias("held"))
    places = f"sequence(0, {(1 << len(FILTERS)) - 1})"
    return held.select("part", *[F.expr(f"transform({places}, m -> coalesce(try_element_at(held, m).{k}, 0L))").alias(k) for k in ("all", "good", "toxic")])


def zeta(counts: str) -> Column:
    """SQL for the sums over all subsets of each mask, bit by bit."""
    bits = ", ".join(str(1 << i) for i in range(len(FILTERS)))
    return F.expr(f"aggregate(array({bits}), {counts}, (z, b) -> transform(z, (v, i) -> if((i & b) > 0, v + z[i - b], v)))")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = mask_counts(masks(docs, id_col, text_col, part_col), labels, id_col)
    k, full = len(FILTERS), (1 << len(FILTERS)) - 1
    below = counts.select("part", "all", *[zeta(f"`{c}`").alias(f"z_{c}") for c in ("all", "good", "toxic")])
    removed = lambda z, before, bit: f"{z}[{full} - ({before})] - {z}[{full} - ({before}) - ({bit})]"
    # a subset of s filters without this one lies before it in s! (k - 1 - s)! orders
    weights = ", ".join(f"{factorial(s) * factorial(k - 1 - s)}L" for s in range(k))
    shapley = f"""transform(sequence(0, {k - 1}), f -> aggregate(filter(sequence(0, {full}), m -> (m & shiftleft(1, f)) = 0), 0L,
      (a, m) -> a + array({weights})[bit_count(m)] * ({removed('z_all', 'm', 'shiftleft(1, f)')})))"""
    orders = "array(" + ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS)) + ")"
    each = below.withColumn("sums", F.expr(shapley)).withColumn("filter_order", F.explode(F.expr(orders)))
    each = each.withColumn("bits", F.expr(f"transform(sequence(1, {k}), s -> shiftleft(1, ascii(substring(filter_order, s, 1)) - ascii('{FILTERS[0]}')))"))
    each = each.select("*", F.posexplode("bits").alias("place", "bit")).withColumn("before", F.expr("aggregate(slice(bits, 1, place), 0, (a, b) -> a | b)"))
    gone = {c: F.expr(removed(f"z_{c}", "before", "bit")) for c in ("all", "good", "toxic")}
    failing = F.expr(removed("z_all", "0", "bit"))
    return each.select(
        "part", "filter_order", (F.col("place") + 1).alias("step"), F.expr(f"z_all[{full} - before - bit]").alias("kept"), gone["all"].alias("removed"), (failing - gone["all"]).alias("redundant"),
        F.expr("`all`[bit]").alias("unique_fails"), gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), F.expr(f"sums[ascii(substring(filter_order, place + 1, 1)) - ascii('{FILTERS[0]}')]").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE = {
    "op13_filter_audit": r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from d),
m as (select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask from w),
g as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m left join g using (doc_id) group by part, mask),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
o as (select a.l || b.l || c.l || d.l || e.l as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s as (select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::int as before
  from (select filter_order, unnest(range(1, 6))::int as step from o)),
r as (select part, filter_order, step, bit,
  sum(n) filter (where mask & (before | bit) = 0) as kept, sum(n) filter (where mask & before = 0 and mask & bit > 0) as removed, sum(n) filter (where mask & before > 0 and mask & bit > 0) as redundant,
  sum(n) filter (where mask = bit) as unique_fails, sum(good) filter (where mask & before = 0 and mask & bit > 0) as good_lost, sum(toxic) filter (where mask & before = 0 and mask & bit > 0) as toxic_lost
  from c, s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley from r"""
}
