"""N-gram Jaccard join: documents whose sets of word shingles are similar, and the groups that such links form.

1. Every text becomes its set of shingle hashes.  Documents with one and the same set form a class, which stands for
   them from then on; a count sketch of fixed size estimates how many texts hold a shingle.
2. A set is put in a global order, rarest first by the sketch, then by hash (any order is correct, so a coarse estimate costs
   work only).  Two sets as similar as asked for share a shingle in their prefixes of n - ceil(t n) + 1.  Prefix shingles are
   joined; a pair must pass the length filter and the positional filter at the shingle that brings it up.
3. Candidate pairs are made distinct, joined with their sets, tested by the suffix filter (the sets cut at fixed pivots: the sum
   of the smaller parts bounds the overlap) and verified once by their exact overlap.
4. A shingle in the prefixes of more than ``MANY`` classes doesn't bring up all its pairs.  Its members are first paired with
   ``LEADERS`` of them, those whose rarest shingle it is, as the rows stream by.  Pairs that are then in one group need no link of
   their own; all other pairs of the shingle are brought up in a second round, in pairs of blocks of about ``BLOCK`` rows.
5. Groups are the connected components of the links (alternating large-star and small-star steps).

Edge cases: a null, empty or blank text has an empty set and is linked with nothing; fewer words than a shingle make one
shingle of all; rows that repeat, with their ids or without, are judged one by one; a null id never names a group of
others; a text of any length is one set, whose hashes a task holds at once (8 bytes a word); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PARTS, bloom_has, build_bloom, documents, gather_blobs, id_text, lowered, merge_blobs, mix64, prefix_hash, run_hash, signed, slices, span_hash, split_blobs, stored, word_spans

WORDS = 4
PERCENT = 85
SKETCH_BITS = 21
MANY = 32
LEADERS = 4
BLOCK = 20_000
PIVOTS = (np.arange(1, 64, dtype=np.uint64) << np.uint64(58)).astype(np.uint64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, in ascending order, end to end; and where each text's begin."""
    low = lowered(buf)
    starts, ends, first = word_spans(low, offsets)
    words = span_hash(prefix_hash(low), starts, ends)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    grams = run_hash(words, k)
    inside = row[: len(grams)] == row[k - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    row, grams = row[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        alone = [mix64(run_hash(words[first[r] : first[r + 1]], int(counts[r])) + np.uint64(counts[r])) for r in short.tolist()]
        row, grams = np.concatenate([row, short]), np.concatenate([grams, *alone])
    by = np.lexsort((grams, row))
    row, grams = row[by], grams[by]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    row, grams = row[keep], grams[keep]
    return grams, np.searchsorted(row, np.arange(len(counts) + 1))


def class_keys(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for an empty one."""
    sums = np.zeros((2, len(grams) + 1), dtype=np.uint64)
    np.cumsum(mix64(grams), out=sums[0, 1:])
    np.cumsum(mix64(grams ^ np.uint64(0x94D049BB133111EB)), out=sums[1, 1:])
    one, two = (s[begins[1:]] - s[begins[:-1]] for s in sums)
    size = np.diff(begins).astype(np.uint64)
    return np.where(size > 0, mix64(mix64(one + size) ^ two) | np.uint64(1), np.uint64(0))


def _slots(grams: np.ndarray) -> np.ndarray:
    return (mix64(grams) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sets_and_sketch(texts: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """One row per text: doc_id, t, n (size of its set), c (class); and the sketch of how many texts hold a shingle."""

    def read(batches):
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                grams, begins = shingle_sets(buf, offsets, k)
                sketch += np.bincount(_slots(grams), minlength=len(sketch)).astype(np.uint32)
                n = len(begins) - 1
                nothing = pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(begins)), pa.array(signed(class_keys(grams, begins))), *nothing], names=["doc_id", "t", "n", "c", "part", "blob"])
        if sketch.any():
            blobs = split_blobs(sketch)
            nothing = [pa.nulls(blobs.num_rows, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*nothing, *blobs.columns], names=["doc_id", "t", "n", "c", "part", "blob"])

    both = stored(texts.mapInArrow(read, "doc_id long, t long, n long, c long, part int, blob binary"), "sets")
    entries = (1 << SKETCH_BITS) // PARTS
    sketch = gather_blobs(merge_blobs(both.where("part is not null").select("part", "blob"), "add", entries), "add", entries)
    return both.where("part is null").select("doc_id", "t", "n", "c"), sketch


def prefix_rows(texts: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """h, c, n, pos (place of h in the order): the prefixes of all sets, once a class for each task."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def read(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, buf, offsets in slices(batch, "text"):
                grams, begins = shingle_sets(buf, offsets, k)
                keys = class_keys(grams, begins)
                new = np.zeros(len(keys), dtype=bool)
                for r, key in enumerate(keys.tolist()):
                    if key and key not in seen:
                        seen.add(key)
                        new[r] = True
                size = np.diff(begins)
                row = np.repeat(np.arange(len(size)), size)
                keep = new[row]
                row, grams = row[keep], grams[keep]
                by = np.lexsort((grams, shared.value[_slots(grams)], row))
                row, grams = row[by], grams[by]
                kept_begin = np.concatenate([[0], np.cumsum(np.where(new, size, 0))])
                pos = np.arange(len(row)) - kept_begin[row]
                pick = pos < size[row] - (percent * size[row] + 99) // 100 + 1
                row, grams, pos = row[pick], grams[pick], pos[pick]
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams)), pa.array(signed(keys[row])), pa.array(size[row].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["h", "c", "n", "pos"])

    return texts.select("text").mapInArrow(read, "h long, c long, n int, pos int")


def passes(n, pos, a, b, percent: int) -> np.ndarray:
    """Length and positional filter for index arrays a and b."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    need = (percent * (n[a] + n[b]) + 99 + percent) // (100 + percent)
    reach = np.minimum(n[a] - pos[a], n[b] - pos[b])
    return (100 * small >= percent * large) & (reach >= need)


def _groups(batches, names: list[str], most: int):
    """(continued, columns) from batches sorted by the first column: whole groups, as arrays that may hold many of them.

    A group of more than ``most`` rows comes in pieces, each alone; ``continued`` says that a piece isn't the first.
    """
    held = [np.zeros(0, dtype=np.int64) for _ in names]
    ongoing = None

    def give(columns):
        nonlocal ongoing
        if ongoing is not None and columns[0][0] == ongoing:
            first = int(np.searchsorted(columns[0], ongoing, side="right"))
            yield True, [x[:first] for x in columns]
            columns = [x[first:] for x in columns]
        ongoing = None
        if len(columns[0]):
            yield False, columns

    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]
        columns = [np.concatenate(x) for x in zip(held, own, strict=True)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last:
            yield from give([x[:last] for x in columns])
        held = [x[last:] for x in columns]
        if len(held[0]) > most:
            yield from give(held)
            ongoing, held = held[0][0], [x[:0] for x in held]
    if len(held[0]):
        yield from give(held)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    by = np.lexsort((high, low))
    low, high = low[by], high[by]
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[keep], high[keep]


def first_candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with h null; and the rows h, a (class), n, pos, with b null, of shingles that many classes share."""
    large, leaders, most = MANY, LEADERS, max(BLOCK, MANY)

    def output(h, a, b, n, pos):
        return pa.RecordBatch.from_arrays([h, a, b, n, pos], names=["h", "a", "b", "n", "pos"])

    def pair(batches):
        lead: list[np.ndarray] = []
        for continued, (h, c, n, pos) in _groups(batches, ["h", "c", "n", "pos"], most):
            if continued and len(lead[0]) and lead[0][0] == h[0]:
                # the group's leaders stood in its first piece
                k = len(lead[0])
                h, c, n, pos = (np.concatenate(x) for x in zip(lead, (h, c, n, pos), strict=True))
                i, j = np.repeat(np.arange(k), len(h) - k), np.tile(np.arange(k, len(h)), k)
                good = passes(n, pos, i, j, percent) & (c[i] != c[j])
                a, b = _distinct_pairs(c[i[good]], c[j[good]])
                nothing = [pa.nulls(len(a), pa.int64())] * 3
                yield output(nothing[0], pa.array(a), pa.array(b), *nothing[1:])
                yield output(pa.array(h[k:]), pa.array(c[k:]), pa.nulls(len(h) - k, pa.int64()), pa.array(n[k:]), pa.array(pos[k:]))
                continue
            # only a group of more rows than a piece holds may go on, however few classes stand in its first piece
            long = len(h) > most and h[0] == h[-1]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            h, c, n, pos = h[new], c[new], n[new], pos[new]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(begin, len(h)))
            left, right = [], []
            for m in np.unique(size[(size > 1) & (size <= large)]).tolist() if not long else []:
                at = begin[size == m]
                i, j = np.triu_indices(m, 1)
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
            many = np.flatnonzero((size > large) | long)
            for g in many.tolist():
                for first in range(leaders):
                    others = np.arange(begin[g] + first + 1, begin[g] + size[g])
                    left.append(np.full(len(others), begin[g] + first))
                    right.append(others)
            end = slice(begin[-1], begin[-1] + leaders)
            lead = [h[end], c[end], n[end], pos[end]]
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                good = passes(n, pos, i, j, percent)
                a, b = _distinct_pairs(c[i[good]], c[j[good]])
                nothing = [pa.nulls(len(a), pa.int64())] * 3
                yield output(nothing[0], pa.array(a), pa.array(b), *nothing[1:])
            if len(many):
                pick = np.concatenate([np.arange(begin[g], begin[g] + size[g]) for g in many.tolist()])
                yield output(pa.array(h[pick]), pa.array(c[pick]), pa.nulls(len(pick), pa.int64()), pa.array(n[pick]), pa.array(pos[pick]))

    ordered = prefixes.repartition("h").sortWithinPartitions("h", "pos", "n", "c")
    return stored(ordered.mapInArrow(pair, "h long, a long, b long, n long, pos long"), "candidates")


def second_candidates(shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """shared: h, c, n, pos.  All pairs of a shingle, but those of one group."""
    rows = shared.join(labels.select(F.col("node").alias("c"), "root"), "c", "left").select("h", "c", "n", "pos", F.coalesce("root", "c").alias("root"))
    held = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low < high")
    # a large group is cut into blocks, and every pair of blocks is a group of its own
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    cut = rows.join(held.select("h", blocks.alias("blocks")), "h").withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one, two = F.least("block", "other"), F.greatest("block", "other")
    dealt = cells.select(F.when(F.col("blocks") == 1, F.col("h")).otherwise(F.xxhash64("h", one, two)).alias("g"), "c", "n", "pos", "root", ((one != two) & (F.col("block") == two)).cast("int").alias("side"), (one != two).cast("int").alias("apart"))
    ordered = dealt.repartition("g").sortWithinPartitions("g", "n", "c", "pos")

    def pair(batches):
        for _, (g, c, n, pos, root, side, apart) in _groups(batches, ["g", "c", "n", "pos", "root", "side", "apart"], 1 << 62):
            bounds = np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(g))
            for begin, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = np.arange(begin, stop)
                reach = np.searchsorted(n[at], 100 * n[at] // percent, side="right")
                left, right, size = [], [], 0
                for k in range(len(at)):
                    j = at[k + 1 : reach[k]]
                    j = j[(root[j] != root[at[k]]) & ((apart[begin] == 0) | (side[j] != side[at[k]]))]
                    if len(j):
                        i = np.full(len(j), at[k])
                        good = passes(n, pos, i, j, percent)
                        left.append(c[i[good]])
                        right.append(c[j[good]])
                        size += len(left[-1])
                    if left and (size > 1 << 16 or k == len(at) - 1):
                        a, b = _distinct_pairs(np.concatenate(left), np.concatenate(right))
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                        left, right, size = [], [], 0

    return ordered.mapInArrow(pair, "a long, b long")


def wanted_sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """c, set (sorted 64-bit hashes as bytes) of the wanted classes, stored once each."""
    wanted = stored(wanted.distinct(), "wanted")
    bloom = texts.sparkSession.sparkContext.broadcast(build_bloom(wanted))

    def read(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, buf, offsets in slices(batch, "text"):
                grams, begins = shingle_sets(buf, offsets, k)
                keys = class_keys(grams, begins)
                rows = [r for r in np.flatnonzero((keys > 0) & bloom_has(bloom.value, keys)).tolist() if keys[r] not in seen and not seen.add(keys[r])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(keys[rows])), pa.array([grams[begins[r] : begins[r + 1]].tobytes() for r in rows], pa.binary())], names=["c", "set"]
                )

    found = texts.select("text").mapInArrow(read, "c long, set binary")
    return stored(found.join(wanted.toDF("c"), "c", "left_semi").dropDuplicates(["c"]), "wanted-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links."""
    both = pairs.distinct().join(sets.select(F.col("c").alias("a"), F.col("set").alias("one")), "a").join(sets.select(F.col("c").alias("b"), F.col("set").alias("two")), "b")

    def test(batches):
        for batch in batches:
            kept = []
            last, x, cut_x = None, None, None
            for k, (one, two) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                if last is None or not one.equals(last):
                    last, x = one, np.frombuffer(one.as_buffer(), dtype=np.uint64)
                    cut_x = np.diff(np.searchsorted(x, PIVOTS), prepend=0, append=len(x))
                y = np.frombuffer(two.as_buffer(), dtype=np.uint64)
                need = (percent * (len(x) + len(y)) + 99 + percent) // (100 + percent)
                cut_y = np.diff(np.searchsorted(y, PIVOTS), prepend=0, append=len(y))
                if np.minimum(cut_x, cut_y).sum() < need:
                    continue
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                shared = int((merged[1:] == merged[:-1]).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    kept.append(k)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at)], names=["a", "b"])

    return stored(both.select("one", "two", "a", "b").mapInArrow(test, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of the links (a, b)."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "small-star")


def rows_and_labels(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """One row per text: doc_id, t (hash of the text), n, c; and c, root (what its group is known by) of the linked classes."""
    texts = id_text(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))
    rows, sketch = sets_and_sketch(texts, words)
    first = first_candidates(prefix_rows(texts, sketch, words, percent), percent)
    pairs = first.where("b is not null").select("a", "b")
    shared = first.where("b is null").select("h", F.col("a").alias("c"), "n", "pos")
    sets = wanted_sets(texts, first.select(F.explode(F.array("a", "b")).alias("c")).where("c is not null"), words)
    links = verified(pairs, sets, percent)
    labels = components(links)
    if not shared.isEmpty():
        more = verified(second_candidates(shared, labels, percent), sets, percent)
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    return rows, labels.withColumnRenamed("node", "c")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id (least id of the group)."""
    rows, labels = rows_and_labels(docs, id_col, text_col, words, percent)
    classes = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least")).join(labels, "c", "left")
    named = classes.groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("least").alias("component_id"))
    owner = stored(classes.select("c", F.coalesce("root", "c").alias("root")).join(named, "root").select("c", "component_id"), "groups")
    joined = rows.join(owner, "c", "left")
    return joined.select("doc_id", "t", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, one for each group (that with the least id, a null id last); rows without words stay.

    A group is known by its root: component_id may be null or shared by groups whose texts share an id.
    """
    rows, labels = rows_and_labels(docs, id_col, text_col, words, percent)
    first = rows.where("n > 0").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "t")).alias("w"))
    best = first.join(labels, "c", "left").groupBy(F.coalesce("root", "c")).agg(F.min("w").alias("w")).select(F.col("w.doc_id").alias("__id"), F.col("w.t").alias("__t"), F.lit(True).alias("__one"))
    blank = rows.where("n = 0").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.lit(False).alias("__one")).distinct()
    marked = docs.withColumn("__text_hash", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    kept = marked.join(best.unionByName(blank), (F.col("__text_hash") == F.col("__t")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")))
    place = F.row_number().over(Window.partitionBy("__t", "__id").orderBy(F.lit(0)))
    return kept.withColumn("__place", place).where("not __one or __place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir)).drop("t")


QUERIES = {"op1_jaccard_join": op1_jaccard_join}
ORACLE = {
    "op1_jaccard_join": r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, s from (select doc_id, unnest(list_transform(range(greatest(1, len(w) - 3)), lambda i: array_to_string(w[i + 1 : i + 4], ' '))) as s from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b using (s) where a.doc_id < b.doc_id group by all),
e as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
l as (select x, y from e union all select y, x from e),
r as (select doc_id as x, doc_id as y from d union select r.x, l.y from r join l on l.x = r.y)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id from d left join n using (doc_id) join (select x as doc_id, min(y) as component_id from r group by x) using (doc_id)
"""
}
