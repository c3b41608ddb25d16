"""Finding the windows that occur twice: the exchange that the two substring operators share.

A text is a sequence of units (bytes, or words).  A window is ``width`` consecutive units of one text.  Its anchor is the
leftmost among the grams of ``gram`` units in it with the least hash, so equal windows have equal anchors at equal places.
Consecutive windows with the same anchor form a run, about 2 for every ``width - gram`` units.  These steps follow:

1. count the runs of every anchor value, and see whether their contents differ (a hash aggregate with map-side sums);
2. read the texts again and keep the runs of anchors that occur twice.  Bloom filters stand for those anchors; a false
   positive costs a row and is dropped by the exact counts of step 3;
3. runs with one and the same content are copies of each other and settled by counting (anchor, content).  Where an anchor has
   different contents, each content goes once, with its units, to the operator's index, which compares them exactly.  An
   index gets whole anchors, so equal windows always meet in one;
4. an anchor with many contents is split: its runs are cut in two where the windows' offset from the anchor passes the middle,
   and a half's windows all hold more of the text around the anchor, which is their new, longer anchor.  Halves go through
   step 3 again, until no anchor has more than ``MOST_CONTENTS`` contents (a half of one offset has one content, its window).  So
   every group is bounded, a content gives two rows a level at most, and all that differs is compared by the index.

A text is read in pieces of ``PIECE`` units that overlap by a window, so memory doesn't depend on its length (about 90 bytes a
unit of a piece).  Runs that repeat one behind the other, as in periodic texts, are folded into two rows.

Rows that share doc_id and text have one place; rows that share doc_id alone are told apart by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_has, build_bloom, mix64, prefix_hash, signed, slices, sliding_min, span_hash, stored

PLACE = np.uint64(28)
PIECE = 1 << 18
MOST_CONTENTS = 2000
INDEX_BYTES = 1 << 19


def runs(units: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """units: a 64-bit hash per unit, or bytes; offsets: where each text begins (and the end).

    Returns row, first and last window start (places in ``units``), anchor, content hash, offset of the anchor from the first
    window, and count.  Equal runs one behind the other are two rows: the first run, and the stretch of the others with
    their number.
    """
    pieces = [_runs(units[p : p + PIECE + width - 1], p, offsets, width, gram) for p in range(0, max(len(units) - width + 1, 1), PIECE)]
    row, first, last, anchor, content, shift = (np.concatenate(x) for x in zip(*pieces, strict=True))
    again = np.zeros(len(row) + 1, dtype=bool)
    again[1:-1] = (row[1:] == row[:-1]) & (first[1:] == last[:-1] + 1) & (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
    begin = np.flatnonzero(~again[:-1])
    second = np.flatnonzero(again[:-1] & ~np.append(False, again[: max(len(row) - 1, 0)])[: len(row)])
    stop = np.flatnonzero(again[:-1] & ~again[1:])
    end = last.copy()
    end[second] = last[stop]
    count = np.ones(len(row), dtype=np.int64)
    count[second] = stop - second + 1
    pick = np.sort(np.concatenate([begin, second]))
    return row[pick], first[pick], end[pick], anchor[pick], content[pick], shift[pick], count[pick]


def _runs(units: np.ndarray, base: int, offsets: np.ndarray, width: int, gram: int):
    """The runs, not folded, of the windows that begin in a piece; ``base``: the place of its first unit."""
    empty = np.zeros(0, dtype=np.int64)
    if len(units) < width:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty
    total, span = prefix(units)
    at = np.arange(len(units) - gram + 1)
    grams = span(total, at, at + gram)
    order = ((mix64(grams) >> PLACE) << PLACE) | at.astype(np.uint64)
    anchor_at = (sliding_min(order, width - gram + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    n = len(anchor_at)
    place = np.arange(base, base + n)
    row = np.searchsorted(offsets, place, side="right") - 1
    inside = place + width <= offsets[row + 1]
    change = np.ones(n, dtype=bool)
    change[1:] = (anchor_at[1:] != anchor_at[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    shift = anchor_at[first] - first
    content = mix64(span(total, first, last + width) ^ shift.astype(np.uint64))
    return row[first], first + base, last + base, grams[anchor_at[first]], content, shift


_STEP = 0x9E3779B97F4A7C15 | 5
_steps: dict[str, np.ndarray] = {}


def _unit_steps(n: int):
    if "p" not in _steps or len(_steps["p"]) < n:
        size = max(n, 1 << 18)
        for name, base in (("p", _STEP), ("q", pow(_STEP, -1, 1 << 64))):
            values = np.full(size, base, dtype=np.uint64)
            values[0] = 1
            _steps[name] = np.multiply.accumulate(values)
    return _steps["p"], _steps["q"]


def unit_prefix(units: np.ndarray) -> np.ndarray:
    p, _ = _unit_steps(len(units) + 1)
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * p[: len(units)], out=out[1:])
    return out


def unit_span(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = _unit_steps(len(total))
    return mix64((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))


def prefix(units: np.ndarray):
    """Prefix sums of the units and the function that hashes spans from them."""
    return (prefix_hash(units), span_hash) if units.dtype == np.uint8 else (unit_prefix(units), unit_span)


#: Gives, for a slice (byte buffer, row offsets), the units and where each row's units begin.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def repeated_runs(texts: DataFrame, units_of: Units, width: int, gram: int) -> DataFrame:
    """texts: doc_id, text, t (hash of both).  Returns, stored: a (anchor), c (content), doc_id, t, i, j (first and last
    window, from the text's first unit), d (anchor's offset from i), m (runs in the row), payload (the run's units as bytes
    where the anchor's contents differ, on one row at least for each content).

    Holds every run whose anchor occurs twice, and some others.
    """

    def count(batches):
        for batch in batches:
            for _, buf, offsets in slices(batch, "text"):
                units, begins = units_of(buf, offsets)
                _, _, _, anchor, content, _, m = runs(units, begins, width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(signed(content)), pa.array(m)], names=["a", "c", "m"])

    seen = texts.select("text").mapInArrow(count, "a long, c long, m long").groupBy("a").agg(F.sum("m").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    twice = stored(seen.where("n > 1").select("a", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    context = texts.sparkSession.sparkContext
    any_twice = context.broadcast(build_bloom(twice.select("a")))
    any_mixed = context.broadcast(build_bloom(twice.where("mixed").select("a")))

    def emit(batches):
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                units, begins = units_of(buf, offsets)
                found = runs(units, begins, width, gram)
                pick = bloom_has(any_twice.value, found[3])
                row, first, last, anchor, content, shift, m = (x[pick] for x in found)
                payload: list[bytes | None] = [None] * len(row)
                mixed = np.flatnonzero(bloom_has(any_mixed.value, anchor))
                once = mixed[np.unique(content[mixed], return_index=True)[1]]  # the first of equal ones, so a single run
                for k, s, e in zip(once.tolist(), first[once].tolist(), last[once].tolist(), strict=True):
                    payload[k] = units[s : e + width].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(signed(content)), rows.column(0).take(pa.array(row)), rows.column(2).take(pa.array(row)),
                     pa.array(first - begins[row]), pa.array(last - begins[row]), pa.array(shift.astype(np.int32)), pa.array(m), pa.array(payload, pa.binary())],
                    names=["a", "c", "doc_id", "t", "i", "j", "d", "m", "payload"],
                )

    return stored(texts.select("doc_id", "text", "t").mapInArrow(emit, "a long, c long, doc_id long, t long, i long, j long, d int, m long, payload binary"), "runs")


def contents_of(found: DataFrame) -> DataFrame:
    """Stored: a, c, n (runs with that content), at (their least doc_id, t, i, and the j and d of that row), payload, kinds
    (contents of the anchor), and lo and hi where found has them."""
    anchor = ["a", *(x for x in ("lo", "hi") if x in found.columns)]
    light = found.groupBy(*anchor, "c").agg(F.sum("m").alias("n"), F.min(F.struct("doc_id", "t", "i", "j", "d")).alias("at"))
    kinds = light.groupBy("a").agg(F.count("*").alias("kinds"))
    units = found.where("payload is not null").groupBy("a", "c").agg(F.first("payload").alias("payload"))
    return stored(light.join(kinds, "a").join(units, ["a", "c"], "left"), "contents")


def members_of(found: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows of contents that occur twice: doc_id, t, i, j, and least (whether this is the least place of the content)."""
    least = F.struct("doc_id", "t", "i") == F.struct("at.doc_id", "at.t", "at.i")
    return found.select("a", "c", "doc_id", "t", "i", "j").join(contents.where("n > 1").select("a", "c", "at"), ["a", "c"]).select("doc_id", "t", "i", "j", least.alias("least"))


def halves(large: DataFrame, width: int, dtype) -> DataFrame:
    """large: contents of anchors whose windows begin lo to hi units before the anchor.  Returns them, stored, as runs of two
    new anchors each, with the half's own lo and hi."""

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for n, doc_id, t, i, d, payload, low, high in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                units = np.frombuffer(payload, dtype=dtype)
                total, span = prefix(units)
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    s, e = max(0, d - hi), min(len(units) - width, d - lo)
                    if s > e:
                        continue
                    keys = mix64(span(total, np.array([d - lo, s]), np.array([d - hi + width, e + width])) ^ np.array([lo, d - s], dtype=np.uint64))
                    out.append((*signed(keys).tolist(), doc_id, t, i + s, i + e, d - s, n, units[s : e + width].tobytes(), lo, hi))
            columns = list(zip(*out, strict=True)) or [()] * 11
            kinds = (*[pa.int64()] * 6, pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["a", "c", "doc_id", "t", "i", "j", "d", "m", "payload", "lo", "hi"])

    rows = large.select("n", "at.doc_id", "at.t", "at.i", "at.d", "payload", "lo", "hi")
    return stored(rows.mapInArrow(cut, "a long, c long, doc_id long, t long, i long, j long, d int, m long, payload binary, lo int, hi int"), "halves")


def bounded(found: DataFrame, width: int, gram: int, dtype) -> tuple[DataFrame, DataFrame]:
    """Members of all contents that occur twice (see ``members_of``), and the contents of all anchors with several, none with
    more than ``MOST_CONTENTS``.  Splits the anchors with more, a level of halves at a time, until none is left."""
    members, several = [], []
    lo, hi = F.lit(0).alias("lo"), F.lit(width - gram).alias("hi")
    while True:
        contents = contents_of(found)
        members.append(members_of(found, contents))
        several.append(contents.where(f"kinds between 2 and {MOST_CONTENTS}").select("a", "n", "at", "payload"))
        large = contents.where(f"kinds > {MOST_CONTENTS}")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, members), reduce(DataFrame.unionByName, several)
        found = halves(large if "lo" in large.columns else large.select("*", lo, hi), width, dtype)


def indexed(several: DataFrame, index) -> DataFrame:
    """``index(list of column dictionaries' lists)`` over whole anchors: yields (row number, first, last window) for the windows
    settled as repeated.  Returns doc_id, t, s, e (window places in the text)."""
    rows = several.select("a", "n", F.col("at.doc_id").alias("doc_id"), F.col("at.t").alias("t"), F.col("at.i").alias("i"), "payload")
    dealt = rows.repartition("a").sortWithinPartitions("a", F.col("doc_id").asc_nulls_first(), "t", "i")

    def run(batches):
        for held in grouped(batches, "a", INDEX_BYTES):
            got = list(index(held))
            at = [k for k, _, _ in got]
            place = [held["i"][k] for k in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([held["doc_id"][k] for k in at], pa.int64()), pa.array([held["t"][k] for k in at], pa.int64()),
                 pa.array([p + s for p, (_, s, _) in zip(place, got, strict=True)], pa.int64()), pa.array([p + e for p, (_, _, e) in zip(place, got, strict=True)], pa.int64())],
                names=["doc_id", "t", "s", "e"],
            )

    return dealt.mapInArrow(run, "doc_id long, t long, s long, e long")


def grouped(batches, key: str, limit: int):
    """Over batches sorted by key: dictionaries of column lists that hold whole groups, about ``limit`` payload bytes each
    time (a larger group comes alone)."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        for k in range(batch.num_rows):
            if size >= limit and columns[key][k] != held[key][-1]:
                yield held
                held, size = {}, 0
            for n, values in columns.items():
                held.setdefault(n, []).append(values[k])
            size += len(columns["payload"][k] or b"")
    if held:
        yield held


def stretches(flags: np.ndarray):
    """Maximal runs of true entries as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)


def with_spans(texts: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """texts with spans: the merged [s, e) unit ranges that the found windows cover, as arrays of starts and ends."""
    reach = spans.select("t", "s", (F.col("e") + width).alias("e"))
    each = reach.groupBy("t").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    return texts.join(each, "t", "left")


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in spans or []:
        s, e = x["s"], x["e"]
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
