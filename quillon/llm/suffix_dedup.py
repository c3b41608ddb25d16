"""Suffix-array dedup: removes every byte covered by a long string that also starts elsewhere.

The suffix array is built by linear grouping.  A suffix belongs to the group of its longest Lyndon prefix.  Groups are
refined from the greatest to the least: each member of the group at hand looks for the nearest earlier suffix in a lower
group by its previous-smaller pointer, and that suffix's Lyndon prefix grows by the member's.  When all groups stand, the
order is emitted from the sentinel on: the suffix that follows the Lyndon prefix of another one calls it into the next free
place of its group.  Nothing is renamed or sorted recursively.

The construction runs over phrases, not bytes: the input is cut where a hash of the last ``TRIGGER`` bytes asks for it, phrases
are ranked as byte strings, and the suffix array of the phrase ranks gives each byte position the order (rest of its phrase,
rank of the phrase suffix behind).  Positions that agree in the first ``width`` bytes stand side by side, and the common prefixes of the array's
neighbours say which do.  An array covers the distinct contents of a shard of anchors (see ``repeats``), with their counts.

Edge cases: a null or empty text has no bytes; a text shorter than the width keeps all; rows that repeat, with their ids
or without, are occurrences of their own; an empty table gives no rows; other columns are not read; texts of any length are
cut into runs before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, prefix_hash, span_hash
from .repeats import bounded, indexed, merged, repeated_runs, with_spans

WIDTH = 200
GRAM = 20
TRIGGER = 4


def lyndon_groups(text: list[int]) -> tuple[list[list[int]], list[int], list[int]]:
    """Members of the final groups from the least to the greatest, their Lyndon prefix lengths, and each suffix's group."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        first.setdefault(symbol, []).append(i)
    symbols = sorted(first)
    members = [first[s] for s in symbols]
    place = {s: g for g, s in enumerate(symbols)}
    group = [place[s] for s in text]
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    top = len(members) - 1
    above[top] = -1
    done = [False] * len(members)
    smaller = list(range(-1, n - 1))
    falling = []
    at = top
    while at >= 0:
        done[at] = True
        own = [i for i in members[at] if group[i] == at]
        if own:
            members[at] = own
            falling.append(at)
            size = length[at]
            counts: dict[int, int] = {}
            most = 1
            for i in own:
                p = smaller[i]
                while p >= 0 and done[group[p]]:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    if p in counts:
                        counts[p] += 1
                        most = max(most, counts[p])
                    else:
                        counts[p] = 1
            made: dict[tuple[int, int], int] = {}
            for p, k in sorted(counts.items(), key=lambda x: -x[1]) if most > 1 else counts.items():
                old = group[p]
                new = made.get((old, k))
                if new is None:
                    new = made[old, k] = len(members)
                    members.append([])
                    length.append(length[old] + k * size)
                    done.append(False)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new  # up is at least the group at hand
                group[p] = new
                members[new].append(p)
        at = below[at]
    falling.reverse()
    return [members[g] for g in falling], [length[g] for g in falling], group


def suffix_array(text: list[int]) -> list[int]:
    """``text`` ends with a symbol that is less than all others and stands nowhere else."""
    n = len(text)
    groups, lengths, _ = lyndon_groups(text)
    free = [0] * len(groups)
    number = np.zeros(n, dtype=np.int64)
    behind = np.zeros(n, dtype=np.int64)
    total = 0
    for g, own in enumerate(groups):
        free[g] = total
        total += len(own)
        number[own] = g
        behind[own] = np.asarray(own) + lengths[g]
    callers = np.argsort(behind, kind="stable")
    bounds = np.searchsorted(behind[callers], np.arange(n + 1)).tolist()
    called, group_of = callers.tolist(), number.tolist()
    order = [0] * n
    order[0] = n - 1
    for k in range(n):
        j = order[k]
        for i in called[bounds[j] : bounds[j + 1]]:
            g = group_of[i]
            order[free[g]] = i
            free[g] += 1
    return order


def phrase_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of phrases: all ends of texts, and the places behind a trigger."""
    if len(buf) < TRIGGER:
        return offsets[1:]
    four = np.zeros(len(buf) - TRIGGER + 1, dtype=np.uint32)
    for k in range(TRIGGER):
        four = (four << np.uint32(8)) | buf[k : len(buf) - TRIGGER + 1 + k]
    hit = np.flatnonzero((four * np.uint32(0x9E3779B1)) >> np.uint32(27) == 0) + TRIGGER
    inside = hit - TRIGGER >= offsets[np.searchsorted(offsets, hit, side="left") - 1]
    return np.union1d(hit[inside], offsets[1:])


def common_prefixes(rows: np.ndarray, byte: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """For each entry of the array, the bytes (``width`` at most) that its suffix shares with the one before; 0 for the first.
    A suffix ends with its payload."""
    left = offsets[np.minimum(np.searchsorted(offsets, byte, side="right"), len(offsets) - 1)] - byte
    out = np.zeros(len(byte), dtype=np.int64)
    for k in range(1, len(byte), 1 << 15):
        here = np.arange(k, min(k + (1 << 15), len(byte)))
        differ = rows[byte[here]] != rows[byte[here - 1]]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[here] = np.minimum(shared, np.minimum(left[here], left[here - 1]))
    return out


def range_minimum(values: np.ndarray):
    """A function of two index arrays: the least of values[low..high], low <= high, from tables of doubling stretches."""
    tables = [values]
    while 2 << (len(tables) - 1) <= len(values):
        step = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))

    def least(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=values.dtype)
        for k in np.unique(level).tolist():
            pick = level == k
            out[pick] = np.minimum(tables[k][low[pick]], tables[k][high[pick] - (1 << k) + 1])
        return out

    return least


def sorted_windows(payloads: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows in the order of the suffix array: their payload, their start in it, whether each equals the one before, and
    the whole buffer's offsets."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in payloads])]).astype(np.int64)
    buf = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    total = prefix_hash(buf)
    ends = phrase_cuts(buf, offsets)
    begins = np.concatenate([[0], ends[:-1]])
    _, where, which = np.unique(span_hash(total, begins, ends), return_index=True, return_inverse=True)
    phrases = [buf[s:e].tobytes() for s, e in zip(begins[where].tolist(), ends[where].tolist(), strict=True)]
    rank = np.empty(len(phrases), dtype=np.int64)
    rank[sorted(range(len(phrases)), key=phrases.__getitem__)] = np.arange(len(phrases)) + 2
    # phrase ranks, a 1 behind every payload, a 0 at the end
    last = np.isin(ends, offsets[1:])
    spot = np.arange(len(ends)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    text = np.ones(len(ends) + len(payloads) + 1, dtype=np.int64)
    text[spot] = rank[which]
    text[-1] = 0
    array = np.asarray(suffix_array(text.tolist()))
    order = np.empty(len(text), dtype=np.int64)
    order[array] = np.arange(len(text))
    # where each entry's bytes begin: a phrase's first byte, a separator's own place
    byte = np.zeros(len(text), dtype=np.int64)
    byte[spot] = begins
    byte[spot[last] + 1] = ends[last]
    byte[-1] = len(buf)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(width, np.uint8)]), width)
    least = range_minimum(common_prefixes(rows, byte[array], offsets, width))
    starts = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    cut = np.searchsorted(ends, starts + TRIGGER)
    whole = ends[cut] >= starts + width
    stop = np.where(whole, starts + width, ends[cut])
    lead = span_hash(total, starts, stop)
    rest = np.where(whole, -1, order[spot[cut] + 1])
    by = np.lexsort((rest, lead))
    starts, lead, rest, need = starts[by], lead[by], rest[by], (starts + width - stop)[by]
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = lead[1:] == lead[:-1]
    pair = np.flatnonzero(same & (rest >= 0))
    same[pair] = least(rest[pair - 1] + 1, rest[pair]) >= need[pair]
    # leads were compared by hash: an exact check of what the array says
    for k in range(0, len(starts), 1 << 15):
        pair = np.flatnonzero(same[k : k + (1 << 15)]) + k
        same[pair] = (rows[starts[pair]] == rows[starts[pair - 1]]).all(axis=1)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return owner, starts - offsets[owner], same, offsets


def weigh(width: int):
    """The index function for ``repeats.indexed``: windows that occur twice in contents that themselves occur once."""

    def index(held: dict[str, list]):
        owner, start, same, _ = sorted_windows(held["payload"], width)
        counts = np.asarray(held["n"])
        kind = np.cumsum(~same) - 1
        twice = np.bincount(kind, weights=counts[owner])[kind] > 1
        pick = twice & (counts[owner] == 1)
        by = np.lexsort((start[pick], owner[pick]))
        own, at = owner[pick][by], start[pick][by]
        if not len(own):
            return
        edge = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        stop = np.append(edge[1:], len(own)) - 1
        yield from zip(own[edge].tolist(), at[edge].tolist(), at[stop].tolist(), strict=True)

    return index


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, binary), kept_sha256."""
    texts = id_text(docs, id_col, text_col).withColumn("t", F.xxhash64("doc_id", "text"))
    found = repeated_runs(texts, lambda buf, offsets: (buf, offsets), width, gram)
    members, several = bounded(found, width, gram, np.uint8)
    copies = members.select("t", F.col("i").alias("s"), F.col("j").alias("e"))
    compared = indexed(several, weigh(width)).select("t", "s", "e")
    spanned = with_spans(texts, copies.unionByName(compared), width)

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for raw, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, gone = raw or b"", merged(spans)
                keep, at = [], 0
                for s, e in gone:
                    keep.append(raw[at:s])
                    at = e
                kept = b"".join([*keep, raw[at:]])
                for column, value in zip(out, (len(raw), sum(e - s for s, e in gone), len(gone), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return spanned.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE = {
    "op4_suffix_dedup": r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, i, md5(substring(h, 2 * i + 1, 400)) as win from (select doc_id, h, unnest(range(len(h) // 2 - 199)) as i from b where len(h) >= 400)),
f as (select doc_id, i from (select doc_id, i, count(*) over (partition by win) as n from p) where n > 1),
o as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 200 then 1 else 0 end as new from f),
k as (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from o),
s as (select doc_id, min(i) as s, max(i) + 200 as e from k group by doc_id, k),
q as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as before from s),
r as (select q.doc_id, sum(e - s)::bigint as n_removed, count(*) as n_spans, string_agg(substring(h, 2 * before + 1, 2 * (s - before)), '' order by s) || substring(any_value(h), 2 * max(e) + 1) as kept from q join b on q.doc_id = b.doc_id group by q.doc_id)
select b.doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from b left join r using (doc_id)
"""
}
