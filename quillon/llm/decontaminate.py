"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, texts scanned once.

Normalisation lower-cases A-Z and keeps words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by single spaces.
Patterns are windows of 13 consecutive item words (a shorter item is one window), framed by spaces so that they match
whole words only.  A document word inside any occurrence of a window is hit.

Edge cases: a null or wordless text has 0 words and is never contaminated; an item with a null or wordless text has no
window; rows of the benchmark that share an id are one item, and so are all without an id, which hit and count but aren't in
items_sha256; an empty benchmark hits nothing; repeated documents are judged one by one; other columns are not read; a text
is scanned whole, in memory of a few times its size.

The benchmark's size is measured first.  Up to ``MAX_PATTERN_BYTES`` of windows it is collected, broadcast and scanned for in
one pass, without an exchange.  A larger one is dealt by hash into parts of about that size; each part is collected, broadcast and
scanned for in a pass of its own, and the passes' findings for a row are merged by its id and text.
"""

from __future__ import annotations

import hashlib
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, per_worker

WINDOW = 13
MAX_PATTERN_BYTES = 16 << 20
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if (c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) else 32 for c in range(256))


def normal_words(text: str | bytes | None) -> list[bytes]:
    raw = (text or b"").encode() if isinstance(text, str) else (text or b"")
    return [w for w in raw.translate(_TABLE).split(b" ") if w]


def windows(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def original_offsets(text: str) -> list[tuple[int, int]]:
    """Code-point start and end of each normalised word in the text itself."""
    spans, start = [], None
    for i, ch in enumerate(text):
        code = ord(ch)
        inside = code > 127 or ch.isalnum()
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            spans.append((start, i))
            start = None
    if start is not None:
        spans.append((start, len(text)))
    return spans


def compile_automata(items: list[tuple[str | None, list[bytes]]], width: int = WINDOW, limit: int = MAX_PATTERN_BYTES):
    """Automata over bounded groups of items.  A pattern's value: (words in it, ids of its items)."""
    import ahocorasick

    groups, patterns, size = [], {}, 0

    def close():
        if patterns:
            automaton = ahocorasick.Automaton()
            for p, (n, owners) in patterns.items():
                automaton.add_word(f" {p.decode('latin-1')} ", (n, tuple(owners)))
            automaton.make_automaton()
            groups.append(automaton)

    for item, words in items:
        for w in windows(words, width):
            if w not in patterns:
                if size > limit:
                    close()
                    patterns, size = {}, 0
                patterns[w] = (w.count(b" ") + 1, [])
                size += len(w)
            owners = patterns[w][1]
            if not owners or owners[-1] != item:
                owners.append(item)
    close()
    return groups


def scan(words: list[bytes], automata: list) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit word ranges (merged, half open) and the ids of the items that occur."""
    if not words:
        return [], set()
    joined = b" ".join([b"", *words, b""]).decode("latin-1")
    ranges, owners, ends = [], set(), None
    for automaton in automata:
        for end, (n, who) in automaton.iter(joined):
            if ends is None:
                ends = np.cumsum([len(w) + 1 for w in words])
            last = int(np.searchsorted(ends, end)) + 1
            ranges.append((last - n, last))
            owners.update(who)
    return merged(ranges), owners


def merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def passes_of(benchmark: DataFrame, width: int) -> list[DataFrame]:
    """The benchmark in parts whose windows have about MAX_PATTERN_BYTES at most."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * width
    parts = -(-size // MAX_PATTERN_BYTES)
    return [items] if parts <= 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) for p in range(parts)]


def scanner(part: DataFrame, width: int):
    """A function that gives the automata of one part of the benchmark, built once by each worker."""
    rows = part.distinct().collect()  # bounded: see passes_of
    items = sorted(((i, normal_words(t)) for i, t in rows), key=lambda x: (x[0] is None, x[0] or "", x[1]))
    raw = pickle.dumps((items, width, MAX_PATTERN_BYTES))
    shared, key = part.sparkSession.sparkContext.broadcast(raw), ("benchmark", hashlib.sha256(raw).hexdigest())
    return lambda: per_worker(key, lambda: compile_automata(*pickle.loads(shared.value)))


def verdict(n: int, ranges: list[tuple[int, int]], owners) -> tuple[int, int, str, bool]:
    """n_hit, n_items, items_sha256, contaminated."""
    hit, known = sum(b - a for a, b in ranges), set(owners)
    return hit, len(known), hashlib.sha256(",".join(sorted(known - {None})).encode()).hexdigest(), hit > 0 and 20 * hit >= n


JUDGED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "array<struct<start:long,end:long>>"


def _judgement(text: bytes | None, n: int, ranges, owners, spans: bool) -> tuple:
    at = original_offsets(text.decode()) if spans and ranges else []
    return (n, *verdict(n, ranges, owners), *([[{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]] if spans else []))


def _arrays(rows: list[tuple], spans: bool) -> tuple[list, list[str]]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *([pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] if spans else [])]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(["spans"] if spans else [])]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and, if asked for, the hit spans as
    code-point offsets into the original text (array of start/end structs)."""
    texts, parts = id_text(docs, id_col, text_col), passes_of(benchmark, width)
    schema = f"doc_id long, {JUDGED}" + (f", spans {SPANS}" if spans else "")
    if len(parts) == 1:
        automata = scanner(parts[0], width)

        def run(batches):
            held = automata()
            for batch in batches:
                out = []
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    words = normal_words(text)
                    out.append(_judgement(text, len(words), *scan(words, held), spans))
                arrays, names = _arrays(out, spans)
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names])

        return texts.mapInArrow(run, schema)

    keyed = texts.withColumn("t", F.xxhash64("doc_id", "text"))
    found = reduce(DataFrame.unionByName, [_findings(keyed, scanner(p, width)) for p in parts]).distinct()
    of_row = found.groupBy("t").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("owners")).alias("owners"))

    def join(batches):
        for batch in batches:
            _, texts, ranges, owners = (c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3)))
            out = [_judgement(t, len(normal_words(t)), merged([(x["a"], x["b"]) for x in r or []]), w or [], spans) for t, r, w in zip(texts, ranges, owners, strict=True)]
            arrays, names = _arrays(out, spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names])

    return keyed.join(of_row, "t", "left").select("doc_id", "text", "ranges", "owners").mapInArrow(join, schema)


def _findings(keyed: DataFrame, automata) -> DataFrame:
    """What one part of the benchmark hits: t, ranges (word places), owners (item ids); a row that isn't hit gives none."""

    def run(batches):
        held = automata()
        for batch in batches:
            at, ranges, owners = [], [], []
            for k, text in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
                hit, who = scan(normal_words(text), held)
                if hit:
                    at.append(k)
                    ranges.append([{"a": a, "b": b} for a, b in hit])
                    owners.append(sorted(who, key=lambda x: (x is None, x or "")))
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int64())), pa.array(ranges, kind), pa.array(owners, pa.list_(pa.string()))], names=["t", "ranges", "owners"])

    return keyed.select("text", "t").mapInArrow(run, "t long, ranges array<struct<a:long,b:long>>, owners array<string>")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated; a benchmark of one part needs no exchange for it."""
    parts = passes_of(benchmark, width)
    if len(parts) > 1:
        bad = decontaminate(docs.withColumn("__t", F.xxhash64(F.col(f"`{text_col}`").cast("string"))), benchmark, "__t", text_col, width).where("contaminated")
        marked = docs.withColumn("__t", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
        return marked.join(bad.select(F.col("doc_id").alias("__t")), "__t", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    automata, at = scanner(parts[0], width), docs.columns.index(text_col)

    def clean(text: bytes | None, held) -> bool:
        words = normal_words(text)
        return not verdict(len(words), *scan(words, held))[3]

    def run(batches):
        held = automata()
        for batch in batches:
            yield batch.filter(pa.array([clean(t, held) for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op9_decontaminate": op9_decontaminate}

ORACLE = {
    "op9_decontaminate": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents),
b as (select cast(item_id as varchar) as item_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w from benchmark),
g as (select item_id, least(13, len(w)) as n, unnest(list_transform(range(greatest(1, len(w) - 12)), lambda i: array_to_string(w[i + 1 : i + 13], ' '))) as win from b where len(w) > 0),
dp as (select doc_id, w, unnest(range(len(w))) as p from d),
hits as (select dp.doc_id, g.item_id, dp.p, g.n from dp join (select distinct n from g) s on dp.p + s.n <= len(dp.w) join g on g.n = s.n and g.win = array_to_string(dp.w[dp.p + 1 : dp.p + s.n], ' ')),
hw as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
hi as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
"""
}
