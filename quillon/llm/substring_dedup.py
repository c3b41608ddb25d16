"""Substring dedup: suffix automata of reference shards, and matching statistics of the texts streamed through them.

A reference shard holds the distinct contents of some anchors (see ``repeats``) in the order of their first places.  Each
content is streamed through the automaton of the contents before it: the state reached gives, for every word, the length of
the longest stretch ending there that occurs earlier (the matching statistic).  Maximal stretches above the threshold
are removed; then the content joins the reference.  A later row with the same content is covered whole.

The automata go to the rows by the anchors' exchange rather than by a broadcast: every text is a reference for the ones
behind it, so the automata of all shards grow with the corpus, while a shard is bounded and met by the rows it can match alone.

Edge cases: a null, empty or blank text has no words; a text under the width keeps all; rows with one doc_id and one text
have one place, so neither removes the other; null ids come first; rows that share an id but not the text stand in the
order of a hash; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, prefix_hash, slices, span_hash, word_spans
from .repeats import bounded, indexed, merged, repeated_runs, stretches, with_spans

WIDTH = 20
GRAM = 6


class SuffixAutomaton:
    """Online suffix automaton of several sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def _clone(self, p: int, q: int, symbol: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, symbol)
                continue
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p != -1 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
            last = new

    def matching(self, sequence: list[int]) -> list[int]:
        """For every place, the length of the longest stretch ending there that the automaton knows."""
        state = size = 0
        out = []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            step = self.next[state].get(symbol)
            if step is not None:
                state, size = step, size + 1
            else:
                size = 0
            out.append(size)
        return out


def earlier(width: int):
    """The index function for ``repeats.indexed``: windows that stand in an earlier content of the same anchor."""

    def index(held: dict[str, list]):
        automaton, anchor = None, None
        for k, (a, raw) in enumerate(zip(held["a"], held["payload"], strict=True)):
            words = np.frombuffer(raw, dtype=np.uint64).tolist()
            if automaton is None or a != anchor:
                automaton, anchor = SuffixAutomaton(), a
            else:
                known = np.asarray(automaton.matching(words)[width - 1 :]) >= width
                for first, last in stretches(known):
                    yield k, first, last
            automaton.add(words)

    return index


def word_units(buf: np.ndarray, offsets: np.ndarray):
    starts, ends, first = word_spans(buf, offsets)
    return span_hash(prefix_hash(buf), starts, ends), first


def remove_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space), kept_sha256."""
    texts = id_text(docs, id_col, text_col).withColumn("t", F.xxhash64("doc_id", "text"))
    found = repeated_runs(texts, word_units, width, gram)
    members, several = bounded(found, width, gram, np.uint64)
    copies = members.where("not least").select("t", F.col("i").alias("s"), F.col("j").alias("e"))
    compared = indexed(several, earlier(width)).select("t", "s", "e")
    spanned = with_spans(texts, copies.unionByName(compared), width)

    def cut(batches):
        for batch in batches:
            at = 0
            for rows, buf, offsets in slices(batch.select(["doc_id", "text"]), "text"):
                starts, ends, first = word_spans(buf, offsets)
                spans = batch.column(2).slice(at, rows.num_rows).to_pylist()
                at += rows.num_rows
                out: list[list] = [[], [], [], []]
                for k, own in enumerate(spans):
                    a, b = first[k], first[k + 1]
                    gone = merged(own)
                    keep = np.ones(b - a, dtype=bool)
                    for s, e in gone:
                        keep[s:e] = False
                    pick = np.flatnonzero(keep) + a
                    kept = b" ".join([buf[s:e].tobytes() for s, e in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)])
                    for column, value in zip(out, (int(b - a), int(b - a - len(pick)), kept.decode(), hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return spanned.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_earlier(documents(spark, sf_dir)).drop("kept")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE = {
    "op5_substring_dedup": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') as win from (select doc_id, w, unnest(range(len(w) - 19)) as i from d where len(w) >= 20)),
f as (select doc_id, i, row_number() over (partition by win order by doc_id, i) as k from p),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as q from f where k > 1),
x as (select doc_id, unnest(w) as word, unnest(range(len(w))) as q from d),
kept as (select doc_id, string_agg(word, ' ' order by q) as t, count(*) as n from x anti join gone using (doc_id, q) group by doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""
}
