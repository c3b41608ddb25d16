from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard_join
from quillon.llm.registry import QUERIES


def shingles(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = Counter((a, b) for own in holders.values() for x, a in enumerate(own) for b in own[x + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("many", "leaders", "block"), [(32, 4, 20000), (2, 1, 3)])
def test_odd_rows(tricky, monkeypatch, many, leaders, block):
    monkeypatch.setattr(jaccard_join, "MANY", many)
    monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    assert got(jaccard_join.linked(tricky)) == brute(pairs(tricky))
    assert got(jaccard_join.linked(tricky, words=5, percent=60)) == brute(pairs(tricky), 5, 60)


def test_groups_in_pieces():
    rng = random.Random(4)
    for _ in range(200):
        values = sorted(rng.choice([1, 1, 1, 2, 3, 4, 5]) for _ in range(rng.randint(0, 60)))
        cuts = sorted(rng.randint(0, len(values)) for _ in range(4))
        batches = [pa.RecordBatch.from_arrays([pa.array(values[a:b], pa.int64())], names=["g"]) for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True)]
        got = list(jaccard_join._groups(batches, ["g"], 5))
        assert [int(x) for _, (g,) in got for x in g] == values
        seen = set()
        for continued, (g,) in got:
            own = set(g.tolist())
            assert own and (own & seen == own and len(own) == 1 if continued else not own & seen)
            seen |= own


@pytest.mark.parametrize("block", [20000, 40])
def test_star_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base = [f"b{i}" for i in range(130)]
    rows = [(0, " ".join(base))]
    for k in range(1, 90):
        w = list(base)
        w[(k * 7) % 130], w[(k * 11 + 5) % 130] = f"x{k}", f"y{k}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(base[:60] + [f"z{k}-{i}" for i in range(70)])) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_join.linked(df)) == brute(rows)


def test_few_classes_in_the_first_piece_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MANY", 8)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "10")
    try:
        rows = spark.createDataFrame([(1, c, 20, 0) for c in range(1, 13) for _ in range(5)], "h long, c long, n int, pos int")
        first = jaccard_join.first_candidates(rows, 85)
        shared = first.where("b is null").select("h", F.col("a").alias("c"), "n", "pos")
        second = jaccard_join.second_candidates(shared, spark.createDataFrame([], "node long, root long"), 85)
        found = {(r.a, r.b) for r in first.where("b is not null").select("a", "b").unionByName(second).collect()}
    finally:
        spark.conf.set(size, before)
    assert found == {(a, b) for a in range(1, 13) for b in range(a + 1, 13)}


def test_one_of_each_group(tricky, empty):
    kept = jaccard_join.one_of_each_group(tricky)
    assert kept.columns == tricky.columns
    found = brute(pairs(tricky))
    groups = {c for _, n, c in found if n}
    blank = sum(k for (_, n, _), k in found.items() if not n)
    left = [r for r in kept.collect()]
    assert len(left) == len(groups) + blank
    assert jaccard_join.one_of_each_group(empty).count() == 0
    assert jaccard_join.linked(empty).count() == 0


def test_groups_that_share_a_number_stay_apart(spark):
    text = lambda word: " ".join(f"{word}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (None, text("e")), (9, text("e") + " end"), (8, text("e")), (None, text("a"))]
    kept = jaccard_join.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(pairs(kept)) == Counter([rows[0], rows[1], rows[2], rows[3], rows[6]])


def test_query_against_brute_force(spark, sf):
    assert got(QUERIES["op1_jaccard_join"](spark, sf)) == brute(pairs(spark.read.parquet(f"{sf}/documents.parquet")))


def test_texts_above_a_slice(spark):
    rng = random.Random(12)
    long = [f"t{rng.randint(0, 10**6)}" for _ in range(170_000)]
    near = [w if k % 100 else "other" for k, w in enumerate(long)]  # about 0.92 of the shingles stay
    far = [w if k % 20 else "other" for k, w in enumerate(long)]
    rows = [(3, " ".join(long)), (2, " ".join(near)), (5, " ".join(far)), (1, " ".join(long[:1000]))]
    assert all(len(t) > 1 << 20 for i, t in rows if i != 1)
    found = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(found) == brute(rows)
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 2, 5: 5}
