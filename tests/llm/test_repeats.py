from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import repeats, substring_dedup, suffix_dedup
from quillon.llm.registry import QUERIES


def remove_bytes(rows, width=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(raw[k : k + width] for _, raw in raws for k in range(len(raw) - width + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if counts[raw[k : k + width]] > 1:
                gone[k : k + width] = b"\x01" * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def remove_words(rows, width=20):
    texts = [(i, t, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: (i is not None, i or 0)
    least = {}
    for i, _, w in texts:
        for k in range(len(w) - width + 1):
            key, at = tuple(w[k : k + width]), (order(i), k)
            least[key] = min(least.get(key, at), at)
    out = []
    for i, _, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < (order(i), k):
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def got(df):
    return Counter(map(tuple, df.drop("kept").collect()))


def test_suffix_array_of_random_sequences():
    rng = random.Random(1)
    for _ in range(300):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))] + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(200):
        known = [[rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        automaton = substring_dedup.SuffixAutomaton()
        for sequence in known:
            automaton.add(sequence)
        stretches = {tuple(s[a:b]) for s in known for a in range(len(s) + 1) for b in range(a, len(s) + 1)}
        text = [rng.randint(1, 4) for _ in range(20)]
        want = [max(n for n in range(e + 2) if n == 0 or tuple(text[e + 1 - n : e + 1]) in stretches) for e in range(len(text))]
        assert automaton.matching(text) == want


@pytest.mark.parametrize("most", [2000, 2])
def test_operators_on_odd_rows(tricky, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_CONTENTS", most)
    rows = [r for r in pairs(tricky) if r[0] != 7] + [(7, pairs(tricky.where("doc_id = 7"))[0][1])] * 2
    assert got(suffix_dedup.remove_repeats(tricky)) == remove_bytes(rows)
    assert got(substring_dedup.remove_earlier(tricky)) == remove_words(rows)


def test_empty_table(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_earlier(empty).count() == 0


def test_queries_against_brute_force(spark, sf):
    rows = pairs(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got(QUERIES["op4_suffix_dedup"](spark, sf)) == remove_bytes(rows)
    assert got(QUERIES["op5_substring_dedup"](spark, sf)) == remove_words(rows)


def odd_texts():
    """One passage in many surroundings, periodic texts, and a text of more than a piece of units."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(n))
    passage = prose(45)
    rows = [(k, f"{prose(rng.randint(5, 40))} {passage} {prose(rng.randint(5, 40))}") for k in range(60)]
    rows += [(100, "-=" * 1500), (101, "ab cd ef " * 300), (102, "x " + "ab cd ef " * 100), (103, "a" * 700), (104, (prose(60) + " ") * 4), (105, "é" * 350)]
    return rows + [(106, prose(900) + " " + passage + " " + "z " * 300)]


@pytest.mark.parametrize(("most", "piece"), [(2000, 1 << 20), (3, 1 << 20), (5, 700)])
def test_common_passages_and_periods(spark, monkeypatch, most, piece):
    monkeypatch.setattr(repeats, "MOST_CONTENTS", most)
    monkeypatch.setattr(repeats, "PIECE", piece)
    df = spark.createDataFrame(odd_texts(), "doc_id long, text string").repartition(4)
    assert got(suffix_dedup.remove_repeats(df)) == remove_bytes(odd_texts())
    assert got(substring_dedup.remove_earlier(df)) == remove_words(odd_texts())


def test_runs_of_a_period_are_folded():
    raw = np.frombuffer(b"-=" * 100_000, dtype=np.uint8)
    row, first, last, _, _, _, count = repeats.runs(raw, np.array([0, len(raw)]), 200, 20)
    assert len(row) < 20 and last[-1] == len(raw) - 200 and first[0] == 0
    assert count.sum() > 90_000


def test_array_decides_as_sorting_does():
    rng = random.Random(3)
    for _ in range(60):
        payloads = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) * rng.randint(1, 2) for _ in range(rng.randint(1, 6))]
        owner, start, same, _ = suffix_dedup.sorted_windows(payloads, 12)
        windows = [payloads[o][s : s + 12] for o, s in zip(owner.tolist(), start.tolist(), strict=True)]
        assert len(windows) == sum(max(0, len(p) - 11) for p in payloads)
        assert len({w for w in windows}) == len(windows) - int(same.sum())
        assert all(a == b for a, b, s in zip(windows, windows[1:], same[1:].tolist(), strict=False) if s)


def test_a_text_above_a_slice(spark):
    rng = random.Random(5)
    long = " ".join(f"u{rng.randint(0, 10**7)}" for _ in range(170_000))
    part = long[700_000:701_000]
    rows = [(1, long), (2, "start " + part + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 1 << 20
    by_bytes = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert (by_bytes[1].n_removed, by_bytes[1].n_spans, by_bytes[2].n_removed) == (1000, 1, 1000)
    by_words = {r.doc_id: r for r in substring_dedup.remove_earlier(df).collect()}
    assert by_words[1].n_removed == 0 and by_words[2].n_removed >= len(part.split()) - 2


@pytest.mark.parametrize(("most", "piece"), [(2000, 1 << 20), (1, 1 << 20), (3, 250)])
def test_shared_anchors_without_repeats(spark, monkeypatch, most, piece):
    """Passages that share anchors but are shorter than a window, alone and beside real repeats, in random tables."""
    monkeypatch.setattr(repeats, "MOST_CONTENTS", most)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = random.Random(most + piece)
    prose = lambda n: " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(n))
    for repeated in (False, True):
        short = [prose(40)[: rng.randint(120, 190)] for _ in range(6)]
        rows = [(k, " ".join(rng.choice([prose(rng.randint(3, 60)), rng.choice(short)]) for _ in range(rng.randint(1, 7)))) for k in range(40)]
        if repeated:
            rows += [(100 + k, f"{prose(20)} {rows[k][1]} {prose(9)}") for k in range(4)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert got(suffix_dedup.remove_repeats(df)) == remove_bytes(rows)
        assert got(substring_dedup.remove_earlier(df)) == remove_words(rows)


def test_two_texts_that_share_an_anchor_alone(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = letters(150)
    rows = [(1, letters(400) + passage + letters(400)), (2, letters(300) + passage + letters(500))]
    assert got(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == remove_bytes(rows)
