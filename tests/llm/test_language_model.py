from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest

from quillon.llm import language_model
from quillon.llm.registry import QUERIES


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def brute(rows):
    """The same model by dictionaries."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    pair, uni = Counter(), Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            w = words(t)
            uni.update(w)
            pair.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    before = Counter(b for _, b in pair)
    total, after = Counter(), {}
    for (a, _), c in pair.items():
        total[a] += c
        after.setdefault(a, Counter())[min(c, 3)] += 1
    counts = lambda x: [sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]
    big, small = [0, *language_model.discounts(*counts(pair))], [0, *language_model.discounts(*counts(before))]
    rest = sum(small[min(c, 3)] for c in before.values()) / len(pair) if pair else 1.0

    def low(w):
        b = before[w]
        return max(b - small[min(b, 3)], 0) / max(len(pair), 1) + rest / (v + 1)

    def p(a, w):
        if not total[a]:
            return low(w)
        c = pair[a, w]
        g = sum(big[k] * x for k, x in after[a].items()) / total[a]
        return max(c - big[min(c, 3)], 0) / total[a] + g * low(w)

    out = []
    for (d, t), h in zip(rows, held, strict=True):
        w = words(t)
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((d, h, len(w), sum(uni[x] > 0 for x in w), n, base, sum(math.log10(p(a, x)) for a, x in zip(["<s>", *w], w, strict=False))))
    return out, p, uni, total


def same(df, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, df.drop("perplexity").collect()), key=key), sorted(brute(rows)[0], key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_odd_rows(tricky, empty):
    same(language_model.score_documents(tricky), pairs(tricky))
    assert language_model.score_documents(empty).count() == 0


def test_no_training_rows(spark):
    rows = [(d, "some words") for d in range(60) if zlib.crc32(str(d).encode()) % 5 == 1]
    same(language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_probabilities_sum_to_one(tricky):
    _, p, uni, total = brute(pairs(tricky))
    for context in list(total)[:20]:
        assert sum(p(context, w) for w in uni) + p(context, "never seen") == pytest.approx(1)


def test_query_against_brute_force_and_base(spark, sf):
    df = QUERIES["op3_lm_scoring"](spark, sf)
    same(df, pairs(spark.read.parquet(f"{sf}/documents.parquet")))
    held = df.where("held_out").groupBy().sum("base_score", "score").first()
    assert held[1] > held[0]


def test_pairs_seen_255_times_and_more(spark):
    rows = [(k, " ".join([f"a{k} b{k}"] * n + ["c d"] * (n - 1) + ["e"])) for k, n in enumerate((254, 255, 256, 1000, 3, 70_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(language_model.score_documents(df), rows)


def brute_order(rows, order):
    """Scores at any order, by dictionaries: one for each length, the shorter ones filled with the distinct grams one word longer."""
    whole = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            w = [*["<s>"] * (order - 1), *words(t)]
            whole.update(zip(*(w[k:] for k in range(order)), strict=False))
    value = {order: whole}
    for k in range(order - 1, 0, -1):
        value[k] = Counter(g[1:] for g in value[k + 1])
    cut = {k: [0, *language_model.discounts(*[sum(c == j for c in x.values()) for j in (1, 2, 3, 4)])] for k, x in value.items()}
    total, kept = Counter(), Counter()
    for k, x in value.items():
        for g, c in x.items():
            total[g[:-1]] += c
            kept[g[:-1]] += cut[k][min(c, 3)]
    known = len(value[1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (known + 1)
        context, c = gram[:-1], value[k][gram]
        if not total[context]:
            return p(gram[1:]) if k > 1 else p(())
        return max(c - cut[k][min(c, 3)], 0) / total[context] + kept[context] / total[context] * p(gram[1:])

    out = []
    for d, t in rows:
        w = [*["<s>"] * (order - 1), *words(t)]
        out.append((d, sum(math.log10(p(g)) for g in zip(*(w[k:] for k in range(order)), strict=False))))
    return out, p, value


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_of_an_order(tricky, order):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(map(tuple, language_model.score_documents(tricky, order=order).select("doc_id", "score").collect()), key=key)
    want, p, value = brute_order(pairs(tricky), order)
    want.sort(key=key)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)
    for g in list(value[order])[:10]:
        assert sum(p((*g[:-1], *w)) for w in value[1]) + p((*g[:-1], "never seen")) == pytest.approx(1)


def test_more_shards_than_tasks(tricky, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_BYTES", 16)
    monkeypatch.setattr(language_model, "TASK_BITS", 2)
    same(language_model.score_documents(tricky), pairs(tricky))


@pytest.mark.parametrize("order", [2, 3])
def test_tasks_of_many_shards_and_flushes(tricky, monkeypatch, order):
    """Rows of grams and of shorter grams that are cut into shards, in several flushes."""
    plain = language_model.score_documents(tricky, order=order).select("doc_id", "score")
    for name, value in (("SHARD_BYTES", 64), ("TASK_BITS", 1), ("FLUSH_TOKENS", 500)):
        monkeypatch.setattr(language_model, name, value)
    cut = language_model.score_documents(tricky, order=order).select("doc_id", "score")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got, want = (sorted(map(tuple, df.collect()), key=key) for df in (cut, plain))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


def test_rows_of_the_exchange_do_not_follow_the_shards(tricky, monkeypatch):
    """A flush gives a row for each task at most, however many shards there are; each pair is in the part of its hash."""
    texts = tricky.coalesce(2)
    rows = language_model.counted(texts, 2).collect()
    assert len(rows) <= 2 * 4 and {r.part for r in rows} == {0, 1, 2, 3}
    counts = sum(sum(memoryview(bytes(r[-1])).cast("I")) for r in rows)
    assert counts == sum(len(words(t)) for _, t in pairs(tricky))
    monkeypatch.setattr(language_model, "SHARD_BYTES", 16)
    monkeypatch.setattr(language_model, "TASK_BITS", 2)
    asked, plain = [], language_model.counted
    monkeypatch.setattr(language_model, "counted", lambda texts, bits, order: asked.append(bits) or plain(texts, bits, order))
    language_model.score_documents(tricky)
    assert asked == [2]


def test_counts_beyond_32_bits(tmp_path):
    """What a shard file is given is what a worker reads."""
    import numpy as np

    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64))
    counts = np.array([1, 254, 255, 256, 70_000, (1 << 32) - 1, 1 << 32, (1 << 40) + 7, *range(42)], dtype=np.uint64)
    file = language_model.ShardFile(str(tmp_path), "grams2")
    file.add(0, 0, keys, [(counts, np.uint8)])
    file.close()
    table = language_model.Table(str(tmp_path), "grams2", {0}, 1, 0, language_model.columns_of(2, 2))
    got = table.find(np.concatenate([keys[::-1], np.array([5], dtype=np.uint64)]))
    assert got[0].tolist() == [*counts[::-1].tolist(), 0]
    wide = language_model.ShardFile(str(tmp_path), "grams1")
    columns = language_model.columns_of(1, 2)
    wide.add(0, 0, keys, [(counts * np.uint64(3), kind) for _, kind in columns])
    wide.close()
    for column in language_model.Table(str(tmp_path), "grams1", {0}, 1, 0, columns).find(keys):
        assert column.tolist() == (counts * np.uint64(3)).tolist()


def test_texts_above_a_slice(spark):
    import random

    rng = random.Random(4)
    rows = [(k, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))) for k, n in enumerate((230_000, 50, 240_000, 3))]
    assert len(rows[0][1]) > 1 << 20
    same(language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")), rows)
