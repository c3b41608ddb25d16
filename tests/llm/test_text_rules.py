from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import decontaminate, quality, secrets
from quillon.llm.registry import QUERIES


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- quality rules ----


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_base_counts(tricky, empty):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r.doc_id, *(r[c] for c in columns)) for r in quality.judge(tricky).collect())
    assert got == Counter((d, *base(t)) for d, t in pairs(tricky))
    assert quality.judge(empty).count() == 0
    assert quality.kept_documents(tricky).columns == tricky.columns
    assert not any(r.base_failed and r.kept for r in quality.judge(tricky).collect())


def test_outliers_go_and_ordinary_rows_stay(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.integers(80, 400))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(("$%&#" if k % 2 else word()) for k in range(150)), "en", "s") for i in range(10)]
    rows += [(2000 + i, " ".join("".join(rng.choice(list("etaoinshr"), 60)) for _ in range(150)), "en", "s") for i in range(10)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[i] for i in kept if i >= 1000)
    assert all(kept[i] for i in kept if i < 1000)


def estimate(x):
    """The operator's estimate for one group, step by step in numpy: location and scatter."""
    p, floors = quality.P, np.diag(np.square(quality.FLOORS))

    def median(v):
        bins = np.sort(np.floor(v * quality.PER_UNIT), axis=0)
        return (bins[(len(v) + 1) // 2 - 1] + 0.5) / quality.PER_UNIT

    def moments(rows, factor):
        return rows.mean(0), factor * np.cov(rows.T, bias=True) + floors

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    m = median(x)
    s = np.sqrt((1.4826 * median(np.abs(x - m))) ** 2 + np.square(quality.FLOORS))
    z = (x - m) / s
    bent = [np.tanh(z), z / np.sqrt(np.maximum((z * z).sum(1), 1e-12))[:, None]]
    starts = [(m, np.diag(s * s)), moments(x, 1.0), *((m, np.outer(s, s) * np.cov(u.T, bias=True) + floors) for u in bent)]
    share = quality.consistency(quality.SHARE)
    logdet = lambda c: np.linalg.slogdet(c)[1] / 2

    def step(m, c):
        bins = np.floor(np.log2(distance(m, c) + 1e-9) * quality.BINS_PER_OCTAVE)
        edge = np.sort(bins)[int(np.ceil(quality.SHARE * len(x))) - 1]
        return moments(x[bins <= edge], share)

    for _ in range(quality.TRIALS):
        starts = [step(m, c) for m, c in starts]
    m, c = min(starts, key=lambda s: round(logdet(s[1]), 9))
    for _ in range(quality.TRIALS, quality.MOST_STEPS):
        before = logdet(c)
        m, c = step(m, c)
        if abs(logdet(c) - before) <= quality.SETTLED:
            break
    return moments(x[distance(m, c) <= quality.chi2_cut(0.025, p)], quality.consistency(0.975))


def verdicts(rows):
    """doc_id, text, lang, source -> kept and squared distance, by brute force."""
    vectors, groups, out = {}, {}, []
    for k, (_, text, lang, source) in enumerate(rows):
        n, chars, symbols, lines, repeats, failed = base(text)
        if not failed:
            vectors[k] = (np.log(1 + n), np.log(chars / n), np.log(1 + 20 * symbols / n), np.sqrt((repeats + lines) / n))
            for g in ((lang, source), (lang,), ()):
                groups.setdefault(g, []).append(k)
    known = {}
    for k, (doc_id, _, lang, source) in enumerate(rows):
        g = next((g for g in ((lang, source), (lang,), ()) if len(groups.get(g, ())) >= quality.LEAST), None) if k in vectors else None
        if g is None:
            out.append((doc_id, k in vectors, None))
            continue
        if g not in known:
            known[g] = estimate(np.array([vectors[i] for i in groups[g]]))
        m, c = known[g]
        d = np.array(vectors[k]) - m
        d2 = float(d @ np.linalg.inv(c) @ d)
        out.append((doc_id, d2 <= quality.CUTOFF, d2))
    return out


@pytest.mark.parametrize("few", [20_000, 0])
def test_verdicts_against_brute_force(spark, sf, monkeypatch, few):
    """The whole query on the driver's table; with estimates broadcast, and dealt out."""
    monkeypatch.setattr(quality, "MOST_BROADCAST", few)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    want = {d: (kept, d2) for d, kept, d2 in verdicts(rows)}
    got = {r.doc_id: (r.kept, r.distance) for r in QUERIES["op2_quality_rules"](spark, sf).collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert {d: k for d, (k, _) in got.items()} == {d: k for d, (k, _) in want.items()}
    assert any(x is not None for _, x in want.values())
    for d, (_, x) in want.items():
        assert (x is None) == (got[d][1] is None) and (x is None or abs(x - got[d][1]) <= 1e-6 * (1 + x))


def test_distances_of_a_contaminated_group(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, quality.P)) @ rng.normal(size=(quality.P, quality.P)) + 3
    x[:60] += 25
    rows = [(i, "g", ["g"], *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i long, g string, pools array<string>, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    d2 = {r.i: r.d2 for r in quality.robust_distances(df).collect()}
    m, c = estimate(x)
    want = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    assert min(d2[i] for i in range(60)) > quality.CUTOFF > max(d2[i] for i in range(60, 400))
    assert np.allclose([d2[i] for i in range(400)], want, rtol=1e-6)
    assert abs(quality.chi2_tail(quality.CUTOFF, quality.P) / quality.TAIL - 1) < 1e-6


def test_quality_of_odd_tables(spark, tricky):
    plain = tricky.select("doc_id", "text", "t", "n_words", "a")
    assert quality.judge(plain).count() == tricky.count()
    long = spark.createDataFrame([(1, "some words " * 120_000), (2, "-=" * 600_000), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.kept) for r in quality.judge(long).collect()}
    assert got == {1: (240_000, 240_000, False), 2: (1, 0, False), 3: (0, 0, False)}


# ---- secrets ----


def find(text):
    text = text or ""
    spans = []
    for place, r in enumerate(secrets.RULES):
        spans += [(m.start(), place, m.end(), r.kind, r.base) for m in re.finditer(r.pattern, text, re.ASCII) if not r.group or len(m[r.group]) >= r.least_length]
    spans.sort()
    line = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k, _ in x)
    own = [s for s in spans if s[4]]
    return tuple(sum(s[3] == k for s in own) for k in ("assign", "access", "hex")) + (hashlib.sha256(line(own).encode()).hexdigest(), line(spans))


def test_secrets(tricky, empty):
    assert Counter(map(tuple, secrets.find_secrets(tricky).collect())) == Counter((d, *find(t)) for d, t in pairs(tricky))
    assert secrets.find_secrets(empty).count() == 0


@pytest.mark.parametrize("text", [
    "PASSWORD : 'abcdefghijklmn' passwd=short123 Token = \"aaaaaaaaaaaa\" API_KEY=abcdefABCDEF123 apikey:zzzzzzzzzzzzz", "AKIA" + "A" * 14 + " AKIAAKIA" + "B" * 13 + " xAKIA" + "C" * 13,
    "é🙂 secret=" + "q" * 30 + "🙂 0123456789abcdef0123456789abcdefg", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " xoxb-12345678901 eyJabcdefgh.eyJabcdefgh.abcdefgh", "token:token:token:aaaaaaaaaaaaaaa", "ſecret=aaaaaaaaaaaaaaaa toKen=bbbbbbbbbbbbbbbbb",
])
def test_secret_texts(spark, text):
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    base_patterns = [r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"]
    plain = [m.span() for m in re.finditer(base_patterns[0], text, re.ASCII) if len(m[2]) >= 12]
    assert row.n_assign == len(plain)
    assert tuple(row)[1:] == find(text)


def redact(text):
    """Stretches that any rule covers, replaced by one mark each (touching spans stay two)."""
    spans = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in find(text)[4].split(",") if x))
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_redaction_and_many_matches(spark, tricky):
    rng = np.random.default_rng(6)
    bits = ["0123456789abcdef0", "password=abcdefabcdefabcdef", "AKIA" + "Z" * 16, "é ", "plain words ", "token: 'x'", "🙂"]
    rows = [(k, "".join(f"{bits[i]} " for i in rng.integers(0, len(bits), n))) for k, n in enumerate([0, 1, 50, 127, 128, 129, 700, 3000])]
    df = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    assert Counter(map(tuple, secrets.find_secrets(df).collect())) == Counter((d, *find(t)) for d, t in [*rows, (99, None)])
    done = {r.doc_id: r.text for r in secrets.redact_documents(df, length_col="none").collect()}
    assert done == {d: redact(t) for d, t in rows} | {99: None}
    again = Counter((r.doc_id, r.text) for r in secrets.redact_documents(tricky).collect())
    assert again == Counter((d, t and redact(t)) for d, t in pairs(tricky))
    assert secrets.redact_documents(tricky).columns == tricky.columns


def test_secrets_of_long_texts(spark):
    rows = [(1, "0123456789abcdef " * 70_000), (2, "w " * 600_000 + "secret=abcdefghijklmnop"), (3, "-=" * 600_000), (None, "w"), (None, "token=aaaaaaaaaaaaaa")]
    got = {(r.doc_id, r.n_assign, r.n_hex) for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, 70_000), (2, 1, 0), (3, 0, 0), (None, 0, 0), (None, 1, 0)}


def test_every_match_passes_its_trigram_query():
    texts = ["password=abcdefghijkl", "API_KEY: 'abcdefghijkl'", "apikey=abcdefghijkl", "AKIA" + "Z" * 14, "-----BEGIN EC PRIVATE KEY-----", "ghs_" + "a" * 36, "xoxp-1234567890", "eyJabcdefgh.eyJabcdefgh.abcdefgh"]
    for r in secrets.RULES:
        clauses = secrets.trigram_query(r.pattern)
        assert bool(clauses) == (r.kind != "hex")
        for t in texts:
            if re.search(r.pattern, t):
                low = t.lower()
                assert all(any(all(g in low for g in need) for need in clause) for clause in clauses)


# ---- decontamination ----


def hits(docs, items, width=13):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = []
    for i, t in items:
        w = norm(t)
        windows += [(i, tuple(w[k : k + width])) for k in range(max(1, len(w) - width + 1))] if w else []
    out = Counter()
    for d, t in docs:
        w = norm(t)
        hit, owners = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    owners.add(i)
        digest = hashlib.sha256(",".join(sorted(owners - {None})).encode()).hexdigest()
        out[d, len(w), len(hit), len(owners), digest, len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


ITEMS = [("b1", "The quick brown fox JUMPS over"), ("a2", "the lazy dog, while seven wise owls watch from a tall tree near the old stone mill and then"), ("c3", None), ("d4", "..."), ("e5", "w1"), ("a2x", "東京"), ("b1", "quick brown"), (None, "w2 w3"), (None, "seven wise owls"), ("b1", "quick brown")]


@pytest.mark.parametrize("limit", [16 << 20, 1])
def test_decontamination(spark, tricky, empty, monkeypatch, limit):
    items = [(i, decontaminate.normal_words(t)) for i, t in dict.fromkeys(ITEMS)]
    assert len(decontaminate.compile_automata(items, limit=limit)) == (1 if limit > 1 else len({w for _, x in items for w in decontaminate.windows(x)}))
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = [*pairs(tricky)]
    got = Counter(map(tuple, decontaminate.decontaminate(tricky, bench).collect()))
    assert got == hits(docs, ITEMS)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not decontaminate.decontaminate(tricky, bench.limit(0)).where("contaminated or n_hit > 0").count()


def test_a_benchmark_in_several_passes(spark, tricky, empty, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    spans = {(r.doc_id, r.n_hit, str(r.spans)) for r in decontaminate.decontaminate(tricky, bench, spans=True).collect()}
    clean = Counter((r.doc_id, r.text) for r in decontaminate.clean_documents(tricky, bench).collect())
    monkeypatch.setattr(decontaminate, "MAX_PATTERN_BYTES", 700)
    assert len(decontaminate.passes_of(bench, 13)) > 2
    assert Counter(map(tuple, decontaminate.decontaminate(tricky, bench).collect())) == hits(pairs(tricky), ITEMS)
    assert {(r.doc_id, r.n_hit, str(r.spans)) for r in decontaminate.decontaminate(tricky, bench, spans=True).collect()} == spans
    assert Counter((r.doc_id, r.text) for r in decontaminate.clean_documents(tricky, bench).collect()) == clean
    assert decontaminate.clean_documents(tricky, bench).columns == tricky.columns
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_contamination_of_long_texts(spark):
    long = "w " * 600_000 + "the quick brown fox jumps over " + "w " * 10
    docs = spark.createDataFrame([(1, long), (2, long.replace("quick", "slow")), (3, "-=" * 600_000)], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "the quick brown fox jumps over")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (600_016, 6, False), 2: (600_016, 0, False), 3: (0, 0, False)}


def test_benchmark_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "seven wise owls"), (3, "nothing here")], "doc_id long, text string")
    items = [(None, "quick brown fox"), (None, "fox jumps"), ("a", "brown fox"), ("a", "fox"), (None, "seven wise owls"), (None, None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == {1: (4, 2, digest("a"), True), 2: (3, 1, digest(""), True), 3: (0, 0, digest(""), False)}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()] == [3]


def test_offsets_point_into_the_original(spark):
    text = "Zwölf! The QUICK-brown fox; jumps... over — and on"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "the quick brown fox jumps over")], "item_id string, text string")
    (span,) = decontaminate.decontaminate(docs, bench, spans=True).first().spans
    assert text[span.start : span.end] == "The QUICK-brown fox; jumps... over"


def test_decontamination_query(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = Counter(map(tuple, QUERIES["op9_decontaminate"](spark, sf).collect()))
    assert got == hits(pairs(docs), [(str(r.item_id), r.text) for r in bench.collect()])
