from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import floor, inf, nan

import numpy as np
import pytest

from quillon.llm import filter_audit, url_filter, whitening
from quillon.llm.registry import QUERIES

# ---- whitening ----


def exact(vectors):
    """x, n, S, the deviations and the covariance, in whole numbers and fractions."""
    x = [[floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dims)]
    d = [[n * a - b for a, b in zip(r, s, strict=True)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(dims)] for i in range(dims)])
    return n, s, d, [sum(e * e for e in r) for r in d], v


def held(spark, rows, found, most=8):
    """The operator's rows against the exact ones; signs are free."""
    n, _, d, far, v = exact([v for _, v in rows])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    want = (np.array([[float(Fraction(e, n)) for e in r] for r in d]) @ vectors) / np.sqrt(values)
    got = {(r.vec_id, r.component): r for r in found.collect()}
    assert len(got) == n * len(values)
    signs = [1 if got[rows[0][0], k + 1].whitened * want[0, k] > 0 else -1 for k in range(len(values))]
    for i, (vec_id, _) in enumerate(rows):
        for k in range(len(values)):
            r = got[vec_id, k + 1]
            assert r.n == n and r.deviation == far[i] and r.deviation_text == str(far[i])
            assert r.whitened == pytest.approx(signs[k] * want[i, k], rel=1e-9, abs=1e-9)
            assert r.explained == pytest.approx(values[k] / np.trace(v), rel=1e-12)
            assert r.identity_error <= 1e-9


def test_whitening_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(spark, rows, QUERIES["op11_whitening"](spark, sf))


@pytest.mark.parametrize("tile, block", [(256, 8192), (2, 3)])
def test_covariance_is_exact(spark, monkeypatch, tile, block):
    """Bit for bit, with entries that need several primes, over tiles and blocks."""
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(57, 5)) * [1, 1e3, 1e6, 1e-3, 30] + [0, 1e7, 5, 0, -1e9]).tolist()
    rows = whitening.usable(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(7))
    m = whitening.moments(rows)
    n, s, _, _, v = exact(vectors)
    assert (m.n, m.sums) == (n, s) and len(m.moduli()) > 4
    assert (whitening.covariance(rows, m) == v).all()


def test_remainders():
    rng = np.random.default_rng(2)
    values = [int(a) * int(b) * int(c) for a, b, c in rng.integers(-(2**31), 2**31, (200, 3))] + [0, 1, -1]
    moduli = whitening.primes(2 * max(map(abs, values)))
    assert all(p < 1 << 20 and all(p % q for q in range(2, 1025)) for p in moduli) and len(set(moduli)) == len(moduli)
    assert whitening.rebuilt([np.array([v % p for v in values]) for p in moduli], moduli).tolist() == values


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    fine = [(i, rng.normal(size=3).tolist()) for i in range(20)]
    fine += [(30 + i, fine[0][1]) for i in range(5)]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, nan, 2.0]), (53, [inf, 0.0, 0.0]), (54, [1.0, 2.0]), (55, []), (56, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in fine + odd], "vec_id long, embedding array<double>, v string, n int").repartition(4)
    held(spark, fine, whitening.whiten(df))
    twice = whitening.whiten(spark.createDataFrame([(None, [0.5, 1.0]), (None, [1.5, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    assert Counter((r.vec_id, r.component) for r in twice.collect()) == {(None, 1): 2, (None, 2): 2, (1, 1): 2, (1, 2): 2}
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in same] == [(None, None, None, 0)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    for rows in ([], [(1, None)], [(1, [])]):
        none = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert none.count() == 0 and none.columns == [c.split()[0] for c in whitening.RESULT.split(", ")]


def test_deviations_beyond_a_long(spark):
    vectors = [(i, [float(i) * 2**40, -float(i * i)]) for i in range(40)]
    far = exact([v for _, v in vectors])[3]
    got = {(r.deviation, r.deviation_text) for r in whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert got == {(f if f < 2**63 else None, str(f)) for f in far} and any(f >= 2**63 for f in far)


# ---- URL filters ----


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*)(?s:.*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def judged(url, rules, default="allow"):
    host, path = split(url)
    fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


URLS = [
    None, "", "example.com/en/", "http://", "https://Example.COM/en/a?x#y", "http://www.example.com/en/", "http://notexample.com/en/x", "https://a.b.www.example.com/en/q/r", "ftp://x.net/es/y", "http://NET/fr/",
    "http://x.net/de/", "http://x.com?a=/en/", "http://x.com", "http://com/", "http://x.com#/", "a://b://x.com/en/", "http://com./", "http://.com/", "http://user@x.com:80/", "http://ÉA.com/é/ß", "http://x.net//fr/",
    "http://x.net/fr", "http://x.net/fr/\nnext", "http://x.org/" + "a/" * 30_000, "http://" + "a." * 5_000 + "net/es/", "http://x.com/en/../fr/",
]
MORE = [
    ("block", "org", "/a/a/"), ("allow", "org", "/a/a/a"), ("block", "a.a.net", "/es/"), ("allow", "x.com", ""), ("block", "X.com", "/en/.."), ("block", "x.com", "/en/.."), ("allow", "x.com", "/en/.."), ("block", "", ""),
    ("allow", "com.", "/"), ("block", "b:", "/"), ("block", "xÉ.com", "/"),
]


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
@pytest.mark.parametrize("rules", [url_filter.RULES, url_filter.RULES + MORE, []])
def test_urls(spark, monkeypatch, broadcast, rules):
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", broadcast)
    rows = [(None if i % 5 == 4 else i % 17, u, "x", 1) for i, u in enumerate(URLS * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, part int").repartition(3)
    table = spark.createDataFrame(rules, url_filter.RULE)
    lowered = [(v, h.translate(str.maketrans(url_filter.CAPITALS, url_filter.SMALL)), p) for v, h, p in rules]
    got = Counter(tuple(r) for r in url_filter.judge_urls(df, table, default="unknown").collect())
    assert got == Counter((r[0], *judged(r[1], lowered, "unknown")) for r in rows)
    assert url_filter.judge_urls(df.limit(0), table).count() == 0


def test_many_rules_against_brute_force(spark, sf):
    urls = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    rng = np.random.default_rng(5)
    rules = []
    for _, url in urls:
        host, path = split(url)
        names = host.split(".")
        rules.append((str(rng.choice(["allow", "block"])), ".".join(names[-rng.integers(1, len(names) + 1) :]), path[: rng.integers(0, len(path) + 1)]))
    rules = [(max(v for v, h, p in rules if (h, p) == key), *key) for key in {(h, p) for _, h, p in rules}]
    got = Counter(tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, url_filter.RULE)).collect())
    assert got == Counter((i, *judged(u, rules)) for i, u in urls)


# ---- filter audit ----


def failing(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals, symbols = len(re.findall("[A-Z]", text)), re.search("[#$%&*|]", text)
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), symbols is not None, copy)
    return {f for f, t in zip("ABCDE", tests, strict=True) if t}


def audited(rows, labels):
    """rows of doc_id, part, text: every order walked through, document by document."""
    first = {}
    for i, _, text in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = [(p or "", failing(t or "", i is not None and i > first[t or ""]), i) for i, p, t in rows]
    marked = [{i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1)]
    out = {}
    for part in {p for p, _, _ in docs}:
        removed = Counter()
        for order in permutations("ABCDE"):
            left = [(f, i) for p, f, i in docs if p == part]
            for step, x in enumerate(order, 1):
                gone = [(f, i) for f, i in left if x in f]
                left = [(f, i) for f, i in left if x not in f]
                own = [f for p, f, _ in docs if p == part and x in f]
                removed[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(own) - len(gone), sum(f == {x} for f in own), *(sum(i in m for _, i in gone) for m in marked)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit(spark, tricky):
    rows = [tuple(r) for r in tricky.select("doc_id", "source", "text").collect()]
    rng = np.random.default_rng(9)
    labels = [(int(i), *(None if rng.random() < 0.1 else int(rng.integers(0, 2)) for _ in range(2))) for i in range(0, 180) for _ in range(1 + i % 2)] + [(None, 1, 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in labels], "doc_id long, quality int, toxic int, part string, n int")
    got = [tuple(r) for r in filter_audit.audit(tricky, table).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, labels)
    none = filter_audit.audit(tricky, table.limit(0)).where("good_lost + toxic_lost > 0")
    assert none.count() == 0 and filter_audit.audit(tricky.limit(0), table).count() == 0


def test_audit_of_long_texts_and_many_copies(spark):
    long = " ".join(f"w{i % 7}" for i in range(300_000))
    rows = [(i % 40, "hot", "Same Text") for i in range(400)] + [(None, "hot", "Same Text")] * 50 + [(500, "b", long), (499, None, long), (501, "b", None), (502, "", "")]
    got = {tuple(r) for r in filter_audit.audit(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6), spark.createDataFrame([(0, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")).collect()}
    assert got == audited(rows, [(0, 1, 0), (7, 0, 1)])
