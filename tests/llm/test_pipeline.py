from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from test_jaccard_join import brute
from test_text_rules import redact, verdicts

from quillon.llm import decontaminate, jaccard_join, quality, secrets
from quillon.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), "test"))
    return out


def test_all_but_the_last_return_the_documents_columns(steps):
    assert all(x.dtypes == steps[0].dtypes for x in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(steps) == 6


def test_each_stage_on_its_own_input(spark, sf, steps):
    docs, good, alone, clean, safe, encoded = steps
    judged = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == judged
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in alone.collect()} == {c for (_, n, c) in brute(rows) if n}
    bad = {r.doc_id for r in decontaminate.decontaminate(alone, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in alone.collect()} - bad
    before = {r.doc_id: r for r in clean.collect()}
    for r in safe.collect():
        text = before[r.doc_id].text
        spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, text) if not rule.group or len(m[rule.group]) >= rule.least_length)
        want, at = "", 0
        for s, e in spans:
            if s >= at:
                want += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert r.text == want + text[at:] and r.n_chars == len(r.text)
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in encoded.collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}


def test_near_duplicates_states_its_parameters(spark, tricky, monkeypatch):
    asked = {}
    monkeypatch.setattr(jaccard_join, "one_of_each_group", lambda docs, **own: asked.update(own) or docs)
    corpus_pipeline.near_duplicates(spark, tricky, "")
    assert asked == {"words": 4, "percent": 85}


def test_run_is_the_stages(spark, sf, steps):
    assert sorted(corpus_pipeline.run(spark, sf).drop("ids").collect()) == sorted(steps[-1].drop("ids").collect())


def test_odd_rows(spark, tricky, empty, tmp_path):
    """Each stage on rows with nulls, blanks, repeats and clashing columns, against brute force."""
    spark.createDataFrame([("i", "never there at all")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    steps = [tricky]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], str(tmp_path)), "odd"))
    _, good, alone, clean, safe, encoded = steps
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in tricky.collect()]
    assert held(good) == Counter((d, t) for (d, t, _, _), (_, kept, _) in zip(rows, verdicts(rows), strict=True) if kept)
    assert held(alone) <= held(good) and set(held(alone).values()) == {1}
    assert held(clean) == held(alone)
    assert held(safe) == Counter({(d, redact(t)): n for (d, t), n in held(clean).items()})
    assert Counter(r.decoded_sha256 for r in encoded.collect()) == Counter(hashlib.sha256(t.encode()).hexdigest() for (_, t), n in held(safe).items() for _ in range(n))
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "odd")
    assert docs.count() == 0
