"""What keeps an index usable as it grows: appends, lists, codes, graph, batches, commits, runs."""

from __future__ import annotations

import os
import random
import threading
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.index import VectorIndex
from quillon.operators import ann, graph, maintain, search
from quillon.plans import catalogue_queries, index_queries  # noqa: F401  the first registers the second
from quillon.sources import discover, snapshots
from quillon.sources.media import BatchEmbedder, HashingEmbedder, TableEmbedder, embed_rows
from quillon.sources.scratch import Scratch
from quillon.sources.snapshots import Catalogue, Change, CommitConflict

DIMS = 16


class Given:
    """Vectors that come with the items."""

    dims = DIMS

    def embed_rows(self, items, keep=()):
        return items.select("item", *keep, F.col("vector").alias("embedding"))


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def drawn(seed, n, around, spread=0.35):
    """n unit vectors about given places."""
    rng = np.random.default_rng(seed)
    return unit(around[rng.integers(0, len(around), n)] + spread * rng.normal(size=(n, DIMS)))


def places(seed, n):
    return unit(np.random.default_rng(seed).normal(size=(n, DIMS)))


def items(spark, matrix, name):
    rows = [(f"/{name}/{i:06d}.jpg", f"{name}{i}", v.tolist()) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "file_path string, item string, vector array<float>")


def walked(top):
    return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def table_of(spark, matrix):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vector_id long, embedding array<float>")


def hits(got, matrix, asked, k):
    exact = {q: set(np.argsort(-(matrix @ matrix[q]), kind="stable")[:k].tolist()) for q in asked}
    found = Counter(r.query_id for r in got if r.vector_id in exact[r.query_id])
    return sum(found.values()) / (k * len(asked))


# ---- appends, lists ----


def test_an_append_writes_one_segment(spark, tmp_path):
    index = VectorIndex(Catalogue(spark, str(tmp_path)), "a", Given(), "ivf", {"nlist": 20})
    index.add_items(items(spark, drawn(1, 2000, places(1, 12)), "first"))
    q = drawn(2, 1, places(1, 12))[0].tolist()
    index.search_vector(q, 5)
    trained, before = index.store.log_of("ivf").numbers(), walked(tmp_path / "a")
    index.add_items(items(spark, drawn(3, 60, places(1, 12)), "more"))
    found = {r.vector_id for r in index.search_vector(q, 2060, nprobe=20).collect()}
    assert len(found) == 500 + 1560 and index.store.log_of("ivf").numbers() == trained
    new = walked(tmp_path / "a") - before
    rows = {kind: sum(pq.ParquetFile(f).metadata.num_rows for f in new if f"/{kind}" in f.replace("/ivf_vectors", "/lists")) for kind in ("vectors", "records", "lists")}
    assert rows == {"vectors": 60, "records": 60, "lists": 60} and not before - walked(tmp_path / "a")


def test_recall_after_ten_appends_of_another_kind(spark, tmp_path):
    index = VectorIndex(Catalogue(spark, str(tmp_path)), "d", Given(), "ivf", {"nlist": 20})
    parts = [drawn(1, 2000, places(1, 12))]
    index.add_items(items(spark, parts[0], "p00"))
    index._lists()
    for k in range(10):
        parts.append(drawn(50 + k, 200, places(9, 12)))
        index.add_items(items(spark, parts[-1], f"p{k + 1:02d}"))
    model, rows = index._lists()
    assert index.store.log_of("ivf").numbers()[-1] == 2  # rows had drifted from the centres
    matrix = np.concatenate(parts)
    asked = list(range(0, len(matrix), 40))
    queries = table_of(spark, matrix).where(F.col("vector_id").isin(asked)).withColumnRenamed("vector_id", "query_id")
    assert len(asked) == 100 and hits(index.search_batch(queries, 20).collect(), matrix, asked, 20) >= 0.9


def test_drift():
    notes = {"loss": 0.2, "rows": 1000}
    assert not ann.drifted(notes, [{"rows": 1000, "loss": 0.2}, {"rows": 50, "loss": 0.3}])
    assert ann.drifted(notes, [{"rows": 1000, "loss": 0.2}, {"rows": 500, "loss": 0.4}])
    assert ann.drifted(notes, [{"rows": 5000, "loss": 0.2}]) and not ann.drifted(notes, [{"rows": 5000, "loss": 0.2}], fixed_lists=True)
    assert ann.lists_for(10) == 100 and ann.lists_for(10**8) == 10**4


@pytest.mark.parametrize("flat", [1024, 4])
def test_a_hot_cluster_is_cut(spark, tmp_path, monkeypatch, flat):
    """Nine tenths of the rows in one place: no task writes a large share of them."""
    monkeypatch.setattr(ann, "FLAT_LISTS", flat)
    monkeypatch.setattr(ann, "CELL_ROWS", 500)
    rng = np.random.default_rng(4)
    hot = np.repeat(places(3, 1), 18_000, axis=0) + 0.001 * rng.normal(size=(18_000, DIMS))
    matrix = np.concatenate([unit(hot), drawn(5, 2000, places(6, 10))])
    rows = table_of(spark, matrix).repartition(40)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        model = ann.Ivf.train(rows, 30)
        assert (model.coarse is None) == (flat == 1024) and (flat == 1024 or abs(len(model.centers) - 30) <= 10)
        model.dealt(model.measured(rows)).write.partitionBy(*model.folders()).parquet(f"{tmp_path}/lists")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in walked(tmp_path / "lists")]
    tasks = Counter(os.path.basename(f).split("-")[1] for f in walked(tmp_path / "lists"))
    assert sum(sizes) == 20_000 and max(sizes) <= 3000 and len(tasks) >= 8
    again = ann.Ivf.load(model.table(spark))
    assert (again.lists(matrix[::37]) == model.lists(matrix[::37])).all()
    assert {r.vector_id for r in model.search(model.assign(rows), matrix[19_000].tolist(), 5).collect()} >= {19_000}


def test_sample_by_a_threshold(spark):
    rows = spark.range(50_000).select(F.col("id").alias("vector_id"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    first = sorted(r.vector_id for r in rows.orderBy(F.xxhash64("vector_id"), "vector_id").limit(500).collect())
    got = ann.sampled(rows, 500)
    assert sorted(r.vector_id for r in got.collect()) == first
    assert "<=" in got._jdf.queryExecution().optimizedPlan().toString()
    assert ann.sampled(rows.limit(0)).count() == 0


def test_codes_of_differences_find_more(spark):
    """The same refine: the share of the exact best 20 among the candidates, over 100 queries."""
    matrix = drawn(7, 3000, places(8, 30), 0.2)
    rows, asked = table_of(spark, matrix), range(0, 3000, 30)
    plain, inner = ann.Pq.train(rows, 4, 4), ann.Pq.train(rows, 4, 4, nlist=30)

    def recall(model):
        codes, hit = model.codes(matrix), 0
        for q in asked:
            rough = sum(t[c] for t, c in zip(model.tables(matrix[q]), codes.T, strict=True))
            hit += np.isin(np.argsort(-(matrix @ matrix[q]), kind="stable")[:20], np.argsort(-rough, kind="stable")[:40]).sum()
        return hit / (20 * len(asked))

    assert recall(inner) > recall(plain) + 0.05
    encoded, q = inner.encode(rows), matrix[11].tolist()
    assert inner.search(encoded, q, 5, nprobe=30).first().vector_id == 11
    with pytest.raises(ValueError, match="divide"):
        ann.Pq.train(rows, 5, 4)


# ---- graph ----


def test_graph_recall(spark):
    """100 queries of the driver's vectors; how much of the table is scored is measured."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("vector_id"), "embedding")
    rows = df.orderBy("vector_id").collect()
    matrix, asked = np.array([r.embedding for r in rows], dtype=float), list(range(0, 2000, 20))
    with Scratch(spark) as scratch:
        edges = graph.build(df, scratch)
        near = {(r.src, r.dst) for r in edges.collect()}
        exact = [(i, j) for i in range(0, 2000, 10) for j in np.argsort(-(matrix @ matrix[i]), kind="stable")[1:11].tolist()]
        assert sum(e in near for e in exact) >= 0.85 * len(exact)
        queries = df.where("vector_id % 20 = 0").withColumnRenamed("vector_id", "query_id")
        scored = graph.walk(edges, df, queries, scratch)
        assert scored.count() == scored.select("query_id", "vector_id").distinct().count()
        share = scored.count() / (100 * 2000)
        recall = hits(search.best_of(scored, 20).collect(), matrix, asked, 20)
        print(f"graph: recall {recall:.3f}, share scored {share:.3f}")
        assert recall >= 0.9 and share < 0.75
        folder = scratch.folder
    assert not os.path.exists(folder.removeprefix("file:"))


def test_the_beam_of_a_walk_is_fitted(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("vector_id"), "embedding")
    matrix, asked = np.array([r.embedding for r in df.orderBy("vector_id").collect()], dtype=float), list(range(0, 2000, 20))
    monkeypatch.setattr(graph, "ENTRIES", 20)
    monkeypatch.setattr(graph, "BEAM", 8)
    monkeypatch.setattr(graph, "WIDTH", 2)
    queries = df.where("vector_id % 20 = 0").withColumnRenamed("vector_id", "query_id")
    with Scratch(spark) as scratch:
        edges = graph.build(df, scratch, rounds=2)
        assert hits(graph.search(edges, df, queries, scratch, 5, 8).collect(), matrix, asked, 5) < 0.9
        beam = graph.fitted(edges, df, scratch, 5)
        assert beam > 8
        assert hits(graph.search(edges, df, queries, scratch, 5, beam).collect(), matrix, asked, 5) >= 0.9


def test_graph_of_few_and_odd_vectors(spark):
    kind = "vector_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0])], kind)
    with Scratch(spark) as scratch:
        assert {(r.src, r.dst) for r in graph.build(df, scratch).collect()} == {(a, b) for a in (1, 2, 4) for b in (1, 2, 4) if a != b}
        none = graph.build(df.limit(0), scratch)
        assert none.count() == 0
        got = graph.search(none, df, spark.createDataFrame([(9, [1.0, 0.1]), (8, None)], "query_id long, embedding array<float>"), scratch, 2)
        assert [(r.query_id, r.vector_id, r["rank"]) for r in got.orderBy("rank").collect()] == [(9, 1, 1), (9, 2, 2)]


def test_graph_in_parts(spark, monkeypatch):
    """Several parts and blocks of queries; a walk stores nothing, whatever its rounds, and a row that no part links comes up by its entry."""
    monkeypatch.setattr(graph, "GRAPH_ROWS", 300)
    monkeypatch.setattr(graph, "BLOCK_BYTES", 4000)
    matrix, asked = drawn(5, 2000, places(5, 40)), list(range(0, 2000, 20))
    rows = table_of(spark, matrix)
    queries = rows.where("vector_id % 20 = 0").withColumnRenamed("vector_id", "query_id")
    with Scratch(spark) as scratch:
        edges = graph.build(rows, scratch)
        part = F.pmod(F.xxhash64("id"), F.lit(7))
        ends = [edges.select(F.col(c).alias("id")).select(part).collect() for c in ("src", "dst")]
        assert ends[0] == ends[1] and {r[0] for r in ends[0]} == set(range(7))
        beam, stored = graph.fitted(edges, rows, scratch, 10), scratch.n
        found = graph.search(edges, rows, queries, scratch, 10, beam)
        got = found.collect()
        assert scratch.n == stored
        assert hits(got, matrix, asked, 10) >= 0.95 and len(got) == 1000
        exact = matrix.astype(np.float32).astype(float)
        assert max(abs(r.score - exact[r.query_id] @ exact[r.vector_id]) for r in got) < 1e-12
        alone = spark.createDataFrame([(5000, matrix[0].tolist())], "vector_id long, embedding array<float>")
        wide = graph.search(edges.limit(0), alone, queries, scratch, 10, beam)
        assert {(r.vector_id, r["rank"]) for r in wide.collect()} == {(5000, 1)} and wide.count() == 100


def test_graph_index(spark, tmp_path):
    index = VectorIndex(Catalogue(spark, str(tmp_path)), "g", Given(), "graph")
    index.add_items(items(spark, drawn(1, 1200, places(1, 12)), "one"))
    index.add_items(items(spark, drawn(2, 10, places(1, 12)), "two"))
    last = index.search_path("/two/000003.jpg", k=3).collect()
    assert last[0].file_path == "/two/000003.jpg" and [r["rank"] for r in last] == [1, 2, 3]
    assert index.actual_type() == "graph"
    index.close()


# ---- batches ----


def test_routed_batches(spark, monkeypatch):
    matrix = drawn(1, 3000, places(1, 12))
    rows, queries = table_of(spark, matrix), table_of(spark, matrix).where("vector_id % 20 = 7").withColumnRenamed("vector_id", "query_id")
    model = ann.Ivf.train(rows, 16)
    assigned = model.assign(rows)
    want = {(r.query_id, r.vector_id, r["rank"]) for r in search.batch_topk(rows, queries, 5).collect()}
    for per_part, block in ((100_000, 8 << 20), (70, 2000)):
        monkeypatch.setattr(search, "PART_ROWS", per_part)
        monkeypatch.setattr(ann, "BLOCK_BYTES", block)
        assert {(r.query_id, r.vector_id, r["rank"]) for r in model.routed(assigned, queries, 5, nprobe=16).collect()} == want
        few = model.routed(assigned, queries, 5, nprobe=3).collect()
        for q in (7, 1007):
            alone = model.search(assigned, matrix[q].tolist(), 5, nprobe=3).collect()
            assert [r.vector_id for r in sorted(alone, key=lambda r: r["rank"])] == [r.vector_id for r in sorted((r for r in few if r.query_id == q), key=lambda r: r["rank"])]
    assert model.routed(assigned, queries.limit(0), 5).count() == 0 and model.routed(assigned.limit(0), queries, 5).count() == 0


def test_negatives_by_table(spark, monkeypatch):
    matrix = drawn(1, 600, places(1, 12))
    rows = table_of(spark, matrix)
    queries = rows.where("vector_id < 6").withColumnRenamed("vector_id", "query_id")
    unwanted = {0: [30, 31, 30], 1: [], 2: list(range(100, 140)), 4: [4], 77: [1]}
    negatives = spark.createDataFrame([(q, matrix[i].tolist()) for q, ns in unwanted.items() for i in ns] + [(3, None)], "query_id long, embedding array<float>")
    for block in (8 << 20, 2000):
        monkeypatch.setattr(search, "BLOCK_BYTES", block)
        got = search.exclude_batch(rows, queries, negatives, 0.6, 10).collect()
        for q in range(6):
            alone = search.exclude(rows, matrix[q].astype(np.float32).tolist(), [matrix[i].astype(np.float32).tolist() for i in unwanted.get(q, [])], 0.6, 10).collect()
            assert sorted((r["rank"], r.vector_id) for r in got if r.query_id == q) == sorted((r["rank"], r.vector_id) for r in alone), q


# ---- commits ----


def record(path, n, size=1):
    return (n + 1, path, size, n, "image")


RECORD = "id long, file_path string, file_size long, vector_id long, media_type string"


def test_merge_on_read_against_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_DELTAS", 3)
    store = Catalogue(spark, str(tmp_path)).open("m", 4)
    rng, want, n = random.Random(3), {}, 0
    for step in range(14):
        new = {f"/f/{rng.randint(0, 60):03d}": n + i for i in range(rng.choice([2, 5, 25]))}
        gone = set(rng.sample(sorted(want), min(len(want), rng.randint(0, 4)))) - set(new) if step else set()
        n += 30
        store.commit(lambda new=new, gone=gone: Change(
            upserts={"records": spark.createDataFrame([record(p, v) for p, v in new.items()], RECORD)}, deletes={"records": spark.createDataFrame([(p,) for p in gone], "file_path string")} if gone else {}
        ))
        want = {**{p: v for p, v in want.items() if p not in gone}, **new}
        assert {r.file_path: r.vector_id for r in store.table("records").collect()} == want
        low, high = "/f/010", "/f/030"
        assert {r.file_path for r in store.table("records", low, high).collect()} == {p for p in want if low <= p <= high}
        assert len(store.manifest["tables"]["records"]["deltas"]) <= 3
    assert {r.file_path for r in Catalogue(spark, str(tmp_path)).open("m", 4).table("records").collect()} == set(want)
    before = walked(tmp_path)
    assert store.vacuum() > 0 and walked(tmp_path) < before
    assert {r.file_path: r.vector_id for r in store.table("records").collect()} == want


def test_what_is_written_follows_the_change(spark, tmp_path):
    index = VectorIndex(Catalogue(spark, str(tmp_path)), "w", Given())
    index.add_items(items(spark, drawn(1, 4000, places(1, 5)), "lib"))
    before = walked(tmp_path)
    index.add_items(items(spark, drawn(2, 3, places(1, 5)), "lib"))
    assert index.remove_folder("/nowhere") == 0
    rows = {kind: sum(pq.ParquetFile(f).metadata.num_rows for f in walked(tmp_path) - before if f"/{kind}/" in f) for kind in ("records", "vectors", "tombstones")}
    assert rows == {"records": 3, "vectors": 3, "tombstones": 3} and index.store.table("records").count() == 4000
    assert index.record("/lib/000001.jpg").first().vector_id == 4001 and index.record("/lib/000009.jpg").first().vector_id == 9


def test_small_segments_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_SEGMENTS", 3)
    store = Catalogue(spark, str(tmp_path)).open("g", 2)
    for k, n in enumerate([50, 3, 4, 5, 2, 2]):
        rows = spark.range(100 * k, 100 * k + n).select(F.col("id").alias("vector_id"), F.array(F.lit(1.0), F.lit(float(k))).alias("embedding"))
        store.commit(lambda rows=rows: Change(appends={"vectors": rows}))
        assert len(store.segments("vectors")) <= 3
    assert sorted(s["rows"] for s in store.segments("vectors"))[-1] == 50 and sum(s["rows"] for s in store.segments("vectors")) == 66
    assert sorted(r.vector_id for r in store.table("vectors").collect()) == [100 * k + i for k, n in enumerate([50, 3, 4, 5, 2, 2]) for i in range(n)]


def test_kept_tokens_are_those_of_a_loop(spark):
    from quillon.functions import words

    rng = random.Random(2)
    rows = [([rng.randint(0, 99) for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]) for n in (0, 1, 2, 7, 20, 40) for _ in range(3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tokens array<int>, special array<boolean>")
    for most in (0, 1, 5, 100):
        got = {r.i: r.k for r in df.select("i", words.kept_tokens(F.col("tokens"), F.col("special"), most, 2).alias("k")).collect()}
        for i, (tokens, special) in enumerate(rows):
            plain, want = 0, []
            for k, (t, s) in enumerate(zip(tokens, special, strict=True)):
                if s or k >= len(tokens) - 2 or plain < most:
                    want.append(t)
                plain += not s
            assert got[i] == want


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (VectorIndex(Catalogue(spark, str(tmp_path)), "x", Given()) for _ in range(2))
    one.add_items(items(spark, drawn(1, 20, places(1, 5)), "one"))
    two.add_items(items(spark, drawn(2, 30, places(1, 5)), "two"))  # its version is old by now
    errors = []

    def write(index, name):
        try:
            for k in range(3):
                index.add_items(items(spark, drawn(k, 10, places(1, 5)), f"{name}{k}"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=a) for a in ((one, "a"), (two, "b"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    one.refresh()
    records = one.store.table("records").collect()
    assert not errors and len(records) == 20 + 30 + 60
    ids = sorted(r.vector_id for r in records)
    assert ids == list(range(110)) == sorted(r.vector_id for r in one.store.table("vectors").collect())
    stale = Catalogue(spark, str(tmp_path)).open("x", DIMS)
    one.untrack("/nothing")
    with pytest.raises(CommitConflict):
        stale.write({"folders": stale.table("folders")})


# ---- ingest ----


def counting(folder, limit=None):
    """An embedder that notes every row it reads, and fails at a word."""

    def make():
        def model(batch: pd.DataFrame):
            for text in batch["text"]:
                with open(f"{folder}/reads", "a") as f:
                    f.write(f"{text}\n")
                if os.path.exists(f"{folder}/broken") and text in open(f"{folder}/broken").read():
                    raise RuntimeError("the model is gone")
            return [[float(len(t)), 1.0] for t in batch["text"]]

        return model

    return BatchEmbedder(make, 2)


def reads(folder):
    return Counter(open(f"{folder}/reads").read().split()) if os.path.exists(f"{folder}/reads") else Counter()


def test_a_failed_run_goes_on(spark, tmp_path):
    os.makedirs(tmp_path / "lib")
    for i in range(60):
        (tmp_path / "lib" / f"{i:02d}.jpg").write_bytes(b"x" * (i + 1))
    name = lambda todo: todo.withColumn("text", F.element_at(F.split("path", "/"), -1))
    index = VectorIndex(Catalogue(spark, f"{tmp_path}/index"), "r", counting(tmp_path))
    slot = spark.createDataFrame([(f"{tmp_path}/lib/{i:02d}.jpg",) for i in range(60)], "path string").select("path", F.pmod(F.xxhash64("path"), F.lit(1024)).alias("s"))
    chunk = {r.path[-6:]: next(c for c in range(6) if c * 1024 // 6 <= r.s < (c + 1) * 1024 // 6) for r in slot.collect()}
    third = min(n for n, c in chunk.items() if c == 2)
    (tmp_path / "broken").write_text(third)
    with pytest.raises(Exception, match="model is gone"):
        index.add_folder(f"{tmp_path}/lib", describe=name, chunk_rows=10)
    done = {n for n, c in chunk.items() if c < 2}
    again = VectorIndex(Catalogue(spark, f"{tmp_path}/index"), "r", counting(tmp_path))
    assert again.store.table("records").count() == len(done) and len(again.store.manifest["runs"]) == 1
    os.remove(tmp_path / "broken")
    (tmp_path / "lib" / "99.jpg").write_bytes(b"late")
    assert again.add_folder(f"{tmp_path}/lib", describe=name, chunk_rows=10) == {"added": 61 - len(done), "skipped": len(done), "failed": 0}
    assert all(reads(tmp_path)[n] == 1 for n in done | {"99.jpg"}) and set(reads(tmp_path)) == {*chunk, "99.jpg"}
    assert again.store.manifest["runs"] == {} and again.store.table("vectors").count() == 61
    assert not [f for f in os.listdir(tmp_path / "index" / "r") if f.startswith("staged") and os.listdir(tmp_path / "index" / "r" / f)]
    assert again.add_folder(f"{tmp_path}/lib", describe=name) == {"added": 0, "skipped": 61, "failed": 0}


def test_each_frame_and_page_is_read_once(spark, tmp_path):
    index = VectorIndex(Catalogue(spark, f"{tmp_path}/index"), "f", counting(tmp_path))

    def frames(df):
        def read(batches):
            for b in batches:
                with open(f"{tmp_path}/decoded", "a") as f:
                    f.writelines(f"{p}#{k}\n" for p, k in zip(b["path"], b["pos"], strict=True))
                yield b.assign(item="same", text="frame")[["path", "pos", "item", "text"]]

        return df.mapInPandas(read, "path string, pos int, item string, text string")

    videos = spark.createDataFrame([("/v/a.mp4", 1.0, 10, 2.0, 40), ("/v/b.mp4", 1.0, 10, 2.0, 5)], "path string, mtime double, size long, fps double, frame_count int")
    assert index.add_videos(videos, frames)["added"] == 2
    decoded = Counter(open(tmp_path / "decoded").read().split())
    assert len(decoded) == 45 and set(decoded.values()) == {1} and reads(tmp_path)["frame"] == 45


def test_a_path_twice_in_a_batch(spark, tmp_path):
    index = VectorIndex(Catalogue(spark, str(tmp_path)), "t", HashingEmbedder())
    rows = [("/b.jpg", "b", "cats"), ("/a.jpg", "same", "old words"), ("/a.jpg", "same", "new words"), ("/c.jpg", "same", "third"), ("/d.jpg", "d", "...")]
    assert index.add_items(spark.createDataFrame(rows, "file_path string, item string, text string").coalesce(1)) == {"added": 3}
    got = {r.file_path: r.vector_id for r in index.store.table("records").collect()}
    assert got == {"/a.jpg": 0, "/b.jpg": 1, "/c.jpg": 2} and index.store.table("vectors").count() == 3
    assert index.search_text("new words", 1).first().file_path == "/a.jpg" and index.search_text("old").first().score < 0.1
    index.add_items(spark.createDataFrame(rows[:3] * 2, "file_path string, item string, text string"))
    assert {r.file_path: r.vector_id for r in index.store.table("records").collect()} == {"/a.jpg": 3, "/b.jpg": 4, "/c.jpg": 2}
    assert sorted(r.vector_id for r in index.store.table("tombstones").collect()) == [0, 1]
    table = spark.createDataFrame([("p", [1.0]), ("q", [2.0])], "item string, embedding array<float>")
    class Plain:
        dims = 1
        def embed(self, items):
            return items.join(table, "item").select("item", "embedding")
    twice = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3), ("r", 4)], "item string, n int")
    for embedder in (Plain(), TableEmbedder(table, 1)):
        assert sorted((r.item, r.n, r.embedding[0]) for r in embed_rows(embedder, twice, ["n"]).collect()) == [("p", 1, 1.0), ("p", 2, 1.0), ("q", 3, 2.0)]


def test_counters_take_one_pass(spark, tmp_path):
    """The listing is read once for found, changed and what is to be done."""

    def read(batches):
        for b in batches:
            with open(f"{tmp_path}/listed", "a") as f:
                f.writelines(f"{p}\n" for p in b["path"])
            yield b

    index = VectorIndex(Catalogue(spark, f"{tmp_path}/index"), "o", HashingEmbedder())
    index.add_items(spark.createDataFrame([("/a.jpg", "a", "cat", 1.0, 5)], "file_path string, item string, text string, file_mtime double, file_size long"))
    kind = "path string, mtime double, size long"
    files = spark.createDataFrame([("/a.jpg", 1.0, 5), ("/b.jpg", 1.0, 5), ("/c.jpg", None, None)], kind).repartition(3).mapInPandas(read, kind)
    todo, seen = index._todo(files, "todo")
    assert (seen["found"], seen["changed"]) == (3, 2) and sorted(r.path for r in todo.collect()) == ["/b.jpg", "/c.jpg"]
    assert Counter(open(tmp_path / "listed").read().split()) == {"/a.jpg": 1, "/b.jpg": 1, "/c.jpg": 1}
    none, seen = index._todo(files.limit(0), "todo")
    assert (seen["found"], seen["changed"]) == (0, 0) and none.count() == 0


def test_settings_and_the_type_that_serves(spark, tmp_path):
    catalogue = Catalogue(spark, str(tmp_path))
    index = VectorIndex(catalogue, "s", Given(), "pq", {"nlist": 10, "pq_m": 4})
    assert index.store.manifest["index_params"] == {"nlist": 10, "pq_m": 4} and index.actual_type() == "flat"
    index.add_items(items(spark, drawn(1, 1100, places(1, 5)), "lib"))
    assert index.actual_type() == "ivf_pq" and index.rebuild(pq_m=5) == {"index_type": "ivf_pq", "actual_type": "flat"}
    row = index.stats().first()
    assert (row.index_type, row.actual_type) == ("ivf_pq", "flat")
    q = drawn(1, 1100, places(1, 5))[5].tolist()
    assert index.search_vector(q, 1).first().vector_id == 5
    for kind in ("ivf", "hnsw", "pq"):
        assert index.rebuild(kind, pq_m=8, nprobe=10)["actual_type"] == index.store.manifest["index_type"]
        assert index.search_vector(q, 1).first().vector_id == 5
    again = VectorIndex(Catalogue(spark, str(tmp_path)), "s", Given(), "flat", {"nlist": 99})
    assert again.store.manifest["index_params"] == {"nlist": 10, "pq_m": 8, "nprobe": 10}
    for bad in ({"lists": 3}, {"nlist": 0}, {"pq_bits": 40}, {"nprobe": "x"}):
        with pytest.raises(ValueError):
            index.rebuild(**bad)


def test_second_order_by_a_stored_picture(spark, tmp_path):
    index = VectorIndex(Catalogue(spark, str(tmp_path)), "q", Given())
    index.add_items(items(spark, drawn(1, 40, places(1, 5)), "lib"))
    found = index.search_path("/lib/000007.jpg", k=12)
    row = found.first()
    assert (row.query_type, row.query_info) == ("image", "/lib/000007.jpg")
    again = index.rerank(found, k=3).orderBy("rank").collect()
    assert [r.file_path for r in again] == [r.file_path for r in found.orderBy("rank").collect()[:3]] and again[0].score != row.score


def test_thumbnails_go_in_tasks(spark, tmp_path):
    for n in ("a.jpg", "b.jpg", "c.jpg"):
        (tmp_path / n).write_bytes(b"x")
    names = spark.createDataFrame([("a.jpg",), ("a.jpg",), ("zz.jpg",), (None,), ("c.jpg",)], "name string")
    assert discover.delete_files(spark, str(tmp_path), names) == 2 and os.listdir(tmp_path) == ["b.jpg"]


def test_last_of_a_path(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), (None, 1, "n"), (None, 2, "m")], "file_path string, place int, v string")
    assert sorted(r.v for r in maintain.last_of_path(rows, "place").collect()) == ["m", "y", "z"]


def test_batches_by_codes(spark, monkeypatch):
    matrix = drawn(7, 3000, places(8, 30), 0.2)
    rows = table_of(spark, matrix)
    queries = rows.where("vector_id % 30 = 4").withColumnRenamed("vector_id", "query_id")
    model = ann.Pq.train(rows, 4, 5, nlist=16)
    encoded = model.encode(rows)
    many = model.batch(encoded, queries, 5, nprobe=4).collect()
    for q in (4, 1504):
        alone = model.search(encoded, matrix[q].astype(np.float32).tolist(), 5, nprobe=4).collect()
        assert sorted((r["rank"], r.vector_id) for r in many if r.query_id == q) == sorted((r["rank"], r.vector_id) for r in alone)
    asked = list(range(4, 3000, 30))
    assert hits(model.batch(encoded, queries, 20, refine=10, nprobe=16).collect(), matrix, asked, 20) >= 0.9


def test_codes_are_refined_as_the_table_needs(spark, monkeypatch):
    """Vectors without clusters and coarse codes: what a sample of the rows is content with is too little for the table."""
    matrix, asked = drawn(9, 6000, np.zeros((1, DIMS))), list(range(0, 6000, 60))
    rows = table_of(spark, matrix)
    queries = rows.where("vector_id % 60 = 0").withColumnRenamed("vector_id", "query_id")
    model = ann.Pq.train(rows, 2, 2, nlist=4)
    encoded = model.encode(rows)
    assert hits(model.batch(encoded, queries, 5, nprobe=4).collect(), matrix, asked, 5) < 0.9
    refine = model.fitted(encoded, 5, nprobe=4)
    got = model.batch(encoded, queries, 5, refine, nprobe=4).collect()
    assert hits(got, matrix, asked, 5) >= 0.9 and refine > model.refine
    exact = matrix.astype(np.float32).astype(float)
    assert max(abs(r.score - exact[r.query_id] @ exact[r.vector_id]) for r in got) < 1e-12
    assert model.fitted(encoded.limit(0), 5) == model.refine


def test_codes_of_near_copies(spark):
    """Rows of equal codes: the fit counts them all, since codes can't tell which of them are the best."""
    rng = np.random.default_rng(4)
    matrix = drawn(9, 3000, np.zeros((1, DIMS)))
    matrix[::3] = unit(matrix[1] + 1e-4 * rng.normal(size=(1000, DIMS)))
    rows, asked = table_of(spark, matrix), list(range(0, 3000, 30))
    queries = rows.where("vector_id % 30 = 0").withColumnRenamed("vector_id", "query_id")
    model = ann.Pq.train(rows, 2, 3, nlist=4)
    encoded = model.encode(rows)
    refine = model.fitted(encoded, 5, nprobe=4)
    assert refine >= 190 and hits(model.batch(encoded, queries, 5, refine, nprobe=4).collect(), matrix.astype(np.float32).astype(float), asked, 5) >= 0.9


def test_recall_with_copies(spark, tmp_path):
    """Every vector eight times: of copies at the cut any counts, since all score alike."""
    matrix = drawn(11, 250, np.zeros((1, DIMS))).repeat(4, axis=1) / 2
    rows = [(i, matrix[i % 250].tolist(), 0) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = index_queries.ann_recall(spark, str(tmp_path)).collect()
    assert sorted((r.method, r.queries, r.enough) for r in got) == [(m, 100, True) for m in ("graph", "ivf", "ivf_pq")]


def test_a_batch_of_a_stream_is_added_once(spark, tmp_path):
    index = VectorIndex(Catalogue(spark, str(tmp_path)), "b", Given())
    assert index.add_batch(items(spark, drawn(1, 5, places(1, 5)), "x"), "s", 0) == {"added": 5}
    assert index.add_batch(items(spark, drawn(1, 5, places(1, 5)), "y"), "s", 0) == {"added": 0}
    assert index.add_batch(items(spark, drawn(1, 0, places(1, 5)), "y"), "s", 1) == {"added": 0}
    assert index.add_batch(items(spark, drawn(1, 2, places(1, 5)), "y"), "t", 0) == {"added": 2}
    assert index.store.table("records").count() == 7 and index.store.manifest["streams"] == {"s": 1, "t": 0}


class Pretended:
    """A decoder for files whose bytes are text: frames and pages are their lines."""

    def __init__(self, most_pixels, folder=None):
        self.most_pixels = most_pixels

    def pictures(self, files):
        return files.withColumn("text", F.concat(F.lit("picture "), F.element_at(F.split("path", "/"), -1)))

    def videos(self, files):
        return files.withColumn("fps", F.lit(2.0)).withColumn("frame_count", F.lit(6))

    def frames(self, frames):
        return frames.withColumn("item", F.concat_ws("#", "path", "pos")).withColumn("text", F.lit("moving film"))

    def documents(self, files):
        return files.withColumn("page_count", F.lit(3))

    def pages(self, pages):
        return pages.where("page_number < 3").withColumn("item", F.col("file_path")).withColumn("text", F.concat(F.lit("sheet "), F.col("page_number").cast("string")))

    def thumbnails(self, files, side):
        return files.select("name", F.encode(F.concat_ws("@", "file_path", F.lit(side)), "utf-8").alias("content"))


def test_a_folder_through_a_decoder(spark, tmp_path):
    from quillon.ingest_folder import main

    os.makedirs(tmp_path / "lib")
    for n in ("a.jpg", "b.png", "c.mp4", "d.pdf"):
        (tmp_path / "lib" / n).write_bytes(n.encode())
    flags = ["-c", f"{tmp_path}/index", "-i", "cli", "-f", f"{tmp_path}/lib", "--decoder", "tests.test_index_scale:Pretended", "--thumbnails", f"{tmp_path}/thumbs", "-t", "99", "-b", "2"]
    assert main(flags, spark) == {"added": 5, "skipped": 0, "failed": 1, "images": 2, "videos": 1, "documents": 1, "pages": 2}
    assert main(flags, spark) == {"added": 0, "skipped": 5, "failed": 0, "images": 0, "videos": 0, "documents": 0, "pages": 0}
    index = VectorIndex(Catalogue(spark, f"{tmp_path}/index"), "cli", HashingEmbedder())
    assert index.search_text("moving film", 1).first().file_path.endswith("c.mp4")
    assert index.search_text("sheet 2", 1).first().file_path.endswith("d.pdf#page=2")
    assert len(os.listdir(tmp_path / "thumbs")) == 5 and {open(tmp_path / "thumbs" / n).read().split("@")[1] for n in os.listdir(tmp_path / "thumbs")} == {"99"}
    again = index.rerank(index.search_text("sheet", 3), k=2, judge=lambda: lambda pairs: [float(len(p)) for p in pairs])
    assert again.count() == 2
    with pytest.raises(SystemExit):
        main([*flags[:6], "--thumbnails", "x"], spark)


def test_where_scratch_tables_go():
    from types import SimpleNamespace as Some

    from quillon.sources.scratch import shared_root

    def session(master, folder=None):
        return Some(conf=Some(get=lambda k, d: folder), sparkContext=Some(master=master, applicationId=f"app-{master}", getConf=lambda: Some(get=lambda k: None)))

    assert shared_root(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_root(session("local[2]")) == shared_root(session("local[2]"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_root(session("spark://host:7077"))
