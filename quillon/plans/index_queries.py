"""Queries that go through an index: its batches, its life, its searches by file, its streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..index import VectorIndex
from ..operators import ann, graph, maintain, search
from ..sources.media import ColumnEmbedder
from ..sources.scratch import Scratch, shared_root
from ..sources.snapshots import Catalogue
from ..streaming.ingest import ingest_stream
from .catalogue_queries import CAT, built, catalogue, dot, embeddings, query, top

_ITEM = ("file_path", "media_type", "file_mtime", "file_size", "parent_document", "page_number", "frame_count", "duration_seconds")


def _items(spark, sf_dir):
    return catalogue(spark, sf_dir).select(*_ITEM, "vector_id", F.col("file_path").alias("item"), F.col("embedding").alias("vector")).withColumnRenamed("vector_id", "number")


def _index(spark, sf_dir, kind="flat", **params) -> VectorIndex:
    dims = len(embeddings(spark, sf_dir).select("embedding").first().embedding)
    return VectorIndex(Catalogue(spark, f"{shared_root(spark)}/catalogue-{uuid.uuid4().hex}"), "media", ColumnEmbedder(dims, "vector"), kind, params)


_WHOLE: dict = {}


def _whole(spark, sf_dir) -> VectorIndex:
    """An index of the whole catalogue, made by the first query of an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WHOLE:
        _WHOLE[key] = _index(spark, sf_dir)
        _WHOLE[key].add_items(_items(spark, sf_dir))
    return _WHOLE[key]


def _queries(v):
    return v.where("vector_id % 20 = 0").select(F.col("vector_id").alias("query_id"), "embedding")


def _rounded(df, *columns):
    return df.select(*columns, "rank", F.round("score", 6).alias("score"))


_PAIRS = f"s as (select q.vec_id as query_id, v.vec_id as vector_id, {dot('q.embedding', 'v.embedding')} as score from embeddings q, embeddings v where q.vec_id % 20 = 0)"


@query(f"""with {_PAIRS}, c as (select * from (select *, row_number() over (partition by query_id order by score desc, vector_id) as place from s) where place <= 30),
n as (select vec_id, ((vec_id // 10) % 25) * 20 as query_id, embedding from embeddings where vec_id % 10 = 3),
kept as (select query_id, vector_id, score from c where not exists (select 1 from n join embeddings v on v.vec_id = c.vector_id where n.query_id = c.query_id and {dot('n.embedding', 'v.embedding')} >= 0.15))
select query_id, vector_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, vector_id) as rank from kept) where rank <= 10""")
def exclusion_batch(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    unwanted = v.where("vector_id % 10 = 3").select((F.expr("(vector_id div 10) % 25") * 20).alias("query_id"), "embedding")
    return _rounded(search.exclude_batch(v, _queries(v), unwanted, 0.15, 10), "query_id", "vector_id")


@query(f"with {_PAIRS} select query_id, vector_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, vector_id) as rank from s) where rank <= 10")
def routed_full_probe(spark, sf_dir):
    model, rows = built(spark, sf_dir, "ivf", lambda v: ann.Ivf.train(v, 8), lambda m, v: m.assign(v), ann.Ivf.load, "list_id")
    return _rounded(model.routed(rows, _queries(embeddings(spark, sf_dir)), 10, nprobe=8), "query_id", "vector_id")


@query("select unnest(['graph', 'ivf', 'ivf_pq']) as method, count(*) as queries, true as enough from embeddings where vec_id % 20 = 0")
def ann_recall(spark, sf_dir):
    """Whether each method finds nine tenths of the exact best 20 over all queries.  A found row counts by its score, so rows that tie with the
    last of the 20 count alike."""
    v, scratch = embeddings(spark, sf_dir), Scratch(spark)
    asked = _queries(v)
    exact = scratch.saved(search.batch_topk(v, asked, 20).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")))
    model, rows = built(spark, sf_dir, "ivf", lambda v: ann.Ivf.train(v, 8), lambda m, v: m.assign(v), ann.Ivf.load, "list_id")
    codes, edges = ann.Pq.train(v, 8, 6, lists=model), graph.build(v, scratch)
    coded = scratch.saved(codes.encode(v))
    found = {
        "graph": graph.search(edges, v, asked, scratch, 20, graph.fitted(edges, v, scratch, 20)),
        "ivf": model.routed(rows, asked, 20),
        "ivf_pq": codes.batch(coded, asked, 20, codes.fitted(coded, 20)),
    }
    asks, out = asked.agg(F.count("*").alias("queries")), None
    for name, rows in found.items():
        hit = rows.join(exact, "query_id").where(F.col("score") >= F.col("least") - search.SAME).agg(F.count("*").alias("hit"))
        row = asks.crossJoin(hit).crossJoin(exact.agg(F.sum("n").alias("n"))).select(F.lit(name).alias("method"), "queries", (F.col("hit") >= 0.9 * F.col("n")).alias("enough"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""with {CAT}, a as (select file_path, embedding, vector_id as old, row_number() over (order by file_path) - 1 as id from cat),
b as (select file_path, list_reverse(embedding) as embedding, row_number() over (order by file_path) - 1 + (select count(*) from a) as id from a where old % 7 = 0),
v as (select id, embedding from a union all select id, embedding from b),
s as (select id, {dot('v.embedding', 'q.embedding')} as score, row_number() over (order by {dot('v.embedding', 'q.embedding')} desc, id) as rank from v, (select embedding from cat where vector_id = 0) q),
r as (select file_path, id from b union all select file_path, id from a where old % 7 <> 0)
select file_path, id as vector_id, rank, round(score, 6) as score from r join s using (id) where file_path not like '/lib/f2/%'""")
def index_life(spark, sf_dir):
    """All is added; every seventh path changes, twice in one batch, of which the last counts; a folder goes; everything left is ranked."""
    items, index = _items(spark, sf_dir), _index(spark, sf_dir)
    index.add_items(items)
    some = items.where("number % 7 = 0")
    index.add_items(some.unionByName(some.withColumn("vector", F.reverse("vector"))))
    index.remove_folder("/lib/f2")
    q = search.stored_vector(embeddings(spark, sf_dir), 0)
    return _rounded(index.search_vector(q, index.store.table("vectors").count(), least=0.0), "file_path", "vector_id")


@query(f"with {CAT} select file_path, rank, round(score, 6) as score from {top(0, 20)}")
def appends_full_probe(spark, sf_dir):
    """Inverted lists after three appends, each a segment of its own under the first centres or, where rows drifted, new ones."""
    items, index = _items(spark, sf_dir), _index(spark, sf_dir, "ivf", nlist=8, nprobe=8)
    q = search.stored_vector(embeddings(spark, sf_dir), 0)
    for third in range(3):
        index.add_items(items.where(F.col("number") % 3 == third))
        found = index.search_vector(q, 20)
    return _rounded(found, "file_path")


@query(f"with {CAT} select file_path, rank, round(score, 6) as score from {top(0, 20)}")
def rebuilt_search(spark, sf_dir):
    """The same vectors under another type, every list read."""
    index = _index(spark, sf_dir)
    index.add_items(_items(spark, sf_dir))
    index.rebuild("ivf", nlist=8, nprobe=8)
    return _rounded(index.search_vector(search.stored_vector(embeddings(spark, sf_dir), 0), 20), "file_path")


@query(f"with {CAT} select file_path, rank, round(score, 6) as score, 'document' as query_type, '/lib/f4/doc4.pdf#page=5' as query_info from {top(4, 10)}")
def search_by_page(spark, sf_dir):
    found = _whole(spark, sf_dir).search_path("/lib/f4/doc4.pdf", page=5, k=10)
    return found.select("file_path", "rank", F.round("score", 6).alias("score"), "query_type", "query_info")


@query(f"with {CAT} select file_path, rank, round(score, 6) as score, 'image' as query_type from {top(5, 10)} where media_type in ('image', 'video')")
def search_by_picture(spark, sf_dir):
    found = _whole(spark, sf_dir).search_path("/lib/f5/i5.jpg", k=10, kind="media")
    return found.select("file_path", "rank", F.round("score", 6).alias("score"), "query_type")


@query(f"""with {CAT}, m as (select pos, avg(x) as x from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings where vec_id < 6) group by pos),
u as (select list(x / (select sqrt(sum(x * x)) from m) order by pos) as q from m)
select file_path, row_number() over (order by score desc, vector_id) as rank, round(score, 6) as score from (select file_path, vector_id, {dot('embedding', 'q')} as score from cat, u) order by score desc, vector_id limit 10""")
def search_by_video(spark, sf_dir):
    """By the mean of a video's frames; the vectors of the frames are the first of the table."""
    v = embeddings(spark, sf_dir).select(F.col("vector_id").cast("int").alias("frame"), F.col("embedding").alias("vector"))
    frames = lambda df: df.join(v, "frame").withColumn("item", F.concat_ws("#", "path", "frame"))
    video = spark.createDataFrame([("/q/v.mp4", 6)], "path string, frame_count int")
    return _rounded(_whole(spark, sf_dir).search_video(video, frames, 10), "file_path")


@query(f"with {CAT} select file_path, row_number() over (order by file_path) - 1 as vector_id, media_type, file_size from cat")
def stream_records(spark, sf_dir):
    """The records that a stream over the table's files leaves behind."""
    path = f"{sf_dir}/embeddings.parquet"
    index = _index(spark, sf_dir)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a source is a folder or a pattern
    cat = _items(spark, sf_dir).drop("vector")
    items = lambda batch: batch.select(F.col("vec_id").alias("number"), F.col("embedding").alias("vector")).join(cat, "number")
    ingest_stream(index, stream, f"{shared_root(spark)}/stream-{uuid.uuid4().hex}", items)
    return index.store.table("records").select("file_path", "vector_id", "media_type", "file_size")


@query(f"with {CAT} select folder as file_path, max(vector_id) as vector_id, count(*) as n from cat group by folder")
def last_of_path(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    last = maintain.last_of_path(cat.select(F.col("folder").alias("file_path"), "vector_id", F.col("vector_id").alias("place")), "place")
    return last.join(cat.groupBy(F.col("folder").alias("file_path")).agg(F.count("*").alias("n")), "file_path")


@query(f"""with {CAT}, d as (select vector_id, {dot('embedding', '(select embedding from cat where vector_id = 0)')} as score from cat order by score desc, vector_id limit 12)
select file_path, row_number() over (order by {dot('c.embedding', 'q.embedding')} desc, c.vector_id) as rank from d join cat c using (vector_id), (select embedding from cat where vector_id = 0) q order by rank limit 5""")
def second_order_by_picture(spark, sf_dir):
    """Results of a search by a stored picture, in a second order by the same picture."""
    index = _whole(spark, sf_dir)
    return index.rerank(index.search_path("/lib/f0/i0.jpg", k=12), k=5).select("file_path", "rank")

