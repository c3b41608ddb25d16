"""Further queries with SQL: scans, hashes, sampling, text and vector expressions, ingest and catalogue steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import sampling as S
from ..functions import vectors as V
from ..functions import words
from ..operators import maintain, results, search
from ..sources import discover
from ..sources.media import page_rows
from .catalogue_queries import _SIZES, CAT, _SCAN, catalogue, embeddings, hits, query, scan, shown, sizes, sql_shown, top

# ---- scans ----

_LISTING = """ls as (select case vector_id % 7 when 0 then upper(file_path) when 1 then file_path || '.txt' when 2 then '/lib/.hidden/noext' || vector_id else coalesce(parent_document, file_path) end as path,
  timestamp '2024-01-01 00:00:00' + to_microseconds(vector_id * 1234567) as ts, file_size as size from cat),
typed as (select *, regexp_extract(lower(path), '\\.([^./\\\\]+)$', 1) as e from ls),
scan as (select path, epoch_us(ts) / 1e6 as mtime, size, case when e in ('jpg', 'jpeg', 'png') then 'image' when e = 'mp4' then 'video' when e = 'pdf' then 'document' end as media_type, size || '_' || epoch_us(ts) as file_hash from typed)"""


def listing(spark, sf_dir):
    v = F.col("vector_id")
    path = F.when(v % 7 == 0, F.upper("file_path")).when(v % 7 == 1, F.concat("file_path", F.lit(".txt"))).when(v % 7 == 2, F.concat(F.lit("/lib/.hidden/noext"), v.cast("string"))).otherwise(F.coalesce("parent_document", "file_path"))
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return catalogue(spark, sf_dir).select(path.alias("path"), F.timestamp_micros(start + v * 1234567).alias("modificationTime"), F.col("file_size").alias("length"))


def _scan_query(name: str, kinds: tuple[str, ...]) -> None:
    def f(spark, sf_dir):
        return discover.listed(listing(spark, sf_dir), kinds)

    f.__name__ = name
    query(f"with {CAT}, {_LISTING} select path, mtime, size, media_type, file_hash from scan where media_type in ({', '.join(repr(k) for k in kinds)})")(f)


_scan_query("scan_images", ("image",))
_scan_query("scan_media", ("image", "video"))
_scan_query("scan_documents", ("document",))


@query(f"with {CAT}, {_LISTING} select path, coalesce(media_type, '') as media_type, media_type is not null as supported, coalesce(media_type in ('image', 'video'), false) as is_media from scan")
def extension_predicates(spark, sf_dir):
    path = F.col("path")
    return listing(spark, sf_dir).select("path", F.coalesce(P.media_type(path), F.lit("")).alias("media_type"), P.is_supported(path).alias("supported"), P.is_supported(path, ("image", "video")).alias("is_media"))


@query(f"with {CAT}, {_LISTING} select count(*) as files, round(sum(size)::double / 1048576, 2) as size_mb from ls")
def cache_size(spark, sf_dir):
    return discover.cache_size(listing(spark, sf_dir).withColumnRenamed("length", "size"))


@query("select doc_id, md5(coalesce(text, '')) as md5, octet_length(encode(coalesce(text, ''))) as size from documents")
def content_md5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("content", F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select("doc_id", F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("size"))


@query(f"with {CAT} select file_path, substring(md5(file_path), 1, 16) || '.jpg' as name from cat where vector_id % 3 <> 0")
def missing_thumbnails(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    there = cat.where("vector_id % 3 = 0").select(P.thumbnail_name(F.col("file_path")).alias("name"))
    return discover.missing_thumbnails(cat, there).select("file_path", "name")


# ---- sampling and sizes ----


@query(f"select vec_id, case when vec_id % 5 > 0 then total / (vec_id % 5)::double else 0.0 end as seconds from {_SIZES}")
def video_duration(spark, sf_dir):
    return sizes(spark, sf_dir).select("vec_id", S.duration(F.col("total"), (F.col("vec_id") % 5).cast("double")).alias("seconds"))


@query(f"with s as {_SIZES}, f as (select vec_id, range(0, total, greatest(1, cast(trunc((1.0 + vec_id % 30) / 2.0) as int)))[1:20] as l from s) select '/v' || vec_id as path, cast(p - 1 as int) as pos, cast(l[p] as int) as frame from f, unnest(range(1, len(l) + 1)) as t(p)")
def frame_source(spark, sf_dir):
    videos = sizes(spark, sf_dir).select(F.concat(F.lit("/v"), F.col("vec_id").cast("string")).alias("path"), "total", (1.0 + F.col("vec_id") % 30).alias("fps"))
    return S.frame_rows(videos, S.fps_indices(F.col("total"), F.col("fps"), 2.0, 20))


@query(f"""with t as (select vec_id, vec_id % 4 as page, case when w <= 768 and h <= 768 then w when w > h then 768 else cast(trunc(w * (768.0::double / h)) as int) end as width,
case when w <= 768 and h <= 768 then h when w > h then cast(trunc(h * (768.0::double / w)) as int) else 768 end as height from {_SIZES})
select vec_id, (768 - width) // 2 as x, (768 - height) // 2 as y, width, height, case when page > 1 then 'p.' || page end as badge from t""")
def page_thumbnail(spark, sf_dir):
    placed = sizes(spark, sf_dir).select("vec_id", S.centred(F.col("w"), F.col("h")).alias("s"), S.page_badge(F.col("vec_id") % 4).alias("badge"))
    return placed.select("vec_id", "s.*", "badge")


@query(f"select vec_id, w as width, h as height, max(w) over () as pad_width, max(h) over () as pad_height from {_SIZES}")
def padded_batch(spark, sf_dir):
    return results.padded_size(sizes(spark, sf_dir).select("vec_id", F.col("w").alias("width"), F.col("h").alias("height")))


@query("select vec_id, chr(cast(65 + vec_id % 26 as int)) || chr(cast(48 + vec_id % 10 as int)) || chr(cast(97 + vec_id % 13 as int)) || '4' as codec from embeddings")
def codec_names(spark, sf_dir):
    v = F.col("vector_id")
    code = (65 + v % 26) + (48 + v % 10) * 256 + (97 + v % 13) * 65536 + F.lit(52) * 16777216
    return embeddings(spark, sf_dir).select(v.alias("vec_id"), S.codec_name(code.cast("int")).alias("codec"))


@query(f"with {CAT} select parent_document, count(*) as pages, min(page_number) as first_page, max(page_number) as last_page, sum(file_size)::bigint as size from cat where parent_document is not null group by parent_document")
def pages_of_documents(spark, sf_dir):
    pages = catalogue(spark, sf_dir).where("parent_document is not null")
    return pages.groupBy("parent_document").agg(F.count("*").alias("pages"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.sum("file_size").alias("size"))


# ---- text expressions ----

_PARTS = "(select p_partkey as k, case p_partkey % 5 when 0 then p_name || '!' when 1 then '  ' when 2 then p_name || ' ' when 3 then null else p_name end as s from part)"


def parts(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    said = F.when(k % 5 == 0, F.concat(name, F.lit("!"))).when(k % 5 == 1, F.lit("  ")).when(k % 5 == 2, F.concat(name, F.lit(" "))).when(k % 5 == 4, name)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), said.alias("s"))


@query(f"select k, case when trim(coalesce(s, '')) = '' then 'Find it.' when regexp_matches(right(trim(s), 1), '\\pP') then trim(s) else trim(s) || '.' end as told from {_PARTS}")
def instructions(spark, sf_dir):
    return parts(spark, sf_dir).select("k", words.instruction(F.col("s"), "Find it.").alias("told"))


@query("select p_partkey as k, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' , ,'), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as terms from part")
def term_lists(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select(F.col("p_partkey").alias("k"), F.array_join(words.terms(F.replace("p_name", F.lit(" "), F.lit(" , ,"))), "|").alias("terms"))


@query("select p_partkey as k, regexp_replace('../' || p_type || '_' || p_brand, '[^A-Za-z0-9_-]', '', 'g') as name from part")
def safe_names(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select(F.col("p_partkey").alias("k"), P.safe_name(F.concat(F.lit("../"), "p_type", F.lit("_"), "p_brand")).alias("name"))


@query("""with t as (select vec_id, vec_id % 41 as n from embeddings), i as (select vec_id, n, range(n) as l from t)
select vec_id, array_to_string(list_filter(l, lambda i: i % 7 = 3 or i >= n - 5 or i - (i + 3) // 7 < 10), ',') as kept from i""")
def token_truncation(spark, sf_dir):
    n = (F.col("vector_id") % 41).cast("int")
    listed = embeddings(spark, sf_dir).select(F.col("vector_id").alias("vec_id"), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("tokens"))
    kept = words.kept_tokens(F.col("tokens"), F.transform("tokens", lambda t: t % 7 == 3), 10)
    return listed.select("vec_id", F.array_join(kept.cast("array<string>"), ",").alias("kept"))


@query(f"""with {CAT}, m as (select vector_id, case when vector_id % 3 = 0 then 'said ' || vector_id end as t, case when media_type = 'image' then file_path end as i, case when media_type = 'video' then file_path when vector_id % 10 = 0 then 'v' end as v from cat)
select vector_id, case when v is not null then 'video:' || v || ';' when i is not null then 'image:' || i || ';' else '' end || case when t is not null then 'text:' || t || ';' when v is null and i is null then 'text:NULL;' else '' end as content from m""")
def model_inputs(spark, sf_dir):
    v, kind = F.col("vector_id"), F.col("media_type")
    text = F.when(v % 3 == 0, F.concat(F.lit("said "), v.cast("string")))
    video = F.when(kind == "video", F.col("file_path")).when(v % 10 == 0, F.lit("v"))
    made = words.conversation(text, F.when(kind == "image", F.col("file_path")), video, F.lit("p"))
    return catalogue(spark, sf_dir).select("vector_id", _joined(made.content).alias("content"))


def _joined(content):
    return F.array_join(F.transform(content, lambda c: F.concat(c.type, F.lit(":"), c.value, F.lit(";"))), "")


@query(f"""with {CAT} select vector_id, 'text:<Instruct>: Match.;text:<Query>:;' || case when vector_id % 3 = 0 then 'text:said ' || vector_id || ';' else 'text:NULL;' end || 'text:' || chr(10) || '<Document>:;' ||
case media_type when 'video' then 'video:http:/' || file_path || ';' when 'image' then 'image:file://' || file_path || ';' else '' end || case when vector_id % 2 = 0 then 'text:' || folder || ';' when media_type = 'document' then 'text:NULL;' else '' end as content from cat""")
def rerank_pairs(spark, sf_dir):
    v, kind, path, none = F.col("vector_id"), F.col("media_type"), F.col("file_path"), F.lit(None).cast("string")
    asked = F.when(v % 3 == 0, F.concat(F.lit("said "), v.cast("string")))
    document = (F.when(v % 2 == 0, F.col("folder")), F.when(kind == "image", path), F.when(kind == "video", F.concat(F.lit("http:/"), path)))
    return catalogue(spark, sf_dir).select("vector_id", _joined(words.rerank_pair(F.lit("Match."), (asked, none, none), document)).alias("content"))


@query("select event_id, epoch_us(ts) as micros, strftime(ts, '%Y-%m-%d %H:%M:%S') as text from events")
def timestamps(spark, sf_dir):
    """Timestamps through their ISO text and back."""
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    back = F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_micros(back).alias("micros"), F.date_format(back, "yyyy-MM-dd HH:mm:ss").alias("text"))


# ---- vectors ----

_D = "list_transform(embedding, lambda x: x::double * (vec_id % 3))"


@query(f"select vec_id, round(coalesce(sqrt(list_dot_product(u, u)), 0), 6) as size, round(coalesce(u[1], 0), 6) + 0 as first from (select vec_id, case when list_dot_product(v, v) > 0 then list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) else v end as u from (select vec_id, {_D} as v from embeddings))")
def unit_vectors(spark, sf_dir):
    scaled = embeddings(spark, sf_dir).select("vector_id", V.normalize(F.transform("embedding", lambda x: x.cast("double") * (F.col("vector_id") % 3))).alias("u"))
    return scaled.select(F.col("vector_id").alias("vec_id"), F.round(V.norm(F.col("u")), 6).alias("size"), (F.round(F.get("u", F.lit(0)), 6) + 0.0).alias("first"))


@query("select vec_id, round(list_dot_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)) / sqrt(list_dot_product(embedding::double[], embedding::double[])) / (select sqrt(list_dot_product(embedding::double[], embedding::double[])) from embeddings where vec_id = 7), 6) as cosine from embeddings")
def cosines(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return v.select(F.col("vector_id").alias("vec_id"), F.round(V.cosine(F.col("embedding"), V.literal(search.stored_vector(v, 7))), 6).alias("cosine"))


@query("select vec_id, case when vec_id % 65 > 0 then round(embedding[cast(vec_id % 65 as int)]::double, 6) end as state from embeddings")
def last_token(spark, sf_dir):
    v = F.col("vector_id")
    mask = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i <= v % 65).cast("int"))
    return embeddings(spark, sf_dir).select(v.alias("vec_id"), F.round(V.last_unmasked(F.col("embedding"), mask).cast("double"), 6).alias("state"))


@query("""with p as (select label, (row_number() over (partition by label order by vec_id) - 1) // 8 as chunk, embedding from embeddings),
c as (select label, chunk, pos, avg(x) as x from (select label, chunk, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from p) group by all),
u as (select label, chunk, pos, x / sqrt(sum(x * x) over (partition by label, chunk)) as x from c), m as (select label, pos, avg(x) as x from u group by all)
select label, cast(pos - 1 as int) as pos, round(x / sqrt(sum(x * x) over (partition by label)), 5) as x from m""")
def frame_chunk_vectors(spark, sf_dir):
    from pyspark.sql import Window

    placed = embeddings(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("vector_id")) - 1)
    return V.chunked_mean(placed, "label").select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("x"))


# ---- searches with their tags ----


@query(sql_shown(top(0, 20)))
def exclusion_of_nothing(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    return shown(search.with_records(search.exclude(cat, search.stored_vector(cat, 0), [], 0.3, 20), cat))


@query(f"with {CAT} select vector_id, rank, 'text_with_exclusion' as query_type, 'cats NOT (dogs, owls)' as query_info from {top(7, 10)}")
def tagged_results(spark, sf_dir):
    found = results.tagged(hits(spark, sf_dir, 7, 10), "text_with_exclusion", "cats NOT (dogs, owls)")
    return found.select("vector_id", "rank", "query_type", "query_info")


@query(f"""with {CAT}, a as (select * from {top(0, 40)}), b as (select * from {top(7, 40)}) select vector_id, 'combined' as query_type, 'one + two' as query_info from a join (select file_path from b) using (file_path)""")
def combined_results(spark, sf_dir):
    a, b = (results.tagged(hits(spark, sf_dir, n, 40), "text", t) for n, t in ((0, "one"), (7, "two")))
    return results.combined(a, b, "intersection").select("vector_id", "query_type", "query_info")


@query(f"with {CAT} select rank, file_path, thumbnail_path, vector_id, media_type from {top(0, 50)}")
def result_dicts(spark, sf_dir):
    kinds = "file_path string, thumbnail_path string, score double, vector_id long, media_type string"
    held = results.as_json(hits(spark, sf_dir, 0, 50)).select("rank", F.from_json("json", kinds).alias("r"))
    return held.select("rank", "r.file_path", "r.thumbnail_path", "r.vector_id", "r.media_type")


@query(f"""with {CAT}, s as (select q.label as query_id, c.vector_id, list_dot_product(c.embedding::double[], q.embedding::double[]) as score from cat c, (select label, arg_min(embedding, vec_id) as embedding from embeddings group by label) q)
select query_id, vector_id, round(score, 5) as score from s where round(score, 5) >= 0.2""")
def range_search(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    asked = v.groupBy("label").agg(F.min_by("embedding", "vector_id").alias("embedding")).select(F.col("label").cast("long").alias("query_id"), "embedding")
    return search.within(v, asked, 0.19).select("query_id", "vector_id", F.round("score", 5).alias("score")).where("score >= 0.2")


# ---- catalogue steps ----


@query(f"with {CAT}, f as (select folder, min(vector_id) as first from cat group by folder), u as (select folder as folder_path, case when first < 3 then false else true end as recursive from f union all select '/new', true) select folder_path, recursive from u where folder_path <> '/lib/f5'")
def folder_list(spark, sf_dir):
    """Folders tracked, two tracked again with another setting, one added, one untracked."""
    first = catalogue(spark, sf_dir).groupBy(F.col("folder").alias("folder_path")).agg(F.min("vector_id").alias("first"))
    tracked = first.select("folder_path", F.lit(True).alias("recursive"))
    again = first.where("first < 3").select("folder_path", F.lit(False).alias("recursive")).unionByName(spark.createDataFrame([("/new", True)], "folder_path string, recursive boolean"))
    return maintain.upsert(tracked, again, "folder_path").where("folder_path <> '/lib/f5'").select("folder_path", "recursive")


@query(f"with {CAT} select distinct vector_id from cat where is_tombstoned")
def distinct_tombstones(spark, sf_dir):
    dead = catalogue(spark, sf_dir).where("is_tombstoned").select("vector_id")
    return dead.union(dead).distinct()


@query("select coalesce(max(vec_id), -1) as greatest, (select coalesce(max(vec_id), -1) from embeddings where vec_id < 0) as of_nothing from embeddings")
def greatest_vector_id(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    most = lambda df, name: df.agg(F.coalesce(F.max("vector_id"), F.lit(-1)).cast("long").alias(name))
    return most(v, "greatest").crossJoin(most(v.where("vector_id < 0"), "of_nothing"))


@query(f"""with {CAT}, {_SCAN}, t as (select s.*, case when path like '%.mp4' then 'video' when path like '%#page=%' then 'document' else 'image' end as kind, not exists (select 1 from cat c where c.file_path = s.path and c.file_mtime = s.mtime and c.file_size = s.size) as todo from scan s)
select kind, count(*) as found, count(*) filter (todo) as changed, count(*) filter (not todo) as skipped from t group by kind""")
def ingest_counters(spark, sf_dir):
    found = scan(spark, sf_dir).select("*", F.when(F.endswith("path", F.lit(".mp4")), "video").when(F.contains("path", F.lit("#page=")), "document").otherwise("image").alias("kind"))
    return maintain.ingest_counters(found, catalogue(spark, sf_dir))


@query(f"with {CAT}, n as (select '/add' || file_path as file_path from cat where vector_id % 30 = 1) select file_path, (select max(vector_id) from cat) + row_number() over (order by file_path) as vector_id from n")
def append_ids(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    new = cat.where("vector_id % 30 = 1").select(F.concat(F.lit("/add"), "file_path").alias("file_path"))
    return maintain.append_vectors(cat, new).select("file_path", "vector_id")


@query(f"with {CAT} select vector_id, case when vector_id in (1, 2, 99, 123) then 'tombstone' else 'record' end as kind from cat")
def remove_batch(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    left, dead = maintain.remove(cat, cat.where("vector_id in (1, 2, 99, 123)"))
    return left.select("vector_id", F.lit("record").alias("kind")).unionByName(dead.withColumn("kind", F.lit("tombstone")))


@query(f"""with {CAT}, s as (select * from cat c where not exists (select 1 from cat f where f.on_disk and coalesce(f.parent_document, f.file_path) = coalesce(c.parent_document, c.file_path)))
select (select count(*) from cat) as records, (select count(*) from s) as stale, (select count(*) from cat where vector_id not in (select vector_id from s)) as valid, (select count(*) from s) as orphans""")
def validate_records(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    files = cat.where("on_disk").select(F.coalesce("parent_document", "file_path").alias("path")).distinct()
    return maintain.validation(cat, files, cat.select(P.thumbnail_name(F.col("file_path")).alias("name")))


@query(f"with {CAT} select vector_id, case when vector_id % 2 = 0 then media_type else 'image' end as media_type, case when vector_id % 2 = 0 then page_number end as page_number from cat")
def migrate_records(spark, sf_dir):
    """Rows of an older layout beside rows of the present one: absent columns are null or have their default."""
    cat = catalogue(spark, sf_dir)
    old, new = cat.where("vector_id % 2 = 1").select("vector_id", "file_path"), cat.where("vector_id % 2 = 0").select("vector_id", "file_path", "media_type", "page_number")
    return maintain.migrated(old.unionByName(new, allowMissingColumns=True)).select("vector_id", "media_type", "page_number")


@query(f"""with {CAT}, d as (select distinct parent_document as path, min(page_number) over (partition by parent_document) as n from cat where parent_document is not null), p as (select path, path || '#page=' || k as file_path, k from d, unnest(range(1, n + 2)) as t(k))
select file_path, path as parent_document, cast(k as int) as page_number from p where file_path not in (select file_path from cat where parent_document is not null)""")
def pages_to_ingest(spark, sf_dir):
    """Pages of documents that have no record yet."""
    cat = catalogue(spark, sf_dir)
    documents = cat.where("parent_document is not null").groupBy(F.col("parent_document").alias("path")).agg((F.min("page_number") + 1).alias("page_count"))
    return page_rows(documents).join(cat.select("file_path"), "file_path", "left_anti").select("file_path", "parent_document", "page_number")
