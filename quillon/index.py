"""A vector index with its catalogue: the calls that a user of the engine makes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import sampling as S
from .functions import vectors as V
from .functions.words import index_type
from .operators import ann, graph, maintain, results, search
from .schema import MOST_PAGES, RECORDS, RESULTS, THUMBNAIL_SIDE, TOP_K, VIDEO_FPS, VIDEO_LEAST_FRAMES, VIDEO_MOST_FRAMES
from .sources import discover
from .sources.media import Decoder, Embedder, embed_rows, page_rows, write_thumbnails
from .sources.scratch import Scratch
from .sources.snapshots import Catalogue, Change

CHUNK_ROWS = 100_000
SLOTS = 1024
SETTINGS = ("nlist", "nprobe", "pq_m", "pq_bits")


def checked(params: dict) -> dict:
    """Index settings: whole numbers from 1, codes of 16 bits at most."""
    for name, value in params.items():
        if name not in SETTINGS:
            raise ValueError(f"{name} isn't one of {', '.join(SETTINGS)}")
        if not isinstance(value, int) or value < 1 or (name == "pq_bits" and value > 16):
            raise ValueError(f"{name} can't be {value}")
    return dict(params)


class VectorIndex:
    def __init__(self, catalogue: Catalogue, name: str, embedder: Embedder, kind: str = "flat", params: dict | None = None):
        """Opened, or made where it isn't there; kind and params (of SETTINGS) count only then, see ``rebuild``."""
        self.spark, self.embedder = catalogue.spark, embedder
        self.store = catalogue.open(name, embedder.dims, index_type(kind))
        if self.store.manifest["embedding_dim"] != embedder.dims:
            raise ValueError(f"the index has {self.store.manifest['embedding_dim']} dimensions, the model {embedder.dims}")
        if params and self.store.manifest["version"] == 1:
            self.store.commit(lambda: Change(settings={"index_params": checked(params)}))
        self._models: dict = {}
        self._walks: list[Scratch] = []

    def refresh(self) -> None:
        """See what other sessions have committed."""
        self.store.refresh()

    # ---- ingest ----

    def add_items(self, items: DataFrame) -> dict:
        """items: file_path, item and what the embedder reads, with any record columns.  All are taken, new vectors replace old ones,
        and of a path that comes twice the last row counts; see ``add_folder`` for skipping what is unchanged."""
        return {"added": self._append(self._embedded(items))}

    def add_batch(self, items: DataFrame, stream: str, number: int) -> dict:
        """As ``add_items``, for a numbered batch of a stream: one that has been committed isn't added again."""
        if self.store.manifest.get("streams", {}).get(stream, -1) >= number:
            return {"added": 0}
        return {"added": self._append(self._embedded(items), lambda _: {"streams": {**self.store.manifest.get("streams", {}), stream: number}})}

    def _embedded(self, items: DataFrame) -> DataFrame:
        columns = [c for c in items.columns if c in self._columns() and c not in ("id", "vector_id", "indexed_at")]
        return embed_rows(self.embedder, items.withColumn("__place", F.monotonically_increasing_id()), [*columns, "__place"])

    def _columns(self) -> list[str]:
        return [c.split()[0] for c in RECORDS.split(", ")]

    def _append(self, embedded: DataFrame, settings: Callable[[int], dict] = lambda added: {}) -> int:
        """embedded: file_path, embedding, __place and any record columns.  Vectors are made once and kept beside the tables until
        they are committed with their records; ``settings`` of the number added go into the same manifest."""
        rows, folder = self.store.stage(embedded.where("embedding is not null"), "embedded")
        if "media_type" not in rows.columns:
            rows = rows.withColumn("media_type", F.coalesce(P.media_type(F.col("file_path")), F.lit("image")))
        rows = maintain.last_of_path(rows, "__place")
        bounds = rows.agg(F.count("*").alias("n"), F.min("file_path").alias("low"), F.max("file_path").alias("high")).first()

        def work() -> Change:
            own = settings(bounds.n)
            if not bounds.n:
                return Change(settings=own)
            new = maintain.append_vectors(self.store.table("vectors"), rows).withColumn("indexed_at", F.current_timestamp()).withColumn("thumbnail_path", P.thumbnail_name(F.col("file_path")))
            fresh = new.drop("embedding").withColumn("id", F.col("vector_id") + 1)
            dead = maintain.superseded(self.store.table("records", bounds.low, bounds.high), fresh)
            return Change(
                upserts={"records": fresh}, appends={"vectors": new.select("vector_id", "embedding"), "tombstones": _tombs(dead)}, settings={"last_indexed": datetime.now(UTC).isoformat(), **own}
            )

        try:
            if bounds.n or settings(0):
                self.store.commit(work)
        finally:
            self.store.files.delete(folder.rsplit("/", 1)[0])
        self._models.clear()
        return bounds.n

    def _todo(self, files: DataFrame, name: str) -> tuple[DataFrame, dict]:
        """What is new or changed among files (path, mtime, size and others), listed once beside the tables; found and changed are
        counted in the same pass."""
        seen = Observation()
        all_files = maintain.flagged(files, self.store.table("records"))
        counted = all_files.observe(seen, F.count(F.lit(1)).alias("found"), F.count_if("changed").alias("changed"))
        slot = F.pmod(F.xxhash64("path"), F.lit(SLOTS)).cast("int")
        todo, folder = self.store.stage(counted.where("changed").drop("changed").withColumn("__slot", slot).sortWithinPartitions("__slot"), name)
        return todo, {**seen.get, "folder": folder.removeprefix(f"{self.store.path}/")}

    def _chunks(self, run: str, files: DataFrame, embedded: Callable[[DataFrame], DataFrame], rows: int, group: str = "path") -> dict:
        """Work through what has changed in chunks of about so many files, each committed with its entry in the run's ledger.  A
        run that has failed goes on behind its last chunk, with the list it had; then files are looked at again."""
        total = {"added": 0, "found": 0, "changed": 0, "groups": 0}
        self.store.refresh()
        while True:
            resumed = self.store.manifest["runs"].get(run)
            if resumed is None:
                todo, seen = self._todo(files, "todo")
                if not seen["changed"]:
                    self.store.files.delete(f"{self.store.path}/{seen['folder'].rsplit('/', 1)[0]}")
                    return {**total, "found": seen["found"]}
                ledger = {"folder": seen["folder"], "chunks": min(SLOTS, math.ceil(seen["changed"] / rows)), "done": 0, "found": seen["found"], "changed": seen["changed"], "groups": todo.select(group).distinct().count() if group != "path" else seen["changed"]}
                self.store.commit(lambda ledger=ledger: Change(settings=self._ledger(run, ledger)))
            ledger = self.store.manifest["runs"][run]
            todo = self.spark.read.parquet(f"{self.store.path}/{ledger['folder']}")
            before = todo.where(F.col("__slot") < ledger["done"] * SLOTS // ledger["chunks"]).count() if ledger["done"] else 0
            for chunk in range(ledger["done"], ledger["chunks"]):
                low, high = chunk * SLOTS // ledger["chunks"], (chunk + 1) * SLOTS // ledger["chunks"]
                part = todo.where((F.col("__slot") >= low) & (F.col("__slot") < high)).drop("__slot")
                last = chunk + 1 == ledger["chunks"]
                total["added"] += self._append(embedded(part), lambda _, at=chunk, last=last: self._ledger(run, None if last else {**ledger, "done": at + 1}))
            self.store.files.delete(f"{self.store.path}/{ledger['folder'].rsplit('/', 1)[0]}")
            total["changed"] += ledger["changed"] - before
            total["groups"] += ledger["groups"]
            total["found"] = ledger["found"]
            if resumed is None:
                return total

    def _ledger(self, run: str, entry: dict | None) -> dict:
        runs = {k: v for k, v in self.store.manifest["runs"].items() if k != run}
        return {"runs": runs if entry is None else {**runs, run: entry}}

    def add_videos(self, videos: DataFrame, read_frames: Callable[[DataFrame], DataFrame], fps: float = VIDEO_FPS, most: int = VIDEO_MOST_FRAMES, least: int = VIDEO_LEAST_FRAMES, chunk_rows: int = CHUNK_ROWS, probe: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """videos: path, mtime, size, fps, frame_count (the last two from ``probe``, if it is given, for changed ones only).  Changed ones are
        sampled at a rate, read (``read_frames`` turns path, pos, frame into path, pos, item and what the embedder reads), embedded by frame
        and averaged; a video without frames fails."""
        columns = videos.select("path", "mtime", "size", *(() if probe else ("fps", "frame_count")))

        def embedded(todo: DataFrame) -> DataFrame:
            todo = probe(todo) if probe else todo
            indices = S.padded(S.fps_indices(F.col("frame_count"), F.col("fps"), fps, most), least)
            each = embed_rows(self.embedder, read_frames(S.frame_rows(todo, indices)), ["path", "pos"])
            own = todo.select(
                F.col("path").alias("file_path"), F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size"), F.col("frame_count").cast("int").alias("frame_count"),
                S.duration(F.col("frame_count"), F.col("fps")).alias("duration_seconds"), F.lit("video").alias("media_type"), F.lit(0).alias("__place"),
            )
            return V.chunked_mean(each.where("embedding is not null"), "path").withColumnRenamed("path", "file_path").join(own, "file_path")

        out = self._chunks("videos", columns, embedded, chunk_rows)
        return {"added": out["added"], "videos": out["added"], "skipped": out["found"] - out["changed"], "failed": out["changed"] - out["added"]}

    def add_documents(self, documents: DataFrame, read_pages: Callable[[DataFrame], DataFrame], most: int = MOST_PAGES, chunk_rows: int = CHUNK_ROWS) -> dict:
        """documents: path, mtime, size, page_count.  Changed pages are read (``read_pages`` adds item and what the embedder reads
        to file_path, parent_document, page_number; a page it leaves out fails) and become a record each."""
        pages = page_rows(documents, most).join(documents.select(F.col("path").alias("parent_document"), "mtime", "size"), "parent_document")

        def embedded(todo: DataFrame) -> DataFrame:
            items = read_pages(todo.withColumnRenamed("path", "file_path"))
            return self._embedded(items.withColumn("media_type", F.lit("document")).withColumn("file_mtime", F.col("mtime")).withColumn("file_size", F.col("size")))

        out = self._chunks("documents", pages.withColumnRenamed("file_path", "path"), embedded, chunk_rows, "parent_document")
        return {"added": out["added"], "documents": out["groups"], "pages": out["added"], "skipped": out["found"] - out["changed"], "failed": out["changed"] - out["added"]}

    def add_folder(self, folder: str, recursive: bool = True, kinds=("image", "video", "document"), describe=None, chunk_rows: int = CHUNK_ROWS, decoder: Decoder | None = None) -> dict:
        """Scan, skip what is unchanged, embed the rest, a chunk of files to a commit; called again after a failure it goes on behind the
        last chunk.  ``describe`` turns the listing into items (default: the path as text).  With a decoder pictures, videos by their frames and
        documents by their pages go through it, and are counted by kind."""
        files = discover.scan_folder(self.spark, folder, recursive, kinds)
        name = P.trimmed(folder)

        def embedded(todo: DataFrame) -> DataFrame:
            read = describe or (decoder.pictures if decoder else lambda rows: rows.withColumn("text", F.col("path")))
            return self._embedded(read(todo).select("*", F.col("path").alias("item"), F.col("path").alias("file_path"), F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size")))

        own = files.where("media_type = 'image'") if decoder else files
        out = self._chunks(f"folder {name}", own, embedded, chunk_rows)
        counts = {"added": out["added"], "skipped": out["found"] - out["changed"], "failed": out["changed"] - out["added"]}
        if decoder:
            counts["images"] = out["added"]
            if "video" in kinds:
                got = self.add_videos(files.where("media_type = 'video'"), decoder.frames, chunk_rows=chunk_rows, probe=decoder.videos)
                counts = {k: v + got.get(k, 0) for k, v in counts.items()} | {"videos": got["videos"]}
            if "document" in kinds:
                got = self._add_listed_documents(files.where("media_type = 'document'"), decoder, chunk_rows)
                counts = {k: v + got.get(k, 0) for k, v in counts.items()} | {"documents": got["documents"], "pages": got["pages"]}

        def track() -> Change:
            folders = self.store.table("folders")
            row = self.spark.createDataFrame([(name, recursive)], "folder_path string, recursive boolean").select(F.lit(folders.count() + 1).cast("long").alias("id"), "folder_path", "recursive", F.current_timestamp().alias("added_at"))
            return Change(tables={"folders": maintain.upsert(folders, row, "folder_path")})

        self.store.commit(track)
        return counts

    def _add_listed_documents(self, files: DataFrame, decoder: Decoder, chunk_rows: int) -> dict:
        """Only documents without records of their time and size are opened; the pages of the others are skipped."""
        pages = self.store.table("records").where("parent_document is not null").select(F.col("parent_document").alias("path"), F.col("file_mtime").alias("mtime"), F.col("file_size").alias("size"))
        same = ["path", "mtime", "size"]
        skipped = pages.join(files.select(*same), same, "left_semi").count()
        out = self.add_documents(decoder.documents(files.join(pages.distinct(), same, "left_anti").select(*same)), decoder.pages, chunk_rows=chunk_rows)
        return {**out, "skipped": out["skipped"] + skipped}

    def make_thumbnails(self, folder: str, decoder: Decoder, side: int = THUMBNAIL_SIDE) -> None:
        """Write the thumbnails that records ask for and a folder doesn't have."""
        names = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name")) if self.store.files.exists(folder) else self.spark.createDataFrame([], "name string")
        records = self.store.table("records")
        write_thumbnails(decoder.thumbnails(discover.missing_thumbnails(records, names).join(records, "file_path"), side), folder)

    # ---- search ----

    def search_vector(self, query: Sequence[float], k: int = TOP_K, kind: str = "all", least: float = 0.0, on_disk: DataFrame | None = None, method: str | None = None, filter_mode: str = "post", nprobe: int | None = None) -> DataFrame:
        """The best k.  Filters shrink the list afterwards (``post``) or come before the cut (``pre``)."""
        if len(query) != self.embedder.dims:
            raise ValueError(f"the query has {len(query)} dimensions, the index {self.embedder.dims}")
        records, some = self.store.table("records"), None
        if filter_mode == "pre":
            some = self.store.table("vectors").join(results.of_kind(records, kind).select("vector_id"), "vector_id", "left_semi")
        hits = self._hits(some, query, k, method or self.store.manifest["index_type"], nprobe)
        found = results.above(results.of_kind(search.with_records(hits, records, on_disk), kind), least)
        return found.select(*[p.split()[0] for p in RESULTS.split(", ")]).orderBy("rank")

    def search_batch(self, queries: DataFrame, k: int = TOP_K, method: str | None = None, nprobe: int | None = None) -> DataFrame:
        """query_id, vector_id, score, rank for a table of queries (query_id, embedding): exact, by inverted lists or their codes (a query
        meets the lists it probes), or by the graph (``method="graph"``)."""
        method, whole = self.actual_type(method), self.store.table("vectors")
        if method == "graph":
            edges, beam = self._graph()
            return graph.search(edges, whole, queries, self._scratch(), k, beam)
        if method == "ivf_flat":
            model, rows = self._lists()
            return model.routed(rows, queries, k, nprobe or self._params().get("nprobe"))
        if method == "ivf_pq":
            model, rows = self._codes()
            return model.batch(rows, queries, k, nprobe=nprobe or self._params().get("nprobe"))
        return search.batch_topk(whole, queries, k)

    def search_batch_without(self, queries: DataFrame, negatives: DataFrame, k: int = TOP_K, threshold: float = 0.3) -> DataFrame:
        """As ``search_batch``, exact, but for what is near any of a query's negatives (query_id, embedding)."""
        return search.exclude_batch(self.store.table("vectors"), queries, negatives, threshold, k)

    def _params(self) -> dict:
        return self.store.manifest["index_params"]

    def _nlist(self) -> int:
        return self._params().get("nlist") or ann.lists_for(self._size(), self.embedder.dims)

    def actual_type(self, method: str | None = None) -> str:
        """What a search by this method (default: the index's) is served by: exact search where there are too few vectors to train
        on, or codes don't divide the dimensions."""
        method = method or self.store.manifest["index_type"]
        few = self._size() < ann.least_training(self._nlist())
        return "flat" if method == "flat" or few or (method == "ivf_pq" and self.embedder.dims % self._code_shape()[0]) else method

    def _hits(self, vectors: DataFrame, query, k: int, method: str, nprobe: int | None) -> DataFrame:
        """By the index type; exact where it can't be trained, and where rows were filtered first.

        Lists, buckets and codes are kept beside the vectors, a folder for each of their segments, partitioned by what a query
        probes.  An append adds a folder; centres are trained again when rows have drifted from them."""
        whole, nprobe = self.store.table("vectors"), nprobe or self._params().get("nprobe")
        if vectors is not None or self.actual_type(method) == "flat":
            return search.flat_topk(whole if vectors is None else vectors, query, k)
        if method == "ivf_flat":
            model, rows = self._lists()
            return model.search(rows, query, k, nprobe)
        if method == "graph":
            one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<float>")
            edges, beam = self._graph()
            return graph.search(edges, whole, one, self._scratch(), k, beam).drop("query_id")
        if method == "hnsw":
            model, rows = self._postings()
            return model.search(rows, query, k)
        model, rows = self._codes()
        return model.search(rows, query, k, nprobe=nprobe)

    def _lists(self) -> tuple[ann.Ivf, DataFrame]:
        def make() -> tuple[ann.Ivf, DataFrame]:
            def train() -> tuple[DataFrame, dict]:
                made = ann.Ivf.train(self.store.table("vectors"), self._nlist())
                return made.table(self.spark), {"loss": made.loss, "rows": self._size(), "nlist": self._nlist()}

            def assigned(uid: str, model: ann.Ivf) -> tuple[DataFrame, list[dict]]:
                return self.store.derived("ivf_vectors", uid, lambda rows: model.dealt(model.measured(rows)), model.folders(), [F.avg("__loss").alias("loss")])

            fixed = self._params().get("nlist")
            notes, table = self.store.model("ivf", train, lambda n: bool(fixed) and n["nlist"] != fixed)
            model = ann.Ivf.load(table)
            rows, stats = assigned(notes["uid"], model)
            if ann.drifted(notes, stats, bool(fixed)):
                old = notes["uid"]
                notes, table = self.store.model("ivf", train, lambda n: n["uid"] == old)
                model = ann.Ivf.load(table)
                rows, _ = assigned(notes["uid"], model)
            return model, rows

        model, rows = self._model("lists", make)
        self._models["ivf_flat"] = model
        return model, rows

    def _postings(self) -> tuple[ann.SignHashes, DataFrame]:
        def make() -> tuple[ann.SignHashes, DataFrame]:
            notes, table = self.store.model("sign", lambda: (ann.SignHashes.train(self.store.table("vectors"), self.embedder.dims).table(self.spark), {}))
            model = ann.SignHashes.load(table)
            return model, self.store.derived("sign_postings", notes["uid"], lambda rows: model.assign(rows).hint("rebalance", "bucket"), ["bucket"])[0]

        model, rows = self._model("postings", make)
        self._models["hnsw"] = model
        return model, rows

    def _codes(self) -> tuple[ann.Pq, DataFrame]:
        """Codes of what differs from the inverted lists' places: trained with them, and again when they are."""

        def make() -> tuple[ann.Pq, DataFrame]:
            lists, shape = self._lists()[0], list(self._code_shape())
            under = self.store.log_of("ivf").last()[1]["uid"]
            notes, table = self.store.model("pq", lambda: (ann.Pq.train(self.store.table("vectors"), *shape, lists=lists).table(self.spark), {"lists": under, "shape": shape}), lambda n: n["lists"] != under or n["shape"] != shape)
            model = ann.Pq.load(table, lists)
            return model, self.store.derived("pq_vectors", notes["uid"], lambda rows: lists.dealt(model.encode(rows)), lists.folders())[0]

        model, rows = self._model("codes", make)
        self._models["ivf_pq"] = model
        return model, rows

    def _graph(self) -> tuple[DataFrame, int]:
        """The neighbour graph of the present vectors, and the beam fitted to it; vectors of another set of segments need another graph."""

        def make() -> tuple[DataFrame, int]:
            now = self.store.versions("vectors")
            with Scratch(self.spark) as scratch:

                def built() -> tuple[DataFrame, dict]:
                    vectors = self.store.table("vectors")
                    edges = graph.build(vectors, scratch)
                    return edges, {"segments": now, "beam": graph.fitted(edges, vectors, scratch), "part_rows": graph.GRAPH_ROWS}

                notes, edges = self.store.model("graph", built, lambda n: n["segments"] != now or n.get("part_rows") != graph.GRAPH_ROWS)
            return edges, notes.get("beam", graph.BEAM)

        return self._model("graph", make)

    def _scratch(self) -> Scratch:
        """A folder for the rounds of a walk; those of earlier walks go with ``close``."""
        self._walks.append(Scratch(self.spark))
        return self._walks[-1]

    def close(self) -> None:
        """Drop what searches by the graph have stored; their results can't be read after that."""
        while self._walks:
            self._walks.pop().close()

    def _code_shape(self) -> tuple[int, int]:
        return self._params().get("pq_m", 8), self._params().get("pq_bits", 8)

    def _model(self, what: str, make):
        """``make()``, kept while the vectors and settings stand."""
        state = (tuple(self.store.versions("vectors")), str(self._params()))
        if self._models.get("state") != state:
            self._models = {"state": state}
        if what not in self._models:
            made = make()
            self._models[what] = made
        return self._models[what]

    def _size(self) -> int:
        return sum(s["rows"] for s in self.store.segments("vectors"))

    def embed_text(self, text: str) -> list[float]:
        row = self.embedder.embed(self.spark.createDataFrame([("q", text)], "item string, text string")).first()
        return list(row.embedding) if row else [0.0] * self.embedder.dims

    def search_text(self, text: str, k: int = TOP_K, **options) -> DataFrame:
        """Blank text finds nothing."""
        if not (text or "").strip():
            return results.tagged(self.spark.createDataFrame([], RESULTS), "text", text or "")
        return results.tagged(self.search_vector(self.embed_text(text), k, **options), "text", text)

    def search_path(self, path: str, page: int | None = None, k: int = TOP_K, **options) -> DataFrame:
        """What is like a stored picture, video or document page, tagged with its kind and path; one that isn't stored finds nothing."""
        name = f"{path}#page={page}" if page is not None else path
        row = self.record(name).join(self.store.table("vectors"), "vector_id").select("embedding", "media_type").first()
        found = self.search_vector(list(row.embedding), k, **options) if row else self.spark.createDataFrame([], RESULTS)
        return results.tagged(found, row.media_type if row else "document" if page is not None else "image", name)

    def search_item(self, item: DataFrame, k: int = TOP_K, query_type: str = "image", query_info: str = "", **options) -> DataFrame:
        """What is like a picture, page or text that needn't be stored: one row of item and what the embedder reads.  A row that
        the embedder gives no vector finds nothing."""
        row = self.embedder.embed(item).first()
        found = self.search_vector(list(row.embedding), k, **options) if row and row.embedding else self.spark.createDataFrame([], RESULTS)
        return results.tagged(found, query_type, query_info)

    def search_page(self, document: str, page: int, read_pages: Callable[[DataFrame], DataFrame], k: int = TOP_K, **options) -> DataFrame:
        """By a page of any document; a page that ``read_pages`` leaves out finds nothing."""
        asked = self.spark.createDataFrame([(document, page, f"{document}#page={page}")], "parent_document string, page_number int, file_path string")
        return self.search_item(read_pages(asked), k, "document", f"{document}#page={page}", **options)

    def search_video(self, video: DataFrame, read_frames: Callable[[DataFrame], DataFrame], k: int = TOP_K, most: int = 32, **options) -> DataFrame:
        """By any video (one row of path, frame_count): evenly spread frames, averaged; without frames nothing is found."""
        frames = read_frames(S.frame_rows(video, S.uniform_indices(F.col("frame_count"), most)))
        each = embed_rows(self.embedder, frames, ["pos"]).where("embedding is not null")
        return results.tagged(self.search_frames(each, k, **options), "video", video.first().path)

    def search_frames(self, frames: DataFrame, k: int = TOP_K, **options) -> DataFrame:
        """What is like a video whose frames (pos, embedding) are given: by their mean; no frames find nothing."""
        row = V.chunked_mean(frames.withColumn("video", F.lit(0)), "video").first()
        return self.search_vector(list(row.embedding), k, **options) if row else self.spark.createDataFrame([], RESULTS)

    def record(self, path: str) -> DataFrame:
        """By path, from the segments whose keys may hold it."""
        return self.store.table("records", path, path)

    def records_of(self, vector_ids: Sequence[int] | DataFrame) -> DataFrame:
        """Records of some vectors: a list of ids, or a table of them (vector_id)."""
        records = self.store.table("records")
        return records.join(vector_ids.select("vector_id").distinct(), "vector_id", "left_semi") if isinstance(vector_ids, DataFrame) else records.where(F.col("vector_id").isin(list(vector_ids)))

    def rerank(self, found: DataFrame, text: str | None = None, k: int = 10, least: float = 0.0, judge: Callable[[], Callable[[list], list[float]]] | None = None) -> DataFrame:
        """With ``judge``, by a judging model (see ``results.rerank_by_model``).  Else the results of a search in a second order: by the sigmoid of the scaled inner product with another text, with the searched
        one, or with the stored picture or page that was searched by.  Results of other kinds of queries pass through unchanged."""
        if judge is not None:
            return results.rerank_by_model(found, judge, text, k, least)
        query = None
        if (text or "").strip():
            query = self.embed_text(text)
        else:
            row = found.select("query_type", "query_info").first() if "query_type" in found.columns else None
            if row is not None and row.query_type in ("text", "text_with_exclusion"):
                query = self.embed_text(row.query_info)
            elif row is not None and row.query_type == "image":
                stored = self.record(row.query_info or "").join(self.store.table("vectors"), "vector_id").select("embedding").first()
                query = list(stored.embedding) if stored else None
        return found if query is None else results.rerank_by_vector(found, self.store.table("vectors"), query, k, least)

    def search_without(self, text: str, unwanted: str, k: int = TOP_K, threshold: float = 0.3) -> DataFrame:
        """Text search but for what is near any of the comma-separated terms."""
        terms = [t.strip() for t in (unwanted or "").split(",") if t.strip()]
        tag = ("text_with_exclusion", f"{text} NOT ({', '.join(terms)})") if terms else ("text", text or "")
        if not (text or "").strip():
            return results.tagged(self.spark.createDataFrame([], RESULTS), *tag)
        hits = search.exclude(self.store.table("vectors"), self.embed_text(text), [self.embed_text(t) for t in terms], threshold, k)
        found = search.with_records(hits, self.store.table("records")).select(*[p.split()[0] for p in RESULTS.split(", ")]).orderBy("rank")
        return results.tagged(found, *tag)

    # ---- maintenance ----

    def remove_folder(self, folder: str) -> int:
        low = P.trimmed(folder) + "/"

        def work() -> Change:
            doomed = maintain.in_folder(self.store.table("records", low, low[:-1] + "0"), folder)  # "0" follows "/"
            folders = self.store.table("folders").where(F.col("folder_path") != P.trimmed(folder))
            return Change(tables={"folders": folders}, deletes={"records": doomed}, appends={"tombstones": _tombs(doomed)})

        return self.store.commit(work)["records"]["rows"]

    def folders(self) -> DataFrame:
        return self.store.table("folders").orderBy("added_at", "folder_path")

    def untrack(self, folder: str) -> None:
        """Forget a folder, keep its records."""
        self.store.commit(lambda: Change(tables={"folders": self.store.table("folders").where(F.col("folder_path") != P.trimmed(folder))}))

    def validate(self, files: DataFrame, clean: bool = False, thumbnails: str | None = None) -> int:
        """How many records have lost their file; with ``clean`` they go, and so do the thumbnails in a folder that no record asks for."""
        lost = lambda: maintain.stale(self.store.table("records"), files)
        n = lost().count()
        if clean and n:
            self.store.commit(lambda: Change(deletes={"records": lost()}, appends={"tombstones": _tombs(lost())}))
        if clean and thumbnails:
            names = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(thumbnails).select(F.element_at(F.split("path", "/"), -1).alias("name"))
            discover.delete_files(self.spark, thumbnails, maintain.orphans(names, self.store.table("records")))
        return n

    def compact(self) -> int:
        """Drop vectors that nothing refers to; nothing happens without tombstones.  Returns how many went."""
        if self.store.table("tombstones").isEmpty():
            return 0
        before = self._size()

        def work() -> Change:
            records, kept, _ = maintain.compact(self.store.table("records"), self.store.table("vectors"))
            return Change(tables={"records": records, "vectors": kept, "tombstones": self.store.table("tombstones").limit(0)})

        self.store.commit(work)
        self.store.vacuum()
        self._models.clear()
        return before - self._size()

    def rebuild(self, kind: str | None = None, **params) -> dict:
        """The same vectors under another index type or other settings (of SETTINGS), trained and written now.  Returns the type asked
        for and the one that searches are served by, which is flat where it can't be trained."""
        wanted = index_type(kind or self.store.manifest["index_type"])
        params = {**self._params(), **checked(params)}
        self.store.commit(lambda: Change(settings={"index_type": wanted, "index_params": params}))
        self._models.clear()
        actual = self.actual_type()
        if actual != "flat":
            {"ivf_flat": self._lists, "hnsw": self._postings, "ivf_pq": self._codes, "graph": self._graph}[actual]()
        return {"index_type": wanted, "actual_type": actual}

    def stats(self) -> DataFrame:
        s = self.store
        return maintain.stats(s.table("records"), s.table("vectors"), s.table("tombstones"), s.table("folders")).withColumn("index_type", F.lit(s.manifest["index_type"])).withColumn("actual_type", F.lit(self.actual_type())).withColumn("dims", F.lit(s.manifest["embedding_dim"]))


def _tombs(dead: DataFrame) -> DataFrame:
    return dead.select(F.col("vector_id").alias("id"), "vector_id", F.current_timestamp().alias("deleted_at"))


def search_indexes(indexes: Sequence[VectorIndex], text: str, k: int = TOP_K, normalise: bool = True, kind: str = "all", least: float = 0.0) -> DataFrame:
    """One text over several indexes, merged."""
    found = [i.search_text(text, max(k, TOP_K)) for i in indexes]
    return results.tagged(results.above(results.of_kind(search.merge_indexes(found, k, normalise), kind), least), "text", text)
