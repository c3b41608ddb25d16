"""A catalogue of indexes: immutable segments of Parquet files, and a log of manifests that names those of each version.

Every write adds segments under names of their own and then the next manifest of the log.  Only one writer can create a given manifest: it is
written as a draft and moved to its place, which fails where another one is there (atomic on HDFS and its like, as Spark's own
streaming log needs it; a store without such a move needs one writer).  ``commit`` then drops its segments, looks at the
new state and does its work again, so that two writers lose nothing.  A reader sees the version that it has opened until ``refresh``.

Tables with a key (records by path) are merged on read: a change is a delta segment of new rows and of keys that are gone, with
the range of its keys, so that what is written follows the change.  A later segment's row of a key hides the earlier ones.  When
there are over ``MOST_DELTAS``, they are folded: into one, or with the base where they have grown to a quarter of it.  Tables that
only grow are appended to, and the smaller half of their segments becomes one when there are over ``MOST_SEGMENTS``.  Folders are
reached through Hadoop's file systems, local or remote.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema

TABLES = {"records": schema.RECORDS, "vectors": schema.VECTORS, "tombstones": schema.TOMBSTONES, "folders": schema.FOLDERS}
KEYS = {"records": "file_path"}
ORDER = {"records": "file_path", "vectors": "vector_id", "tombstones": "vector_id", "folders": "folder_path"}
MOST_DELTAS, FOLD_SHARE, MOST_SEGMENTS, ATTEMPTS = 8, 0.25, 32, 20
GRACE_S = 3600.0


class CommitConflict(RuntimeError):
    """Another writer has committed meanwhile, and the work can't be done again."""


@dataclass
class Change:
    """What a commit does: whole new tables, rows added to tables, rows that take the place of those with their key, keys that go
    (one column), and settings of the manifest."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    appends: dict[str, DataFrame] = field(default_factory=dict)
    upserts: dict[str, DataFrame] = field(default_factory=dict)
    deletes: dict[str, DataFrame] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)


class Files:
    """Small files and folders by Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def age(self, path: str) -> float:
        fs, p = self.at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def delete(self, path: str) -> bool:
        fs, p = self.at(path)
        return bool(fs.delete(p, True))

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self.at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def claim(self, draft: str, path: str) -> bool:
        """Move a file or folder to a place where none may be; where one is, it goes and the answer is False."""
        (fs, a), (_, b) = self.at(draft), self.at(path)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(a), fs.makeQualified(b), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            fs.delete(a, True)
            return False
        return True


class Log:
    """Numbered documents of one folder, each created once."""

    def __init__(self, files: Files, path: str):
        self.files, self.path = files, path

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(self.path) if n.endswith(".json") and not n.startswith(".")]

    def read(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/{number:012d}.json"))

    def last(self) -> tuple[int, dict | None]:
        held = self.numbers()
        return (held[-1], self.read(held[-1])) if held else (0, None)

    def put(self, number: int, document: dict) -> bool:
        draft = f"{self.path}/.{uuid.uuid4().hex}.draft"
        self.files.write(draft, json.dumps(document))
        return self.files.claim(draft, f"{self.path}/{number:012d}.json")


class Catalogue:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self._opened: dict[str, Snapshots] = {}

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.exists(f"{self.root}/{n}/versions")]

    def choices(self) -> list[str]:
        return self.names() or ["default"]

    def open(self, name: str, dims: int = 4096, index_type: str = "flat") -> Snapshots:
        """The index of that name, made where it isn't there; settings count only then."""
        if name not in self._opened:
            self._opened[name] = Snapshots(self, name, dims, index_type)
        return self._opened[name]

    def delete(self, name: str) -> bool:
        if not name or "/" in name or name not in self.names():
            return False
        self._opened.pop(name, None)
        return self.files.delete(f"{self.root}/{name}")


def _uid() -> str:
    return f"{time.time_ns():020d}{uuid.uuid4().hex[:8]}"


class Snapshots:
    """The tables of one index, by version."""

    def __init__(self, catalogue: Catalogue, name: str, dims: int, index_type: str):
        self.catalogue, self.spark, self.files, self.path = catalogue, catalogue.spark, catalogue.files, f"{catalogue.root}/{name}"
        self.log = Log(self.files, f"{self.path}/versions")
        number, self.manifest = self.log.last()
        if not number:
            now = datetime.now(UTC).isoformat()
            tables = {n: {"base": [], "deltas": []} for n in TABLES}
            self.manifest = {"index_name": name, "embedding_dim": dims, "index_type": index_type, "created_at": now, "last_indexed": None, "model_used": None, "index_params": {}, "version": 1, "tables": tables, "runs": {}}
            if not self.log.put(1, self.manifest):
                self.refresh()

    def refresh(self) -> None:
        """Look at the newest version."""
        self.manifest = self.log.last()[1]

    # ---- reading ----

    def segments(self, name: str) -> list[dict]:
        held = self.manifest["tables"][name]
        return [*held["base"], *held["deltas"]]

    def versions(self, name: str) -> list[str]:
        """The folders whose files make up a table, in the order they came."""
        return [s["path"] for s in self.segments(name)]

    def table(self, name: str, low: str | None = None, high: str | None = None) -> DataFrame:
        """The present rows; columns that older files lack have their defaults.  Of a table with a key only the segments that may
        hold keys from low to high are read, if these are given."""
        held = self.manifest["tables"][name]
        meets = lambda s: (low is None or s["high"] is None or s["high"] >= low) and (high is None or s["low"] is None or s["low"] <= high)
        base, deltas = [s for s in held["base"] if meets(s)], [s for s in held["deltas"] if meets(s)]
        rows = self._read(name, [s["path"] for s in base], TABLES[name])
        if deltas:
            newest = self._newest(name, deltas)
            rows = rows.join(newest.select(KEYS[name]), KEYS[name], "left_anti").unionByName(newest.where("not gone").drop("gone"))
        if low is not None or high is not None:
            key = F.col(KEYS.get(name, ORDER[name]))
            rows = rows.where((key >= low if low is not None else F.lit(True)) & (key <= high if high is not None else F.lit(True)))
        return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in schema.DEFAULTS.items() if c in rows.columns})

    def _read(self, name: str, paths: list[str], kind: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("mergeSchema", "true").parquet(*[f"{self.path}/{p}" for p in paths])

    def _newest(self, name: str, deltas: list[dict]) -> DataFrame:
        """The last word of the deltas on each of their keys: its row, or that it is gone."""
        kind, key = f"{TABLES[name]}, gone boolean", KEYS[name]
        rows = self._read(name, [deltas[0]["path"]], kind)
        if len(deltas) == 1:
            return rows
        rows = rows.withColumn("__seq", F.lit(0))
        for i, s in enumerate(deltas[1:], 1):
            rows = rows.unionByName(self._read(name, [s["path"]], kind).withColumn("__seq", F.lit(i)))
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__seq")))
        return rows.withColumn("__place", place).where("__place = 1").drop("__place", "__seq")

    # ---- writing ----

    def commit(self, work: Callable[[], Change], attempts: int = ATTEMPTS) -> dict[str, dict]:
        """Do what ``work()`` says about the present version; called again on the newer one where another writer was faster.
        Returns the segments written, by table."""
        for left in range(attempts, 0, -1):
            change = work()
            uid = f"s-{_uid()}"
            written, tables = self._segments(change, uid)
            new = {**self.manifest, **change.settings, "version": self.manifest["version"] + 1, "tables": tables}
            if self.log.put(new["version"], new):
                self.manifest = new
                return written
            self.files.delete(f"{self.path}/{uid}")
            if left > 1:
                self.refresh()
        raise CommitConflict(f"version {self.manifest['version'] + 1} of {self.path} is another writer's")

    def write(self, tables: dict[str, DataFrame], appends: dict[str, DataFrame] | None = None, **settings) -> None:
        """One attempt with tables that were made from the version that is open."""
        self.commit(lambda: Change(tables=tables, appends=appends or {}, settings=settings), 1)

    def _segments(self, change: Change, uid: str) -> tuple[dict[str, dict], dict]:
        written: dict[str, dict] = {}
        tables = {n: {"base": list(t["base"]), "deltas": list(t["deltas"])} for n, t in self.manifest["tables"].items()}
        for name, df in change.tables.items():
            written[name] = self._segment(name, df, f"{uid}/{name}")
            tables[name] = {"base": [written[name]], "deltas": []}
        for name, df in change.appends.items():
            written[name] = self._segment(name, df, f"{uid}/{name}")
            if written[name]["rows"]:
                tables[name]["base"].append(written[name])
            self._gather(name, tables[name], uid)
        for name in {**change.upserts, **change.deletes}:
            parts = []
            if name in change.upserts:
                parts.append(_shaped(self.spark, change.upserts[name], TABLES[name]).withColumn("gone", F.lit(False)))
            if name in change.deletes:
                parts.append(_shaped(self.spark, change.deletes[name].select(KEYS[name]).distinct(), TABLES[name]).withColumn("gone", F.lit(True)))
            delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            written[name] = self._segment(name, delta, f"{uid}/{name}", f"{TABLES[name]}, gone boolean")
            if written[name]["rows"]:
                tables[name]["deltas"].append(written[name])
            self._fold(name, tables[name], uid)
        return written, tables

    def _gather(self, name: str, held: dict, uid: str) -> None:
        """One segment of many small ones."""
        if len(held["base"]) > MOST_SEGMENTS:
            small = sorted(held["base"], key=lambda s: s["rows"])[: len(held["base"]) // 2 + 1]
            rows = self._read(name, [s["path"] for s in small], TABLES[name])
            held["base"] = [s for s in held["base"] if s not in small] + [self._segment(name, rows, f"{uid}/{name}-gathered")]

    def _fold(self, name: str, held: dict, uid: str) -> None:
        """One delta of many; the first rows of a table are its base."""
        if not held["base"] and len(held["deltas"]) == 1:
            rows = self._read(name, [held["deltas"][0]["path"]], f"{TABLES[name]}, gone boolean").where("not gone").drop("gone")
            held["base"], held["deltas"] = [self._segment(name, rows, f"{uid}/{name}-base")], []
        elif len(held["deltas"]) > MOST_DELTAS:
            newest, old = self._newest(name, held["deltas"]), sum(s["rows"] for s in held["base"])
            if sum(s["rows"] for s in held["deltas"]) < FOLD_SHARE * old:
                held["deltas"] = [self._segment(name, newest, f"{uid}/{name}-folded", f"{TABLES[name]}, gone boolean")]
            else:
                base = self._read(name, [s["path"] for s in held["base"]], TABLES[name])
                merged = base.join(newest.select(KEYS[name]), KEYS[name], "left_anti").unionByName(newest.where("not gone").drop("gone"))
                held["base"], held["deltas"] = [self._segment(name, merged, f"{uid}/{name}-folded")], []

    def _segment(self, name: str, df: DataFrame, path: str, kind: str | None = None) -> dict:
        """Write rows in the order of the table's key; their number and the range of keys are observed on the way."""
        key, seen = ORDER[name], Observation()
        rows = _shaped(self.spark, df, kind or TABLES[name]).repartitionByRange(key).sortWithinPartitions(key)
        keys = [F.min(key).alias("low"), F.max(key).alias("high")] if name in KEYS else []
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), *keys).write.mode("overwrite").parquet(f"{self.path}/{path}")
        got = seen.get
        return {"path": path, "rows": got["rows"], "low": got.get("low"), "high": got.get("high")}

    def stage(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """Rows that are dear to make, written once beside the tables; their folder is the caller's to drop."""
        top = f"{self.path}/staged-{_uid()}"
        folder = f"{top}/{name}"
        try:
            df.write.parquet(folder)
        except Exception:
            self.files.delete(top)
            raise
        return self.spark.read.schema(df.schema).parquet(folder), folder

    # ---- tables made from others ----

    def log_of(self, model: str) -> Log:
        """The trainings of a model."""
        return Log(self.files, f"{self.path}/models/{model}")

    def model(self, name: str, make: Callable[[], tuple[DataFrame, dict]], stale: Callable[[dict], bool] = lambda _: False) -> tuple[dict, DataFrame]:
        """A trained model: its notes and its table.  It is made where there is none, or where ``stale(notes)``; every training is an
        entry of a log, so that two sessions that train at once agree on one."""
        log = self.log_of(name)
        number, notes = log.last()
        if notes is None or stale(notes):
            uid = _uid()
            table, more = make()
            table.write.parquet(f"{self.path}/models/{name}/{uid}")
            log.put(number + 1, {**more, "uid": uid})
            notes = log.last()[1]
        return notes, self.spark.read.parquet(f"{self.path}/models/{name}/{notes['uid']}")

    def derived_name(self, name: str, source: str) -> str:
        """Where the rows made of the last segment of ``source`` are kept: a folder for each model and segment."""
        model = self.log_of(DERIVED[name]).last()[1]
        return f"{name}-{model['uid'] if model else ''}/segment={self._tag(self.versions(source)[-1]) if self.versions(source) else ''}"

    def _tag(self, segment: str) -> str:
        return segment.split("/")[0].removeprefix("s-")

    def derived(self, name: str, uid: str, make: Callable[[DataFrame], DataFrame], partition_by: list[str], notes: list | None = None, source: str = "vectors") -> tuple[DataFrame | None, list[dict]]:
        """Rows that ``make`` gives for each segment of ``source`` under the model ``uid``, written when they are first asked for: an
        append adds one folder.  The notes (aggregates named by alias) of each segment are observed as it is written."""
        root, stats = f"{self.path}/derived/{name}-{uid}", []
        for segment in self.segments(source):
            folder = f"{root}/segment={self._tag(segment['path'])}"
            if not self.files.exists(folder):
                seen, draft = Observation(), f"{root}/_draft-{_uid()}"
                rows = make(self._read(source, [segment["path"]], TABLES[source])).observe(seen, F.count(F.lit(1)).alias("rows"), *(notes or []))
                drop = [c for c in rows.columns if c.startswith("__")]
                rows.drop(*drop).write.partitionBy(*partition_by).parquet(draft)
                self.files.write(f"{draft}/_notes.json", json.dumps(seen.get))
                self.files.claim(draft, folder)
            stats.append(json.loads(self.files.read(f"{folder}/_notes.json")))
        folders = [f"{root}/segment={self._tag(s['path'])}" for s in self.segments(source)]
        folders = [f for f, s in zip(folders, stats, strict=True) if s["rows"]]
        return (self.spark.read.option("basePath", root).parquet(*folders).drop("segment") if folders else None), stats

    def vacuum(self, grace_s: float = GRACE_S) -> int:
        """Drop the files that the present version doesn't read; returns how many folders went.  Folders that no manifest names may
        belong to a writer at work and stay for a while."""
        numbers = self.log.numbers()
        docs = [self.log.read(n) for n in numbers]
        names = lambda d: {s["path"] for t in d["tables"].values() for k in ("base", "deltas") for s in t[k]}
        kept, known = names(docs[-1]), set().union(*(names(d) for d in docs))
        runs = {r["folder"].split("/")[0] for r in docs[-1]["runs"].values()}
        gone = 0
        for top in self.files.names(self.path):
            if top.startswith("s-"):
                for inner in self.files.names(f"{self.path}/{top}"):
                    path = f"{top}/{inner}"
                    if path not in kept and (path in known or self.files.age(f"{self.path}/{path}") > grace_s):
                        gone += self.files.delete(f"{self.path}/{path}")
            elif top.startswith("staged-") and top not in runs and self.files.age(f"{self.path}/{top}") > grace_s:
                gone += self.files.delete(f"{self.path}/{top}")
        models = {n: (self.log_of(n).last()[1] or {}).get("uid") for n in self.files.names(f"{self.path}/models")}
        tags = {self._tag(p) for p in kept}
        for folder in self.files.names(f"{self.path}/derived"):
            name, _, uid = folder.partition("-")
            own = f"{self.path}/derived/{folder}"
            if models.get(DERIVED.get(name)) != uid:
                gone += self.files.delete(own)
                continue
            gone += sum(self.files.delete(f"{own}/{s}") for s in self.files.names(own) if s.removeprefix("segment=") not in tags)
        for n in numbers[:-1]:
            self.files.delete(f"{self.log.path}/{n:012d}.json")
        return gone


# the model that rows of each kind are made by
DERIVED = {"ivf_vectors": "ivf", "sign_postings": "sign", "pq_vectors": "pq", "graph_edges": "graph"}


def _shaped(spark: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    """The columns of a table, null where they are missing."""
    want = spark.createDataFrame([], kind).schema
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want])
