"""Snapshot store of documents and vectors.

Rows are dealt by file path into buckets, whose number the manifest holds; it is set when an index is begun, by the number of its files.
A write puts the touched buckets into a new folder and then publishes a manifest that names the folder of every bucket; readers follow
the newest manifest, so they never see half a write, and a write that died before publishing leaves nothing visible.

Writers are optimistic: each names the version it read and may only publish the one after it.  One that comes late reads the newest manifest,
keeps what it wrote for buckets that nobody else changed, makes the others anew, and tries again, so no update is lost.  A write of a stream carries
its batch number, which the manifest keeps: a batch that comes again changes nothing.

A build writes batch by batch to a staged manifest, which is published when it ends: until then readers keep the old index, and a build that
died goes on after its last batch.  Files that others refreshed meanwhile are carried over.  What became of each file is a row of the build log, a table
whose parts the same manifest names; ``state.json`` holds only numbers.  All files go through Spark or Hadoop file systems.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators import lists
from siltstone.operators.search import widths
from siltstone.schemas import BUILD_LOG, DOCUMENTS, LISTS, VECTORS
from siltstone.scratch import stored

#: Buckets of a new index: at least so many, and one for each FILES_PER_BUCKET files.
BUCKETS = 64
FILES_PER_BUCKET = 2000
#: Tasks that write one bucket, at most.
WRITERS = 4
#: Parts of a build log before they are made into one.
LOG_PARTS = 32
STAGED = "staged.json"
TABLES = {"documents": DOCUMENTS, "vectors": VECTORS}


class CorruptState(RuntimeError):
    """State that should be there is missing or can't be read."""


class Files:
    """Small text files by any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def read(self, path: str) -> str | None:
        where, fs = self._at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside the place and renames, so that a reader sees all or nothing."""
        where, fs = self._at(path)
        temp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(temp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # One step: the old text or the new one is there at any time.
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(context.makeQualified(temp), context.makeQualified(where), options)

    def create(self, path: str, text: str) -> bool:
        """Writes a new file; False if there is one already."""
        where, fs = self._at(path)
        try:
            stream = fs.create(where, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def names(self, path: str) -> list[str]:
        where, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        where, fs = self._at(path)
        return time.time() - fs.getFileStatus(where).getModificationTime() / 1000

    def remove(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)


def bucket(n: int, path: str = "file_path") -> Column:
    return F.pmod(F.xxhash64(path), F.lit(n)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    # --- manifests

    def version(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict | None:
        version = version if version is not None else self.version()
        text = self.files.read(f"{self.path}/manifests/{version}.json") if version else None
        return json.loads(text) if text else None

    def model(self) -> str | None:
        """The name of the newest version's encoder."""
        return (self.manifest() or {}).get("model_name")

    def create(self, model: str, indexed_at: str) -> int:
        """An empty index, if there is none; returns its version, or that of the index that is there."""
        if (version := self.version()) or self._publish(0, {"buckets": {}, "n_buckets": BUCKETS, "model_name": model, "indexed_at": indexed_at}):
            return version or 1
        return self.version()

    def _publish(self, read: int, manifest: dict) -> int | None:
        """Publishes the version after the one that was read; None if another writer has taken it."""
        return read + 1 if self.files.create(f"{self.path}/manifests/{read + 1}.json", json.dumps(manifest)) else None

    def staged(self) -> dict | None:
        """The manifest of a build that is under way."""
        text = self.files.read(f"{self.path}/{STAGED}")
        return json.loads(text) if text else None

    def _put_staged(self, manifest: dict) -> None:
        self.files.write(f"{self.path}/{STAGED}", json.dumps(manifest))

    def stage(self, total_files: int, model: str, indexed_at: str) -> None:
        """Begins a new index beside the published one."""
        n = max(BUCKETS, -(-total_files // FILES_PER_BUCKET))
        self._put_staged({"base": self.version(), "buckets": {}, "n_buckets": n, "model_name": model, "indexed_at": indexed_at})

    def publish_staged(self) -> int | None:
        """Publishes what was staged, with the files that others refreshed since it was begun.  If they did so under another model, their vectors
        can't be taken over: such files are noted as failed, to be done again."""
        while (manifest := self.staged()) is not None:
            head = self.version()
            changes = [m["changes"] for v in range(manifest["base"] + 1, head + 1) if (m := self.manifest(v)) and m.get("changes")]
            if changes:
                changed = self.spark.read.schema("file_path STRING").parquet(*(f"{self.path}/changes/{x}" for x in changes)).distinct()
                newest = self.manifest(head)
                if newest["model_name"] == manifest["model_name"]:
                    rows = (self._read(t, newest).join(changed, "file_path", "left_semi") for t in TABLES)
                    self.replace_files(changed, *rows, manifest["model_name"], manifest["indexed_at"], staged=True)
                else:
                    root = self.required()["repo_root"].rstrip("/")
                    paths = changed.select(F.concat(F.lit(root + "/"), "file_path").alias("path"))
                    self.note(paths.join(self.log().select("path"), "path", "left_semi").withColumns({"status": F.lit("failed"), "error": F.lit("changed during the build")}))
                manifest = self.staged()
            # What streams have written is in the files carried over.
            batches = (self.manifest(head) or {}).get("batches", {})
            self._put_staged(manifest | {"base": head})
            published = self._publish(head, {k: v for k, v in manifest.items() if k not in ("base", "changes")} | {"batches": batches})
            if published is not None:
                self.files.remove(f"{self.path}/{STAGED}")
                return published
        return None

    # --- reading

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The table as of a version, the newest by default; None without an index."""
        manifest = self.manifest(version)
        return None if manifest is None else self._read(table, manifest)

    def _read(self, table: str, manifest: dict) -> DataFrame:
        """The buckets' folders are named by the manifest, so the driver lists none."""
        has = manifest.get("has", {})
        paths = [f"{self.path}/data/{v}/{table}/bucket={b}" for b, v in manifest["buckets"].items() if int(b) in has.get(v, {}).get(table, ())]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def status(self) -> dict | None:
        manifest = self.manifest()
        if manifest is None:
            return None
        return {"chunks": self.read("documents").count(), "indexed_at": manifest["indexed_at"], "model_name": manifest["model_name"]}

    def retained(self, exclude_file: str | None = None) -> tuple[DataFrame, DataFrame] | None:
        """Documents and vectors, without those of one file."""
        tables = [self.read(t) for t in TABLES]
        if tables[0] is None:
            return None
        if exclude_file is not None:
            tables = [t.where(~F.col("file_path").eqNullSafe(exclude_file)) for t in tables]
        return tables[0], tables[1]

    # --- writing

    def _write(self, frames: dict[str, DataFrame], n: int) -> tuple[str, dict]:
        """(folder, buckets that each table has there)."""
        version, has = uuid.uuid4().hex, {}
        for table, frame in frames.items():
            own, path = frame.withColumn("bucket", bucket(n)), f"{self.path}/data/{version}/{table}"
            # A bucket is written by several tasks, so that the number of writers isn't that of the buckets.
            own.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(WRITERS))).write.partitionBy("bucket").parquet(path)
            has[table] = sorted(int(x.removeprefix("bucket=")) for x in self.files.names(path) if x.startswith("bucket="))
        return version, has

    def save(self, documents: DataFrame, vectors: DataFrame, model: str, indexed_at: str) -> int:
        """Replaces everything, whatever others publish meanwhile."""
        n = max(BUCKETS, -(-documents.select("file_path").distinct().count() // FILES_PER_BUCKET))
        version, has = self._write({"documents": documents, "vectors": vectors}, n)
        manifest = {"buckets": {str(b): version for b in range(n)}, "has": {version: has}, "n_buckets": n, "model_name": model, "indexed_at": indexed_at}
        while True:
            head = self.version()
            batches = (self.manifest(head) or {}).get("batches", {})
            if (published := self._publish(head, manifest | {"batches": batches})) is not None:
                return published

    def replace_files(self, changed: DataFrame, documents: DataFrame, vectors: DataFrame, model: str, indexed_at: str, *, staged: bool = False, log: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int | None:
        """Replaces the rows of the files in ``changed`` (file_path), also by nothing.  Only buckets that hold such files are rewritten, and where no rows are put in, only those that lose some.

        With ``staged`` in the index that is being built (which has one writer), with ``log`` rows for the build log; else in the published one, whose new version is
        returned.  ``batch``: a stream's name and its batch number; a batch that the index has already gives None."""
        written: dict[int, tuple[str | None, str | None]] = {}  # bucket -> the folder it was made from, its new folder
        has: dict[str, dict] = {}
        n, listed, own = None, None, None
        while True:
            read = 0 if staged else self.version()
            manifest = (self.staged() if staged else self.manifest(read)) or {"buckets": {}, "n_buckets": BUCKETS}
            if batch is not None and manifest.get("batches", {}).get(batch[0], -1) >= batch[1]:
                return None
            if own is None:
                own = stored(changed.select("file_path").distinct(), "changed")
                sent = sent_if_few(own)
            if manifest["n_buckets"] != n:  # another index has been published
                n, written = manifest["n_buckets"], {}
                touched = sorted(r[0] for r in own.select(bucket(n).alias("b")).distinct().collect())
            stale = [b for b in touched if b not in written or written[b][0] != manifest["buckets"].get(str(b))]
            held = manifest | {"buckets": {str(b): manifest["buckets"][str(b)] for b in stale if str(b) in manifest["buckets"]}}
            if held["buckets"] and documents.isEmpty() and vectors.isEmpty():
                # Nothing is put in, as where files fail again: a bucket that loses no row stays as it is.
                found = [self._read(t, held).select("file_path").join(sent, "file_path", "left_semi").select(bucket(n).alias("b")) for t in TABLES]
                losing = {r[0] for r in found[0].unionByName(found[1]).distinct().collect()}
                written |= {b: (at := manifest["buckets"].get(str(b)), at) for b in stale if b not in losing}
                stale = [b for b in stale if b in losing]
            if stale:
                wanted = bucket(n).isin(stale)
                frames = {}
                for table, new in (("documents", documents), ("vectors", vectors)):
                    kept = self._read(table, held | {"buckets": {b: v for b, v in held["buckets"].items() if int(b) in stale}}).join(sent, "file_path", "left_anti")
                    frames[table] = kept.select(new.columns).unionByName(new.where(wanted))
                version, tables = self._write(frames, n)
                has[version] = tables
                written |= {b: (manifest["buckets"].get(str(b)), version) for b in stale}
            if log is not None and listed is None:
                listed = self._part(log)
            buckets = manifest["buckets"] | {str(b): written[b][1] for b in touched if written[b][1] is not None}
            new = manifest | {"buckets": buckets, "model_name": model, "indexed_at": indexed_at, "has": {v: h for v, h in (manifest.get("has", {}) | has).items() if v in buckets.values()}}
            if staged:
                self._put_staged(new | {"log": manifest.get("log", []) + ([listed] if listed else [])})
                return None
            if listed is None:
                listed = uuid.uuid4().hex
                own.write.parquet(f"{self.path}/changes/{listed}")
            new["changes"] = listed
            if batch is not None:
                new["batches"] = manifest.get("batches", {}) | {batch[0]: batch[1]}
            if (published := self._publish(read, new)) is not None:
                return published

    def applied(self, batch: tuple[str, int]) -> bool:
        """Whether the newest version holds a stream's batch."""
        return (self.manifest() or {}).get("batches", {}).get(batch[0], -1) >= batch[1]

    # --- inverted file

    def index_lists(self, n: int | None = None) -> int | None:
        """Makes an inverted file of the newest version's vectors, measures how many lists a search must probe for a recall of 0.9, and publishes it.  Files that are replaced later are searched beside it, until it is made anew."""
        manifest = self.manifest()
        if manifest is None:
            return None
        chunks = self._read("vectors", manifest).withColumn("bucket", bucket(manifest["n_buckets"]))
        own, name = lists.centroids(chunks, n), uuid.uuid4().hex
        lists.put_centroids(self.spark, own, f"{self.path}/lists/{name}/centroids")
        probes, recall = 0, 1.0
        if len(own):
            lists.write_lists(chunks, own, f"{self.path}/lists/{name}/rows", "bucket")
            probes, recall = lists.calibrated(chunks, self.spark.read.schema(LISTS).parquet(f"{self.path}/lists/{name}/rows"), own, *widths(5))
        while True:
            head = self.version()
            entry = {"name": name, "n_buckets": manifest["n_buckets"], "buckets": manifest["buckets"], "n": len(own), "probes": probes, "recall": recall}
            if (published := self._publish(head, self.manifest(head) | {"lists": entry, "changes": None})) is not None:
                return published

    def near(self, query_vectors: DataFrame, keep: int, probes: int = 0, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """By ``probes`` lists for each query vector (0: as many as were measured when the file was made): (the ``keep`` best chunks of each query by the inverted file, as (query_id, chunk_id); the chunks of files replaced since it was made), of those ``allowed`` (chunk_id)."""
        manifest = self.manifest() or {}
        entry = manifest.get("lists")
        if entry is None:
            raise LookupError("there is no inverted file")
        same = [b for b, v in manifest["buckets"].items() if entry["n_buckets"] == manifest["n_buckets"] and entry["buckets"].get(b) == v]
        fresh = self._read("vectors", manifest | {"buckets": {b: v for b, v in manifest["buckets"].items() if b not in set(same)}})
        at = f"{self.path}/lists/{entry['name']}"
        rows = self.spark.read.schema(LISTS).parquet(f"{at}/rows") if entry["n"] else self.spark.createDataFrame([], LISTS)
        rows = rows.where(F.col("bucket").isin([int(b) for b in same]))
        if allowed is not None:
            rows, fresh = (x.join(allowed, "chunk_id", "left_semi") for x in (rows, fresh))
        return lists.candidates(rows, lists.get_centroids(self.spark, f"{at}/centroids"), query_vectors, keep, probes or entry["probes"]), fresh

    def prune(self, older_than: float = 86_400) -> None:
        """Removes data that neither the newest manifest nor a build under way names, if it is older than so many seconds (a writer may be about to publish it)."""
        manifests = [m for m in (self.manifest(), self.staged()) if m]
        used = {v for m in manifests for v in [*m["buckets"].values(), *m.get("log", [])]}
        folders = [f"{self.path}/{kind}/{name}" for kind in ("data", "log") for name in self.files.names(f"{self.path}/{kind}") if name not in used]
        listed = {m["lists"]["name"] for m in manifests if m.get("lists")}
        folders += [f"{self.path}/lists/{name}" for name in self.files.names(f"{self.path}/lists") if name not in listed]
        if self.staged() is None:
            folders += [f"{self.path}/changes/{name}" for name in self.files.names(f"{self.path}/changes")]
        for folder in folders:
            if self.files.age(folder) >= older_than:
                self.files.remove(folder)

    def reset(self) -> None:
        self.files.remove(f"{self.path}/manifests")

    # --- build state and log

    def state(self) -> dict | None:
        """repo_root, status, workspace_signature, model_name, indexed_at, total_files, build, documents_indexed, completed, failed."""
        try:
            text = self.files.read(f"{self.path}/state.json")
            return None if text is None else json.loads(text)
        except (ValueError, Py4JJavaError) as error:
            raise CorruptState(f"{self.path}/state.json") from error

    def put_state(self, state: dict) -> dict:
        self.files.write(f"{self.path}/state.json", json.dumps(state))
        return state

    def start(self, repo_root: str, signature: str, model: str, indexed_at: str, total: int) -> dict:
        """Resumes an unfinished build of the same files and model; else begins a new index beside the old one."""
        old = self.state()
        if old and old["status"] in ("in_progress", "partial") and old["workspace_signature"] == signature and old["model_name"] == model:
            if self.staged() is None and (manifest := self.manifest()):
                self._put_staged({k: v for k, v in manifest.items() if k != "changes"} | {"indexed_at": indexed_at, "base": self.version()})
            return self.put_state(old | {"status": "in_progress"})
        self.stage(total, model, indexed_at)
        return self.put_state({"repo_root": repo_root, "status": "in_progress", "workspace_signature": signature, "model_name": model, "indexed_at": indexed_at, "total_files": total, "build": uuid.uuid4().hex, "documents_indexed": 0, "completed": 0, "failed": 0})

    def _part(self, rows: DataFrame) -> str:
        """Writes rows (path, status, error) of the build under way as a part of its log; each path's attempt follows its last one."""
        name, state = uuid.uuid4().hex, self.required()
        before = self.log().groupBy("path").agg(F.max("attempt").alias("before"))
        own = rows.join(before, "path", "left").select(F.lit(state["build"]).alias("build"), "path", "status", F.col("error").cast("string").alias("error"), (F.coalesce("before", F.lit(0)) + 1).cast("int").alias("attempt"))
        own.write.parquet(f"{self.path}/log/{name}")
        return name

    def note(self, rows: DataFrame) -> None:
        """Appends rows (path, status, error) to the log of the build under way."""
        staged = self.staged()
        if staged is None:
            raise CorruptState("there is no build under way")
        self._put_staged(staged | {"log": staged.get("log", []) + [self._part(rows)]})

    def compact(self) -> None:
        """Makes the parts of the log into one, which holds the newest row of each path."""
        staged = self.staged()
        if staged and len(staged.get("log", [])) > 1:
            name = uuid.uuid4().hex
            self.log().write.parquet(f"{self.path}/log/{name}")
            self._put_staged(staged | {"log": [name]})

    def log(self) -> DataFrame:
        """(build, path, status, error, attempt): the newest row of each file of the last build."""
        state, manifest = self.required(), self.staged() or self.manifest() or {}
        parts = [f"{self.path}/log/{p}" for p in manifest.get("log", [])]
        rows = self.spark.read.schema(BUILD_LOG).parquet(*parts) if parts else self.spark.createDataFrame([], BUILD_LOG)
        newest = W.partitionBy("path").orderBy(F.desc("attempt"))
        return rows.where(F.col("build") == state["build"]).withColumn("r_", F.row_number().over(newest)).where("r_ = 1").drop("r_")

    def done(self) -> DataFrame:
        """Paths of the files that the last build has completed."""
        return self.log().where("status = 'completed'").select("path")

    def finish(self) -> dict:
        """Publishes what was built."""
        self.required()
        self.publish_staged()
        counts = {r["status"]: r["count"] for r in self.log().groupBy("status").count().collect()}
        whole = self.read("documents")
        numbers = {"completed": counts.get("completed", 0), "failed": counts.get("failed", 0), "documents_indexed": whole.count() if whole is not None else 0}
        return self.put_state(self.required() | numbers | {"status": "partial" if counts.get("failed") else "completed"})

    def required(self) -> dict:
        state = self.state()
        if state is None:
            raise CorruptState("there is no build state")
        return state


# --- table forms of the same operations


#: Keys that are sent to every task, at most; more are sorted and merged.
SENT_KEYS = 100_000


def sent_if_few(keys: DataFrame) -> DataFrame:
    """Stored keys for the right side of a join.  Sizes guessed from files of few bytes a row let a broadcast grow with the input, so they are counted."""
    return keys.hint("broadcast" if keys.count() <= SENT_KEYS else "merge")


def upserted(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` with other keys."""
    keys = sent_if_few(stored(new.select(*key).distinct(), "keys"))
    return old.join(keys, list(key), "left_anti").select(old.columns).unionByName(new.select(old.columns))


def without(rows: DataFrame, **equal: str) -> DataFrame:
    """Rows that don't equal all the given values; rows with a null there stay."""
    condition = F.lit(True)
    for column, value in equal.items():
        condition = condition & (F.col(column) == value)
    return rows.where(~F.coalesce(condition, F.lit(False)))


def without_prefix(rows: DataFrame, repo_root: str, prefix: str) -> DataFrame:
    """Rows of other repositories, and those whose id doesn't start with the prefix, taken literally."""
    return rows.where(~F.coalesce((F.col("repo_root") == repo_root) & F.col("chunk_id").startswith(prefix), F.lit(False)))


def listed(rows: DataFrame, *, repo_root: str | None = None, kind: str | None = None, filepath: str | None = None) -> DataFrame:
    for column, value in (("repo_root", repo_root), ("kind", kind), ("filepath", filepath)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy("chunk_id")
