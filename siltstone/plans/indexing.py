"""Index builds: scan, parse, resolve, document, embed, store.  Pending files go in batches, each a distributed job that ends in a staged
manifest, which names the batch's rows and its part of the build log; so a build that dies goes on after its last batch.  The new index is published at the end."""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.encoder import Encoder, HashedEncoder, embedded
from siltstone.observe import Timings, event, logger, measured
from siltstone.operators.documents import INDEXED_FROM, RETRIEVAL_FROM, index_documents, retrieval_documents, twice_named
from siltstone.operators.resolve import RESOLVED_FROM, merged, resolution, resolved_chunks, type_index, visible_names
from siltstone.schemas import SYMBOLS
from siltstone.scratch import scratch, stored
from siltstone.sources.files import binary_symbols, chunks, java_files, jdk_symbols, plain_path, present, scan, source_symbols
from siltstone.sources.store import Files, Store, sent_if_few, upserted
from siltstone.sources.workspace import Workspace, owners

log_ = logger("indexing")


def now() -> str:
    return datetime.datetime.now(datetime.UTC).replace(microsecond=0).isoformat()


#: Paths up to which a signature is the sha1 of the list itself; beyond, it is made in two levels.
LISTED = 100_000
DIGESTS = 1024


def signatures(paths: DataFrame, *by: str) -> DataFrame:
    """(by..., signature): the sha1 over the different paths in order, each with a line end.  For groups of at most about LISTED paths."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_set("path")), lambda p: F.concat(p, F.lit("\n"))), "")
    return paths.groupBy(*by).agg(F.sha1(lines).alias("signature"))


def digest(rows: DataFrame, column: str) -> str:
    """sha256 over the different values of a column, whatever their order, in two levels: the values of each of DIGESTS hash groups in order, then the groups in
    order.  The driver gets one digest a group."""
    group = F.pmod(F.xxhash64(column), F.lit(DIGESTS)).alias("g")
    each = rows.select(group, F.sha2(column, 256).alias("v")).distinct().groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("v")), "\n"), 256).alias("d"))
    return hashlib.sha256("\n".join(f"{r['g']} {r['d']}" for r in each.orderBy("g").collect()).encode()).hexdigest()


def signature(paths: DataFrame, total: int | None = None) -> str:
    """Of a set of paths: up to LISTED of them as in ``signatures``, else their ``digest``."""
    own = paths.select("path").distinct()
    if (own.count() if total is None else total) > LISTED:
        return digest(own, "path")
    return signatures(own).first()["signature"]


@dataclass(frozen=True)
class Selection:
    files: DataFrame
    deferred_sets: list[str]
    deferred_files: int


def selected(spark: SparkSession, workspace: Workspace) -> Selection:
    """Files of source sets named main; the others' names and number of files."""
    main = [r for s in workspace.source_sets.values() if s.name == "main" for r in s.all_roots]
    rest = [r for s in workspace.source_sets.values() if s.name != "main" for r in s.all_roots]
    other = sorted({s.name for s in workspace.source_sets.values() if s.name != "main"})
    files = java_files(spark, main)
    return Selection(files, other, java_files(spark, rest, content=False).select("path").distinct().count() if rest else 0)


def files_by_set(files: DataFrame, workspace: Workspace, spark: SparkSession) -> DataFrame:
    """(source_set, count); files outside every source set form a group of their own."""
    return owners(files, workspace.roots(spark)).groupBy("source_set").count()


def symbols(spark: SparkSession, workspace: Workspace, *, binaries: bool = False, jdk_home: str | None = None, cache: SymbolCache | None = None) -> DataFrame:
    """Source symbols of all roots, and with ``binaries`` those of all visible entries and of the JDK."""
    cache = cache or SymbolCache(spark)
    roots = [r for s in workspace.source_sets.values() for r in s.all_roots]
    out = cache.source(roots, workspace)
    if binaries:
        out = merged(out, cache.binary(sorted({e for s in workspace.source_sets.values() for e in s.external_binary_entries})))
        home = jdk_home or workspace.jdk_home
        if home:
            out = merged(out, cache.jdk(home))
    return out


def fingerprint(spark: SparkSession, kind: str, roots: list[str], pattern: str, context: str = "") -> str:
    """sha256 over the kind, the context and (path, time, size) of the matching files.  Their contents aren't read."""
    rows = scan(spark, roots, pattern, content=False).select(F.to_json(F.array("path", F.col("modificationTime").cast("string"), F.col("length").cast("string"))).alias("file"))
    return hashlib.sha256(json.dumps([kind, context, sorted(roots), digest(rows, "file")]).encode()).hexdigest()


class SymbolCache:
    """Symbol tables by the fingerprint of their inputs; the same inputs give the same table.

    With a ``path`` the tables are kept there, for other sessions too: each is written to a folder of its own, and a marker that names the folder makes it
    known in one step.  Of two sessions that make the same table at once, the second takes that of the first."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.held = spark, path, {}

    def table(self, key: str, make) -> DataFrame:
        """The table of that key, made by ``make`` unless it is known."""
        if key not in self.held:
            self.held[key] = stored(make(), "symbols") if self.path is None else self._kept(key, make)
        return self.held[key]

    def _kept(self, key: str, make) -> DataFrame:
        files, marker = Files(self.spark), f"{self.path}/ready/{key}"
        name = files.read(marker)
        if name is None:
            name = uuid.uuid4().hex
            make().write.parquet(f"{self.path}/tables/{name}")
            if not files.create(marker, name):
                name = files.read(marker)
        return self.spark.read.schema(SYMBOLS).parquet(f"{self.path}/tables/{name}")

    def source(self, roots: list[str], workspace: Workspace) -> DataFrame:
        context = repr(sorted(workspace.source_sets.items()))

        def make() -> DataFrame:
            files = java_files(self.spark, roots)
            owned = owners(files.select("path"), workspace.roots(self.spark)).select(F.col("path").alias("filepath"), F.col("source_set").alias("container"))
            return source_symbols(files, F.lit(None).cast("string")).drop("container").join(owned, "filepath", "left").select("qualified_name", "container", "origin_kind", "filepath")

        return self.table(fingerprint(self.spark, "source", roots, "*.java", context), make)

    def binary(self, paths: list[str]) -> DataFrame:
        return self.table(fingerprint(self.spark, "binary", paths, "*.{jar,class}"), lambda: binary_symbols(self.spark, paths))

    def jdk(self, home: str) -> DataFrame:
        return self.table(fingerprint(self.spark, "jdk", [f"{home}/jmods"], "*.jmod"), lambda: jdk_symbols(self.spark, home))


def parsed(files: DataFrame, workspace: Workspace | None, spark: SparkSession, *, columns: Collection[str] | None = None, binaries: bool = False, jdk_home: str | None = None, cache: SymbolCache | None = None) -> DataFrame:
    """Chunks of the files with source_set, calls resolved within what each source set sees.  With ``columns`` these are made, and those that calls are resolved by."""
    if columns is not None and workspace is not None:
        columns = {*columns, *RESOLVED_FROM}
    # Small files are packed into few scan tasks; parsing is dealt out by path, to a number of tasks that isn't lowered for having few bytes.
    rows = chunks(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"), columns)
    if workspace is None:
        return rows.withColumn("source_set", F.lit(None).cast("string"))
    owned = owners(files.select("path"), workspace.roots(spark)).select(F.col("path").alias("filepath"), "source_set")
    rows = rows.join(owned, "filepath", "left")
    index = type_index(visible_names(symbols(spark, workspace, binaries=binaries, jdk_home=jdk_home, cache=cache), workspace.visibility(spark)), "source_set")
    return resolved_chunks(rows, index, "source_set")


def resolution_of(spark: SparkSession, path: str, *, workspace: Workspace | None = None, binaries: bool = False, jdk_home: str | None = None) -> DataFrame:
    """How the types that one file names are resolved: by what its source set sees, or without a workspace by the JDK alone."""
    file = spark.read.format("binaryFile").load(path).withColumn("path", plain_path(F.col("path")))
    rows = chunks(file)
    if workspace is None:
        known = jdk_symbols(spark, jdk_home) if jdk_home else spark.createDataFrame([], SYMBOLS)
        return resolution(rows, type_index(known))
    owned = owners(file.select("path"), workspace.roots(spark)).select(F.col("path").alias("filepath"), "source_set")
    names = visible_names(symbols(spark, workspace, binaries=binaries, jdk_home=jdk_home), workspace.visibility(spark))
    return resolution(rows.join(owned, "filepath", "left"), type_index(names, "source_set"), "source_set")


def build(files: DataFrame, repo_root: str, workspace: Workspace | None, spark: SparkSession, indexed_at: str, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, failures (path, error)): files that don't parse or whose ids clash fail whole.  The documents are stored, since their ids are read, then their texts
    and then their rows."""
    columns = (*INDEXED_FROM, "error")
    rows = parsed(files, workspace, spark, columns=columns, **options).select(*columns, "source_set", F.lit(repo_root).alias("repo_root"))
    rows = stored(rows, "chunks")
    documents = stored(index_documents(rows.where("kind <> 'failed'"), indexed_at), "documents")
    clash = stored(twice_named(documents), "clashes")
    failed = rows.where("kind = 'failed'").select(F.col("filepath").alias("path"), "error").unionByName(clash.select(F.concat_ws("/", F.lit(repo_root), "file_path").alias("path"), "error"))
    return documents.join(sent_if_few(clash.select("file_path")), "file_path", "left_anti").select(documents.columns), failed


#: Files in one batch of a build, about.
BATCH_FILES = 50_000


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """The files whose path isn't among those done."""
    return files.join(done.select("path"), "path", "left_anti")


def _batches(left: DataFrame, spark: SparkSession, batch_files: int) -> list[DataFrame]:
    """The pending files (path, content) in batches of about ``batch_files``.  More than one are read once, into the shared folder, one part for each batch."""
    n = -(-left.select("path").count() // batch_files)
    if n <= 1:
        return [left] if n else []
    path = scratch(spark, "pending-files")
    left.select("path", "content", F.pmod(F.xxhash64("path"), F.lit(n)).cast("int").alias("batch")).write.partitionBy("batch").parquet(path)
    rows = spark.read.schema("path STRING, content BINARY, batch INT").parquet(path)
    return [rows.where(F.col("batch") == k).drop("batch") for k in range(n)]


def index_workspace(spark: SparkSession, store: Store, *, repo_root: str, workspace: Workspace, encoder: Encoder | None = None, binaries: bool = False, jdk_home: str | None = None, batch: int = 32, batch_files: int = BATCH_FILES) -> dict:
    """Builds or resumes the index of the main source sets.  Returns the build state, with what was deferred and the timings.  What became of each file is in the
    store's build log, to which each batch appends its files in the step that stages its rows."""
    encoder, times, at = encoder or HashedEncoder(), Timings(), now()
    main = workspace.main_only()
    with measured() as watch:
        chosen = selected(spark, workspace)
        total = chosen.files.select("path").distinct().count()
        store.start(repo_root, signature(chosen.files, total), encoder.name, at, total)
        batches = _batches(pending(chosen.files, stored(store.done(), "done")), spark, batch_files)
    times.add("select", watch.seconds)
    cache = SymbolCache(spark, f"{store.path}/symbols")
    for own in batches:
        with measured() as watch:
            documents, failures = build(own, repo_root, main, spark, at, binaries=binaries, jdk_home=jdk_home, cache=cache)
            failures = stored(failures.groupBy("path").agg(F.min("error").alias("error")), "failures")
        times.add("parse", watch.seconds)
        with measured() as watch:
            changed = own.select(F.substr("path", F.lit(len(repo_root.rstrip("/")) + 2)).alias("file_path"))
            log = own.select("path").join(failures, "path", "left").withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed"))
            store.replace_files(changed, documents, embedded(documents, encoder, batch), encoder.name, at, staged=True, log=log)
        times.add("embed_and_persist", watch.seconds)
    store.compact()
    state = store.finish()
    event(log_, "indexed workspace", files=state["completed"], failed=state["failed"], documents=state["documents_indexed"], **{f"{k}_ms": v for k, v in times.all_ms().items()})
    return state | {"deferred_source_sets": chosen.deferred_sets, "deferred_files": chosen.deferred_files, "timings_ms": times.all_ms()}


def index_file(spark: SparkSession, store: Store, path: str, *, repo_root: str, workspace: Workspace | None = None, encoder: Encoder | None = None, batch: int = 32, **options) -> int:
    """Replaces one file in the index, whatever its source set; the other files' rows stay as they are.  Returns the new version."""
    if not present(spark, [path]):
        raise ValueError(f"no such file: {path}")
    encoder, at = encoder or HashedEncoder(), now()
    file = spark.read.format("binaryFile").load(path).withColumn("path", plain_path(F.col("path")))
    documents, failures = build(file, repo_root, workspace, spark, at, **options)
    if bad := failures.first():
        raise ValueError(f"{bad['path']}: {bad['error']}")
    changed = file.select(F.substr("path", F.lit(len(repo_root.rstrip("/")) + 2)).alias("file_path"))
    return store.replace_files(changed, documents, embedded(documents, encoder, batch), encoder.name, at)


def index_retrieval(table: DataFrame | None, files: DataFrame, workspace: Workspace | None, spark: SparkSession, repo_root: str | None = None) -> DataFrame:
    """The retrieval-document table with the files' documents put in by id."""
    rows = parsed(files, workspace, spark, columns=RETRIEVAL_FROM).where("kind <> 'failed'").withColumn("repo_root", F.lit(repo_root).cast("string"))
    new = retrieval_documents(rows)
    # Its keys are read, then its rows: stored, so that the files are parsed once.
    return new if table is None else upserted(table, stored(new, "retrieval"), "chunk_id")
