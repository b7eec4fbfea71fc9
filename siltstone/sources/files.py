"""File scans: Java sources, class files and archives, read by Spark so that any store it knows will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Collection, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions.naming import class_name
from siltstone.java.chunker import parse
from siltstone.schemas import CHUNKS, SYMBOLS

PATHS = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, "^file:/*", "/")


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, asked of their file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in dict.fromkeys(paths):
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(conf).exists(where):
            out.append(p)
    return out


def scan(spark: SparkSession, roots: list[str], pattern: str, *, content: bool = True) -> DataFrame:
    """path, modificationTime, length (and content) of all files below the roots; missing roots are skipped, files reached twice count once."""
    roots = present(spark, roots)
    if not roots:
        out = spark.createDataFrame([], PATHS)
    else:
        out = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots)
    out = out.withColumn("path", plain_path(F.col("path")))
    if len(roots) > 1:
        nested = any(a != b and b.rstrip("/").startswith(a.rstrip("/") + "/") for a in roots for b in roots)
        out = out.dropDuplicates(["path"]) if nested else out
    return out if content else out.drop("content")


def java_files(spark: SparkSession, roots: list[str], *, content: bool = True) -> DataFrame:
    return scan(spark, roots, "*.java", content=content)


@lru_cache
def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    return spark.createDataFrame([], ddl).toArrow().schema


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, list[dict]]]:
    """(path, chunks) of each file.  One bad file must not end the job; it comes back as a chunk."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                own = parse(bytes(content), path)
            except Exception as error:
                own = [{"filepath": path, "kind": "failed", "error": f"{type(error).__name__}: {error}"}]
            yield path, own


#: Rows that go back to Spark in one batch, about.
BATCH_ROWS = 4000


def chunks(files: DataFrame, columns: Collection[str] | None = None) -> DataFrame:
    """files (path, content) -> chunk rows.  A file whose parse fails gives one row of kind ``failed`` with the error.

    With ``columns`` only these are made: Spark can't see which columns of a Python step are read later, so it would be sent all of them."""
    schema, kinds = _arrow_schema(files.sparkSession, CHUNKS), CHUNKS
    if columns is not None:
        schema = pa.schema([f for f in schema if f.name in columns])
        kinds = StructType([f for f in StructType.fromDDL(CHUNKS) if f.name in columns])
    # Names are taken once: a field makes its name anew each time it is asked.
    fields = [(f.name, f.type) for f in schema]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        for r in rows:
            if r.get("annotations"):
                r["annotations"] = [a | {"attributes": list(a["attributes"].items())} for a in r["annotations"]]
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], type_) for name, type_ in fields], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for _, own in _parsed(batches):
            package = own[0].get("package")
            for r in own:
                r["file_package"] = package
            rows += own
            if len(rows) >= BATCH_ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return files.select("path", "content").mapInArrow(run, kinds)


#: The types of a file, each by the names of its owners and its own.
FILE_TYPES = "filepath STRING, package STRING, types ARRAY<ARRAY<STRING>>"


def file_types(files: DataFrame) -> DataFrame:
    """(filepath, package, types): one row for each file that parses, with its top-level and member types.  The owners of a member type are types themselves; below a method or an
    anonymous class, one is not."""
    schema = _arrow_schema(files.sparkSession, FILE_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for path, own in _parsed(batches):
            known = dict.fromkeys((*r["owner_chain"], r["name"]) for r in own if r["kind"] == "skeleton")
            rows.append((path, own[0].get("package"), [c for c in known if all(c[:i] in known for i in range(1, len(c)))]))
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    package = F.trim(F.regexp_replace(F.regexp_replace("package", "^package ", ""), ";+$", ""))
    return files.select("path", "content").where("path is not null").mapInArrow(run, FILE_TYPES).withColumn("package", F.nullif(package, F.lit("")))


def source_symbols(files: DataFrame, container) -> DataFrame:
    """Qualified names of top-level and member types; container: column of the source set of ``path``."""
    rows = file_types(files).select("filepath", "package", F.explode("types").alias("chain"))
    qualified = F.concat_ws(".", "package", F.array_join("chain", "."))
    return rows.select(qualified.alias("qualified_name"), F.lit(container).alias("container") if isinstance(container, str) else container.alias("container"), F.lit("source").alias("origin_kind"), F.col("filepath")).distinct()


#: Class files of an archive that come in one batch.
ENTRY_ROWS = 10_000


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = [n for n in archive.namelist() if n.endswith(".class")]
            for i in range(0, len(names), ENTRY_ROWS):
                yield pd.DataFrame({"path": path, "entry": names[i : i + ENTRY_ROWS]})


def class_entries(archives: DataFrame) -> DataFrame:
    """(path, entry): the class files of archives (path, content).  Only the directory at an archive's end is read, no entry is unpacked."""
    return archives.select("path", "content").mapInPandas(_entries, "path STRING, entry STRING")


def archive_symbols(archives: DataFrame, origin: str = "binary") -> DataFrame:
    """Symbols of jars (path, content), or with origin ``jdk`` of modules, of which only what lies under ``classes/`` counts."""
    entries = class_entries(archives)
    if origin == "jdk":
        entries = entries.where(F.startswith("entry", F.lit("classes/"))).withColumn("entry", F.substr("entry", F.lit(len("classes/") + 1)))
    return _symbols(entries, origin)


def _symbols(entries: DataFrame, origin: str) -> DataFrame:
    named = entries.select(class_name(F.col("entry")).alias("qualified_name"), F.col("path").alias("container"), F.lit(origin).alias("origin_kind"), F.lit(None).cast("string").alias("filepath"))
    return named.where("qualified_name is not null").distinct()


def binary_symbols(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Symbols of jars and class directories; other paths are ignored.  Of class files only the names are read."""
    out = spark.createDataFrame([], SYMBOLS)
    jars = [p for p in dict.fromkeys(paths) if p.endswith(".jar")]
    if present(spark, jars):
        out = out.unionByName(archive_symbols(scan(spark, jars, "*.jar")))
    for root in present(spark, [p for p in paths if not p.endswith((".jar", ".zip", ".war"))]):
        own = scan(spark, [root], "*.class", content=False)
        base = root.rstrip("/")
        entries = own.select(F.lit(root).alias("path"), F.substr("path", F.lit(len(base.removeprefix("file:")) + 2)).alias("entry"))
        out = out.unionByName(_symbols(entries, "binary"))
    return out.distinct()


def jdk_symbols(spark: SparkSession, home: str) -> DataFrame:
    """Symbols of the modules of a JDK."""
    roots = present(spark, [f"{home}/jmods", f"{home}/Contents/Home/jmods"])
    if not roots:
        raise FileNotFoundError(f"no jmods directory under {home}")
    return archive_symbols(scan(spark, roots[:1], "*.jmod"), "jdk")


def top_level_types(files: DataFrame) -> DataFrame:
    """Type index of the top-level types only."""
    from siltstone.operators.resolve import type_index

    top = file_types(files).select("package", F.explode("types").alias("chain")).where(F.size("chain") == 1)
    return type_index(top.select(F.concat_ws(".", "package", F.col("chain")[0]).alias("qualified_name")))
