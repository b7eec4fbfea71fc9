"""Chunks to index documents and to labelled retrieval documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import naming as N

TEXTS = "annotations"


def with_package(chunks: DataFrame) -> DataFrame:
    """Adds the package name of each chunk's file, which the parser has put on the chunk; else by its ``file`` chunk."""
    if "file_package" in chunks.columns:
        return chunks.withColumn("package", N.package_name(F.col("file_package"))).drop("file_package")
    of_file = chunks.where("kind = 'file'").select("filepath", N.package_name(F.col("package")).alias("package_"))
    return chunks.drop("package").join(of_file.groupBy("filepath").agg(F.first("package_").alias("package")), "filepath", "left")


#: What ``index_documents`` reads of the parsed chunks.
INDEXED_FROM = (
    "chunk_ord", "filepath", "file_package", "kind", "name", "owner_chain", "text", "start_line", "end_line", "start_col", "end_col", "return_type", "parameters", "field_type", "component_type", "annotations", "modifiers", "throws", "calls",
    "fields_accessed", "extends", "implements",
)


def index_documents(chunks: DataFrame, indexed_at: str) -> DataFrame:
    """chunks with repo_root and source_set columns -> one row per document.

    Only indexable kinds of at least 20 characters; long skeletons are cut into segments; positions count per file and kind, in
    source order.  The window is over one file's chunks of one kind.
    """
    arrays = ("owner_chain", "modifiers", "throws", "calls", "fields_accessed")
    rows = with_package(chunks).where(F.col("kind").isin(*N.INDEXABLE_KINDS) & F.col("filepath").isNotNull() & (F.col("filepath") != ""))
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.expr(N.STRINGS)) for c in arrays}).withColumn("annotations", F.coalesce(F.filter(F.transform("annotations", lambda a: a["text"]), lambda t: t != ""), F.expr(N.STRINGS)))
    rows = rows.withColumn("source", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")).where(F.length("source") >= N.LEAST_CHARS)
    long = (F.col("kind") == "skeleton") & (F.length("source") > N.SEGMENT_CHARS)
    rows = rows.withColumn("parts", F.when(long, N.segments(F.col("source"))).otherwise(F.array("source")))
    rows = rows.select("*", F.posexplode("parts").alias("part", "part_text"))
    several = F.size("parts") > 1
    segment = F.when(several, F.concat(F.lit("segment "), (F.col("part") + 1).cast("string"), F.lit("/"), F.size("parts").cast("string")))
    position = F.row_number().over(W.partitionBy("repo_root", "filepath", "kind").orderBy("chunk_ord", "part")) - 1
    kind, owners, package = F.col("kind"), F.col("owner_chain"), F.col("package")
    path = N.relative_path(F.col("filepath"), F.col("repo_root"))
    rows = rows.withColumns({"position": position, "shown": N.display_name(kind, F.col("name"), owners), "file_path": path, "signature": N.signature(kind, F.col("name"), F.col("parameters"), F.col("return_type"), F.col("modifiers"), F.col("throws"))})
    stated = N.declaration(kind, F.when(several, F.col("source")).otherwise(F.col("part_text")), F.col("signature"))
    text = N.retrieval_text(kind, N.label(kind, package, owners, F.col("shown")), stated, F.col("annotations"), F.col("part_text"), segment)
    return rows.select(
        N.chunk_id(F.col("repo_root"), F.col("file_path"), kind, package, owners, F.col("shown"), F.col("parameters"), F.col("position")).alias("chunk_id"),
        "repo_root", "file_path", kind.alias("chunk_kind"), "owner_chain", "package", F.col("shown").alias("name"), "start_line", "end_line", "start_col", "end_col", "signature", "return_type",
        F.coalesce(N.blank_to_null(F.col("field_type")), F.col("component_type")).alias("field_type"), "annotations", "modifiers", F.col("calls").alias("resolved_calls"), "fields_accessed", "throws",
        N.split_clause(F.col("implements"), "implements").alias("implements"), N.strip_clause(F.col("extends"), "extends").alias("extends"), "source_set", text.alias("retrieval_text"), F.col("part_text").alias("source_text"), F.lit(indexed_at).alias("indexed_at"),
    )


def twice_named(documents: DataFrame) -> DataFrame:
    """(file_path, error): files in which two documents have the same id; these can't be stored."""
    twice = documents.groupBy("file_path", "chunk_id").count().where("count > 1")
    return twice.groupBy("file_path").agg(F.concat(F.lit("duplicate id: "), F.min("chunk_id")).alias("error"))


#: What ``retrieval_documents`` reads of the parsed chunks.
RETRIEVAL_FROM = (
    "chunk_id", "parent_chunk_id", "filepath", "file_package", "kind", "name", "owner_chain", "return_type", "parameters", "field_type", "component_type", "extends", "implements", "permits", "modifiers", "annotations", "throws", "calls",
    "fields_accessed", "javadoc", "start_line", "end_line", "text",
)


def retrieval_documents(chunks: DataFrame) -> DataFrame:
    """Every chunk but ``file``, with a text of labelled lines and the symbols that it refers to.  Clause keywords stay in ``extends``."""
    empty = F.expr(N.STRINGS)
    arrays = ("owner_chain", "modifiers", "throws", "calls", "fields_accessed")
    rows = with_package(chunks).where("kind <> 'file'").withColumns({c: F.coalesce(F.col(c), empty) for c in arrays})
    rows = rows.withColumn("annotation_texts", F.coalesce(F.filter(F.transform("annotations", lambda a: a["text"]), lambda t: t.isNotNull()), empty))
    rows = rows.withColumns({
        "signature": N.signature(F.col("kind"), F.col("name"), F.col("parameters"), F.col("return_type"), F.col("modifiers")),
        "implements_names": N.split_clause(F.col("implements"), "implements"),
        "permits_names": N.split_clause(F.col("permits"), "permits"),
        "resolved_symbols": F.array_distinct(F.filter(F.concat(F.array("field_type", "component_type", "extends"), "calls"), lambda s: s.isNotNull() & (s != ""))),
    })
    one = lambda name, c: F.concat(F.lit(f"{name} "), N.blank_to_null(F.col(c)))
    many = lambda name, c: F.concat(F.lit(f"{name} "), N.blank_to_null(F.array_join(c, " ")))
    lines = [
        one("package", "package"), one("filepath", "filepath"), one("source_set", "source_set"), many("owner", "owner_chain"), one("kind", "kind"), one("name", "name"), one("signature", "signature"),
        many("modifiers", "modifiers"), many("annotations", "annotation_texts"), one("javadoc", "javadoc"), one("extends", "extends"), many("implements", "implements_names"), many("permits", "permits_names"),
        one("field_type", "field_type"), one("component_type", "component_type"), many("fields_accessed", "fields_accessed"), many("throws", "throws"), many("calls", "calls"), many("resolved_symbols", "resolved_symbols"),
        F.concat(F.lit("code "), F.coalesce("text", F.lit(""))),
    ]
    return rows.select(
        "chunk_id", "parent_chunk_id", "repo_root", "source_set", "filepath", F.col("package").alias("package_name"), "kind", "name", "owner_chain", "signature", "return_type", "field_type", "component_type",
        F.col("extends").alias("extends_name"), F.col("implements_names").alias("implements"), F.col("permits_names").alias("permits"), "modifiers", F.col("annotation_texts").alias("annotations"), "throws", "calls", "fields_accessed",
        "resolved_symbols", "javadoc", "start_line", "end_line", "text", F.concat_ws("\n", *lines).alias("retrieval_text"),
    )
