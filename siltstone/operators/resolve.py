"""Symbol indexes and the resolution of type names, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.naming import package_name
from siltstone.scratch import stored

STRINGS = "cast(array() as array<string>)"


def simple(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def parent(name: Column) -> Column:
    """The qualified name without its last part; null without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", ""))


def type_index(names: DataFrame, *by: str) -> DataFrame:
    """(by..., simple_name, candidates): the qualified names of each simple name, sorted."""
    return names.withColumn("simple_name", simple(F.col("qualified_name"))).groupBy(*by, "simple_name").agg(F.array_sort(F.collect_set("qualified_name")).alias("candidates"))


def merged(*symbols: DataFrame) -> DataFrame:
    """Union of symbol tables, each definition once."""
    out = symbols[0]
    for s in symbols[1:]:
        out = out.unionByName(s)
    return out.distinct()


def ordered(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("qualified_name", "origin_kind", F.coalesce("container", F.lit("")), F.coalesce("filepath", F.lit("")))


def lookup(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """The definitions whose simple name is among ``names`` (simple_name), with that name."""
    own = symbols.withColumn("simple_name", simple(F.col("qualified_name")))
    return own.join(names.select("simple_name").distinct(), "simple_name", "left_semi")


def qualified_names(symbols: DataFrame, origin_kind: str | None = None, containers: DataFrame | None = None) -> DataFrame:
    """The different qualified names, of one origin and of the containers (container), where these are given."""
    if origin_kind is not None:
        symbols = symbols.where(F.col("origin_kind") == origin_kind)
    if containers is not None:
        symbols = symbols.join(containers.select("container").distinct(), "container", "left_semi")
    return symbols.select("qualified_name").distinct()


def visible_names(symbols: DataFrame, visibility: DataFrame) -> DataFrame:
    """(source_set, qualified_name): sources and binaries by visibility (source_set, container, origin_kind), and the JDK for all."""
    seen = symbols.where("origin_kind <> 'jdk'").join(visibility, ["container", "origin_kind"]).select("source_set", "qualified_name")
    jdk = symbols.where("origin_kind = 'jdk'").select("qualified_name").distinct()
    # One row per source set; the JDK belongs to each.
    every = visibility.groupBy().agg(F.collect_set("source_set").alias("sets"))
    return seen.unionByName(jdk.join(F.broadcast(every), F.lit(True)).select(F.explode("sets").alias("source_set"), "qualified_name")).distinct()


def import_context(files: DataFrame) -> DataFrame:
    """files (filepath, package, imports, local_types) -> package name, explicit imports in order, wildcard packages, local types."""
    clean = F.transform(F.coalesce("imports", F.expr(STRINGS)), lambda i: F.trim(F.regexp_replace(F.regexp_replace(i, r"^import\s+", ""), ";+$", "")))
    own = F.filter(clean, lambda i: ~i.startswith("static "))
    return files.select(
        "filepath", package_name(F.col("package")).alias("package"),
        F.filter(own, lambda i: ~i.endswith(".*")).alias("explicit"),
        F.transform(F.filter(own, lambda i: i.endswith(".*")), lambda i: F.regexp_replace(i, r"\.\*$", "")).alias("wildcards"),
        F.coalesce("local_types", F.expr(STRINGS)).alias("local_types"),
    )


def resolved(refs: DataFrame, context: DataFrame, index: DataFrame, *by: str) -> DataFrame:
    """refs (filepath, by..., type_name), context of import_context, index (by..., simple_name, candidates): adds strategy, best_name, candidates.

    Precedence: local type, explicit import (the last of equal ones), the one type of the same package; then wildcard imports and
    java.lang together: one candidate resolves, several are ambiguous.
    """
    whole = F.coalesce(F.col("type_name").rlike(r"\A[A-Za-z_][$\w]*[^\n]*\n?\z"), F.lit(False))
    wide = refs.withColumn("head_", F.when(whole, F.regexp_extract("type_name", r"^([A-Za-z_][$\w]*)", 1))).withColumn("tail_", F.regexp_replace(F.substr("type_name", F.length("head_") + 1), r"\n\z", ""))
    wide = wide.join(context, "filepath", "left").join(index.withColumnRenamed("simple_name", "head_").withColumnRenamed("candidates", "known_"), [*by, "head_"], "left")
    known = F.coalesce("known_", F.expr(STRINGS))
    local = F.when(F.array_contains("local_types", F.col("head_")), F.concat_ws(".", "package", "head_"))
    explicit = F.try_element_at(F.filter("explicit", lambda i: simple(i) == F.col("head_")), F.lit(-1))
    same = F.filter(known, lambda c: parent(c) == F.col("package"))
    lang = F.filter(known, lambda c: parent(c) == "java.lang")
    wildcard = F.filter(known, lambda c: F.array_contains(F.coalesce("wildcards", F.expr(STRINGS)), parent(c)))
    wide = wide.withColumns({"local_": local, "explicit_": explicit, "same_": F.when(F.size(same) == 1, same[0]), "lang_": F.when(F.size(lang) == 1, lang).otherwise(F.expr(STRINGS)), "wild_": wildcard})
    wide = wide.withColumn("open_", F.array_sort(F.array_union("wild_", "lang_")))
    one = F.when(F.size("open_") == 1, F.col("open_")[0])
    strategy = (
        F.when(F.col("type_name").isNull(), "empty").when(F.col("head_").isNull(), "unresolved").when(F.col("local_").isNotNull(), "local_type").when(F.col("explicit_").isNotNull(), "explicit_import")
        .when(F.col("same_").isNotNull(), "same_package").when(F.size("open_") > 1, "ambiguous").when(F.size("lang_") == 1, "java_lang").when(F.size("open_") == 1, "wildcard_import").otherwise("unresolved")
    )
    found = F.coalesce("local_", "explicit_", "same_", one)
    best = F.when(found.isNotNull() & F.col("head_").isNotNull(), F.concat(found, "tail_")).otherwise(F.col("type_name"))
    listed = F.when(strategy == "ambiguous", F.transform("open_", lambda c: F.concat(c, F.col("tail_")))).otherwise(F.expr(STRINGS))
    return wide.select(*refs.columns, strategy.alias("strategy"), best.alias("best_name"), listed.alias("candidates"))


def type_references(chunks: DataFrame, *by: str) -> DataFrame:
    """(filepath, by..., type_name): the types that a file's chunks name: of results, fields, components and declared names."""
    none = F.expr(STRINGS)
    named = F.concat(F.array("return_type", "field_type", "component_type"), F.coalesce(F.transform("symbols", lambda s: s["type"]), none))
    return chunks.select("filepath", *by, F.explode(F.array_compact(named)).alias("type_name")).where("type_name not in ('', 'void', 'var', 'boolean', 'byte', 'char', 'short', 'int', 'long', 'float', 'double')").distinct()


def resolution(chunks: DataFrame, index: DataFrame, *by: str) -> DataFrame:
    """How each type that the chunks name is resolved: strategy, best name and candidates."""
    context = import_context(chunks.where("kind = 'file'").select("filepath", "package", "imports", "local_types"))
    return resolved(type_references(chunks, *by), context, index, *by)


#: What ``resolved_chunks`` reads of the chunks.
RESOLVED_FROM = ("filepath", "kind", "package", "imports", "local_types", "symbols", "calls", "annotations")


def resolved_chunks(chunks: DataFrame, index: DataFrame, *by: str) -> DataFrame:
    """Replaces the heads of calls and the class literals of annotations by qualified names.

    A head is looked up among the declared names of its scope, then among types.  All names of a file are resolved once, in one join.
    The chunks are stored first, since three steps read them and each would parse the files.  What has a row for each file isn't broadcast.
    """
    chunks = stored(chunks, "chunks")
    context = import_context(chunks.where("kind = 'file'").select("filepath", "package", "imports", "local_types")).hint("merge")
    # The type that a head stands for: its declared type in this scope, or the head itself; heads without a dot stay.
    head = lambda c: F.substring_index(c, ".", 1)
    stands = lambda c: F.coalesce(F.try_element_at(F.filter("symbols", lambda s: s["name"] == head(c)), F.lit(-1))["type"], head(c))
    dotted = lambda c: F.contains(c, F.lit(".")) & ~c.startswith("<expr>") & ~c.startswith("this.") & ~F.contains(c, F.lit("::"))
    of_calls = F.transform(F.filter(F.coalesce("calls", F.expr(STRINGS)), dotted), stands)
    literals = F.transform(F.filter(F.flatten(F.transform(F.coalesce("annotations", F.expr("cast(array() as array<struct<text:string,name:string,attributes:map<string,string>>>)")), lambda a: F.map_values(a["attributes"]))), lambda v: v.endswith(".class")), lambda v: F.regexp_replace(v, r"\.class$", ""))
    refs = chunks.select("filepath", *by, F.explode(F.array_distinct(F.concat(of_calls, literals))).alias("type_name")).distinct()
    names = resolved(refs, context, index, *by).where("strategy not in ('unresolved', 'ambiguous', 'empty')")
    table = names.groupBy("filepath").agg(F.map_from_entries(F.collect_set(F.struct("type_name", "best_name"))).alias("names_"))
    wide = chunks.join(table.hint("merge"), "filepath", "left").withColumn("names_", F.coalesce("names_", F.expr("cast(map() as map<string,string>)")))
    tail = lambda c: F.substring_index(c, ".", -1)
    declared = lambda c: F.try_element_at(F.filter("symbols", lambda s: s["name"] == head(c)), F.lit(-1)).isNotNull()
    call = lambda c: F.when(dotted(c) & (F.element_at("names_", stands(c)).isNotNull() | F.coalesce(declared(c), F.lit(False))), F.concat_ws(".", F.coalesce(F.element_at("names_", stands(c)), stands(c)), tail(c))).otherwise(c)
    value = lambda v: F.when(v.endswith(".class"), F.concat(F.coalesce(F.element_at("names_", F.regexp_replace(v, r"\.class$", "")), F.regexp_replace(v, r"\.class$", "")), F.lit(".class"))).otherwise(v)
    annotation = lambda a: F.struct(a["text"].alias("text"), a["name"].alias("name"), F.transform_values(a["attributes"], lambda _, v: value(v)).alias("attributes"))
    return wide.withColumns({"calls": F.transform("calls", call), "annotations": F.transform("annotations", annotation)}).drop("names_")
