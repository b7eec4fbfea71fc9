"""The build workspace: source sets, their edges and what each can see.

A workspace is a small description file, so its graph lives on the driver; what is joined with files and symbols is
offered as DataFrames.
"""

from __future__ import annotations

import json
import os
import posixpath
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.scratch import stored

# Fixed values.
VERSION = 1
LISTS = ("source_roots", "generated_source_roots", "project_dependencies", "external_jars", "project_artifact_entries", "external_binary_entries", "output_dirs", "compile_classpath_entries", "runtime_classpath_entries")


def validate(data: object, *, require_version: bool = True) -> None:
    """Raises ValueError for anything that isn't a workspace of the known version."""
    if not isinstance(data, dict):
        raise ValueError("a workspace must be an object")
    version = data.get("schema_version")
    if version is None and require_version:
        raise ValueError("schema_version is missing")
    if version is not None and version != VERSION:
        raise ValueError(f"schema_version must be {VERSION}, not {version!r}")
    sets = data.get("source_sets")
    if not isinstance(sets, dict) or not all(isinstance(k, str) and isinstance(v, dict) for k, v in sets.items()):
        raise ValueError("source_sets must map names to objects")


def split_key(key: str) -> tuple[str, str]:
    """``:project:name`` -> (project, name), at the last colon."""
    project, _, name = key.rpartition(":")
    return project, name


def normal(path: str) -> str:
    return posixpath.normpath(path)


@dataclass(frozen=True)
class SourceSet:
    key: str
    source_roots: tuple[str, ...] = ()
    generated_source_roots: tuple[str, ...] = ()
    project_dependencies: tuple[str, ...] = ()
    external_jars: tuple[str, ...] = ()
    project_artifact_entries: tuple[str, ...] = ()
    external_binary_entries: tuple[str, ...] = ()
    output_dirs: tuple[str, ...] = ()
    compile_classpath_entries: tuple[str, ...] = ()
    runtime_classpath_entries: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return split_key(self.key)[1]

    @property
    def all_roots(self) -> tuple[str, ...]:
        return self.source_roots + self.generated_source_roots


@dataclass(frozen=True)
class Workspace:
    source_sets: dict[str, SourceSet] = field(default_factory=dict)
    jdk_home: str | None = None

    @classmethod
    def from_dict(cls, data: dict, *, require_version: bool = False) -> Workspace:
        validate(data, require_version=require_version)
        sets = {}
        for key, raw in data["source_sets"].items():
            values = {k: tuple(raw.get(k) or ()) for k in LISTS}
            values["external_binary_entries"] = values["external_binary_entries"] or values["external_jars"]
            sets[key] = SourceSet(key, **values)
        return cls(sets, data.get("jdk_home"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Workspace:
        """Reads the description through Spark, so it may lie in any store."""
        text = spark.read.text(path, wholetext=True).first()
        return cls.from_dict(json.loads(text[0]) if text else None, require_version=True)

    def main_only(self) -> Workspace:
        return Workspace({k: v for k, v in self.source_sets.items() if v.name == "main"}, self.jdk_home)

    def classpath_edges(self, key: str) -> list[str]:
        """Source sets whose output directories stand on the classpath of ``key``; itself left out."""
        owner = {normal(d): s.key for s in self.source_sets.values() for d in s.output_dirs}
        own = self.source_sets[key]
        found = (owner.get(normal(e)) for e in own.compile_classpath_entries + own.runtime_classpath_entries)
        return list(dict.fromkeys(k for k in found if k and k != key))

    def visible(self, key: str) -> list[str]:
        """All source sets that ``key`` reaches, itself first, in depth-first order; cycles are fine and unknown keys skipped."""
        seen: dict[str, None] = {}
        todo = [key]
        while todo:
            now = todo.pop()
            if now in seen or now not in self.source_sets:
                continue
            seen[now] = None
            todo += reversed([*self.source_sets[now].project_dependencies, *self.classpath_edges(now)])
        return list(seen)

    def visible_roots(self, key: str) -> list[str]:
        return list({normal(r): r for k in reversed(self.visible(key)) for r in reversed(self.source_sets[k].all_roots)}.values())[::-1]

    def visible_entries(self, key: str, what: str = "external_binary_entries") -> list[str]:
        return sorted({e for k in self.visible(key) for e in getattr(self.source_sets[k], what)})

    def visible_jars(self, key: str) -> list[str]:
        return [e for e in self.visible_entries(key) if e.endswith(".jar")]

    def owner(self, path: str) -> str | None:
        """The source set with the longest root above ``path``; the first listed of equal ones."""
        best, deepest = None, -1
        own = normal(path).split("/")
        for s in self.source_sets.values():
            for root in s.all_roots:
                parts = normal(root).split("/")
                if own[: len(parts)] == parts and len(parts) > deepest:
                    best, deepest = s.key, len(parts)
        return best

    # --- as tables

    def visibility(self, spark: SparkSession) -> DataFrame:
        """(source_set, container, origin_kind): what each source set sees: source sets and binary entries."""
        rows = [(k, v, "source") for k in self.source_sets for v in self.visible(k)] + [(k, e, "binary") for k in self.source_sets for e in self.visible_entries(k)]
        return spark.createDataFrame(rows, "source_set STRING, container STRING, origin_kind STRING")

    def roots(self, spark: SparkSession) -> DataFrame:
        """(source_set, root, ordinal) of all roots."""
        rows = [(s.key, normal(r)) for s in self.source_sets.values() for r in s.all_roots]
        return spark.createDataFrame([(k, r, i) for i, (k, r) in enumerate(rows)], "source_set STRING, root STRING, ordinal INT")


def owners(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Adds source_set: of the deepest root above each path, the first listed of equal ones; null without one.

    Paths are split into their ancestors and joined by equality, so the join is hashed, whatever the number of roots.
    """
    own = files.select(F.col(path).alias("path_")).distinct().withColumn("parts", F.split("path_", "/"))
    above = own.select("path_", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("root"))
    best = F.max(F.struct(F.size(F.split("root", "/")).alias("depth"), (-F.col("ordinal")).alias("first"), "source_set")).alias("m")
    found = above.join(roots, "root").groupBy("path_").agg(best).select("path_", F.col("m.source_set").alias("source_set"))
    return files.join(found, files[path] == found["path_"], "left").drop("path_")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(start, node): what each seed (start) reaches over edges (src, dst), itself included.  Edges may form cycles; ends when nothing is new.

    The relation is squared: each round joins the pairs found last with all known ones, so paths of twice the length are known after it, and the number of rounds is
    the logarithm of the longest path."""
    known = front = stored(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    while front.head(1):
        ahead = front.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))
        behind = front.join(known.select("src", F.col("dst").alias("mid")).select(F.col("src").alias("first"), "mid"), front["src"] == F.col("mid")).select(F.col("first").alias("src"), "dst")
        step = ahead.unionByName(behind).where("src <> dst").distinct()
        front = stored(step.join(known, ["src", "dst"], "left_anti"), "front")
        known = stored(known.unionByName(front), "reached")
    own = seeds.select("start").distinct()
    return own.select("start", F.col("start").alias("node")).unionByName(own.join(known, own["start"] == known["src"]).select("start", F.col("dst").alias("node")))


def inferred_edges(classpath: DataFrame, outputs: DataFrame) -> DataFrame:
    """classpath (src, entry), outputs (dst, entry) -> (src, dst): another set's output on the classpath.

    There may be far more pairs than rows, so none are held to be told apart: a pair of several common entries is given at the least of them.  For that each row
    carries the lesser entries of its set, of those that are outputs at all."""
    shared = classpath.join(outputs.select("entry").distinct(), "entry", "left_semi")

    def listed(rows: DataFrame, key: str, lesser: str) -> DataFrame:
        every = rows.where(F.col(key).isNotNull() & F.col("entry").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("entry")).alias("all_"))
        return every.select(key, "all_", F.posexplode("all_").alias("at_", "entry")).select(key, "entry", F.slice("all_", F.lit(1), F.col("at_")).alias(lesser))

    pairs = listed(shared, "src", "before_").join(listed(outputs, "dst", "before_too_"), "entry").where(F.col("src") != F.col("dst"))
    return pairs.where((F.size("before_") == 0) | (F.size("before_too_") == 0) | ~F.arrays_overlap("before_", "before_too_")).select("src", "dst")


#: Describes a Gradle build; see the file.
INIT_SCRIPT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "export_workspace.init.gradle")


def export_command(gradle_root: str, output: str) -> list[str]:
    """The command by which a Gradle build's own wrapper writes its workspace description."""
    return [os.path.join(gradle_root, "gradlew"), "-I", INIT_SCRIPT, "exportWorkspaceModel", f"-Poutput={output}"]
