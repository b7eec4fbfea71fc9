"""Searching, reading and evaluating a stored index."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.encoder import Encoder, HashedEncoder, query_vectors
from siltstone.operators import search as S
from siltstone.operators.evaluate import CASE_ARRAYS, summarised, verdicts, version
from siltstone.schemas import EVAL_SUITE
from siltstone.sources.store import Files, Store


def search_code(spark: SparkSession, store: Store, query: str, *, top_k: int = 5, encoder: Encoder | None = None, probes: int | None = None, **filters: str | None) -> DataFrame:
    """Hits of one query, best first."""
    return search_many(spark, store, [("q", query)], top_k=top_k, encoder=encoder, probes=probes, **filters).orderBy("rank")


def search_many(spark: SparkSession, store: Store, queries: list[tuple[str, str]], *, top_k: int = 5, encoder: Encoder | None = None, probes: int | None = None, **filters: str | None) -> DataFrame:
    """Hits of many (id, text) queries in one plan: exact, or with ``probes`` by the inverted file, of which each query vector reads so many lists (0: as many as were measured)."""
    documents, vectors = store.read("documents"), store.read("vectors")
    if documents is None:
        raise LookupError("there is no index")
    encoder = encoder or HashedEncoder()
    asked = spark.createDataFrame([(i, q.strip()) for i, q in queries], "query_id STRING, query STRING")
    near = None if probes is None else lambda qv, keep, allowed: store.near(qv, keep, probes, allowed)
    how = f"{store.model() or encoder.name}/v{store.version()}/{'exact' if probes is None else f'probes-{probes}'}"
    return S.search(documents, vectors, asked, query_vectors(spark, queries, encoder), top_k, near=near, **filters).withColumn("retrieval_version", F.lit(how))


def read_code(store: Store, chunk_id: str, *, surrounding: bool = True, limit: int = 2):
    """The chunk as a row, or None."""
    documents = store.read("documents")
    return None if documents is None else S.read(documents, chunk_id, surrounding=surrounding, limit=limit).first()


def load_suite(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(settings, cases): absent numbers take their defaults, absent lists are empty."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", EVAL_SUITE).alias("s")).select("s.*").cache()
    head = text.first()
    cases = text.select(F.explode("cases").alias("c")).select("c.*")
    kinds = {"primary_lines": "array<int>", "primary_line_ranges": "array<array<int>>"}
    cases = cases.withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {kinds.get(c, 'array<string>')})")) for c in CASE_ARRAYS})
    settings = {k: head[k] for k in ("benchmark_version", "repo_name", "repo_commit", "model_name")} | {"top_k": 5 if head["top_k"] is None else head["top_k"], "line_tolerance": 25 if head["line_tolerance"] is None else head["line_tolerance"]}
    return settings, cases


def git_state(root: str) -> dict[str, str | bool | None]:
    """Commit of a work tree and whether it has changes; None where git can't tell."""
    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    status = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "dirty": None if status is None else bool(status)}


def run_suite(spark: SparkSession, store: Store, path: str, *, repo_root: str, top_k: int | None = None, encoder: Encoder | None = None, probes: int | None = None) -> dict:
    """Searches all cases in one plan and judges them.  top_k of None or 0 takes the suite's."""
    settings, cases = load_suite(spark, path)
    k = top_k or settings["top_k"]
    asked = [(r["case_id"], r["query"]) for r in cases.select("case_id", "query").collect()]
    hits = search_many(spark, store, asked, top_k=k, encoder=encoder, probes=probes).withColumnRenamed("query_id", "case_id").cache()
    results = verdicts(cases, hits, settings["line_tolerance"]).cache()
    summary = summarised(results).first().asDict() | {"retrieval_version": hits.agg(version(F.col("retrieval_version"))).first()[0]}
    manifest = store.manifest() or {}
    policies = {"search_request_width_policy": "max(user_top_k * 10, 50)", "repository_candidate_limit_policy": "max(search_top_k * 20, 100)", "probes": probes}
    return settings | summary | policies | {"fixture_path": path, "top_k": k, "index_model": manifest.get("model_name") or "unknown", "indexed_at": manifest.get("indexed_at") or "unknown", "git": git_state(repo_root), "fixture_sha256": fixture_hash(spark, path), "results": [r.asDict() for r in results.orderBy("case_id").collect()]}


def fixture_hash(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def write_artifact(spark: SparkSession, result: dict, path: str) -> None:
    """Sorted, indented JSON, in any store."""
    Files(spark).write(path, json.dumps(result, sort_keys=True, indent=2, default=str) + "\n")
