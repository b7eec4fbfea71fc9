"""An inverted file of vectors: searches read only the lists next to their query vectors.

Centroids come from spherical k-means, whose rounds are Spark jobs over a bounded sample of the vectors (SAMPLE for each list); then every vector
of every chunk goes to its nearest centroid, and the lists are written as partitions of one table.  A query row probes the lists of its nearest
centroids: the union of all lists that a slice of queries probes is a partition filter, so files of other lists aren't read, and a list meets only the rows that probe
it.  How many lists must be probed depends on the vectors, so it is measured when the file is made.  A chunk's bound for a query row that found none of its vectors is the product with the nearest centroid that wasn't probed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.encoder import QUERY_TOKENS
from siltstone.operators.search import _Scores, chunk_steps, matrix, passes, products, ranked, vector_search
from siltstone.scratch import stored

#: Vectors of the sample for each list.
SAMPLE = 64
ROUNDS = 6
MOST_LISTS = 4096
#: Lists that a query row probes.
PROBES = 16
#: The share of an exact search's best chunks that a calibrated search finds at least.
RECALL = 0.9
#: Bytes of a gain that is shuffled, about.
GAIN_BYTES = 32
#: Tasks that write one list, at most.
WRITERS = 4


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def centroids(chunks: DataFrame, n: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """The unit centroids of the lists, at most ``n`` (by default four times the root of the number of vectors); chunks (chunk_id, dims, matrix)."""
    size = F.size("matrix") / F.col("dims")
    total, dims, least = chunks.where(F.size("matrix") > 0).agg(F.sum(size), F.max("dims"), F.min("dims")).first()
    if not total:
        return np.zeros((0, 0))
    if dims != least:
        raise ValueError("vectors of different lengths")
    n = max(1, min(n or MOST_LISTS, MOST_LISTS, math.ceil(4 * math.sqrt(total)), int(total)))
    share = min(1.0, SAMPLE * n / total)
    rows = chunks.where(F.size("matrix") > 0).select(F.xxhash64("chunk_id").alias("h"), F.explode(F.sequence(F.lit(0), size.cast("int") - 1)).alias("i"), "dims", "matrix")
    mark = F.pmod(F.xxhash64("h", "i"), F.lit(1 << 40))
    sample = stored(rows.where(mark < math.ceil(share * (1 << 40))).select(mark.alias("mark"), F.slice("matrix", F.col("i") * F.col("dims") + 1, F.col("dims")).alias("vec")), "sample")
    own = _unit(matrix(sample.orderBy("mark").limit(n).select("vec").toArrow().column("vec")))

    def moved(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape), np.zeros(len(now), np.int64)
            for batch in batches:
                if batch.num_rows:
                    vectors = _unit(np.nan_to_num(matrix(batch.column("vec"))))
                    near = (vectors @ now.T).argmax(axis=1)
                    np.add.at(total, near, vectors)
                    count += np.bincount(near, minlength=len(now))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["list", "total"])

        return run

    for _ in range(rounds):
        parts = sample.select("vec").mapInArrow(moved(own), "list int, total array<double>")
        sums = parts.groupBy("list").agg(F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(dims))).alias("total")).collect()
        own = own.copy()
        for r in sums:
            own[r["list"]] = r["total"]
        own = _unit(own)
    return own


def write_lists(chunks: DataFrame, own: np.ndarray, path: str, *keep: str) -> None:
    """Deals the vectors of all chunks to the lists of their nearest centroids: rows (chunk_id, keep..., dims, matrix), partitioned by list."""
    types = dict(chunks.dtypes)
    schema = ", ".join(["list int", f"chunk_id {types['chunk_id']}", *(f"`{k}` {types[k]}" for k in keep), "dims int, matrix array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors, starts in chunk_steps(batches, *own.shape):
            vectors = np.nan_to_num(vectors)
            near = (vectors @ own.T).argmax(axis=1)
            owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(vectors)]))
            order = np.lexsort((near, owner))
            code = owner[order] * len(own) + near[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            offsets = np.append(first, len(code)) * own.shape[1]
            rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(vectors[order].astype(np.float32).ravel()))
            at = pa.array(owner[order][first])
            yield pa.RecordBatch.from_arrays([pa.array(near[order][first], pa.int32()), *(batch.column(c).take(at) for c in ("chunk_id", *keep)), pa.array(np.full(len(first), own.shape[1], np.int32)), rows], ["list", "chunk_id", *keep, "dims", "matrix"])

    rows = chunks.select("chunk_id", *keep, "dims", "matrix").mapInArrow(run, schema)
    rows.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(WRITERS))).write.partitionBy("list").parquet(path)


def gathered(lists: DataFrame) -> DataFrame:
    """(chunk_id, dims, lists, matrix): the vectors of each chunk in one row, and the list of each."""
    rows = lists.groupBy("chunk_id", "dims").agg(F.collect_list(F.struct("list", "matrix")).alias("v_"))
    of_each = F.transform("v_", lambda x: F.array_repeat(x["list"], (F.size(x["matrix"]) / F.col("dims")).cast("int")))
    return rows.select("chunk_id", "dims", F.flatten(of_each).alias("lists"), F.flatten(F.transform("v_", lambda x: x["matrix"])).alias("matrix"))


def candidates(lists: DataFrame, own: np.ndarray, queries: DataFrame, keep: int, probes: int = PROBES) -> DataFrame:
    """(query_id, chunk_id): the ``keep`` chunks of each query with the greatest bounds.  lists: what ``write_lists`` wrote, filtered or not.

    A chunk's vectors lie in several lists, so something must travel before its bound is known: a gain for each query row that meets it in a list, or, where so many query rows
    probe a list that these would be more bytes than its vectors, the vectors, once for all queries; then a task keeps the best bounds of each query."""
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(lists.dtypes)['chunk_id']}, q_row int, gain double"

    def searcher(part: pa.Table, q: np.ndarray, probed: np.ndarray, missing: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, vectors, starts in chunk_steps(batches, *q.shape):
                own_list, ends = batch.column("list").to_numpy(), np.append(starts[1:], len(vectors))
                for one in np.unique(own_list):
                    rows, asked = np.flatnonzero(own_list == one), np.flatnonzero(probed[:, one])
                    if not len(asked):
                        continue
                    sizes = ends[rows] - starts[rows]
                    take = np.concatenate([np.arange(s, e) for s, e in zip(starts[rows], ends[rows], strict=True)])
                    best = np.maximum.reduceat(products(vectors[take], q[asked]), np.cumsum(np.append(0, sizes[:-1])), axis=0) - missing[asked]
                    chunk, query = np.nonzero(best > 0)
                    at, row = pa.array(asked[query]), pa.array(rows[chunk])
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(at).combine_chunks(), batch.column("chunk_id").take(row), part.column("q_row").take(at).cast(pa.int32()).combine_chunks(), pa.array(best[chunk, query])], ["query_id", "chunk_id", "q_row", "gain"])

        return run

    def bounder(part: pa.Table, probed: np.ndarray | None, missing: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = _Scores(part, keep)
            q = np.nan_to_num(scores.q)
            for batch, vectors, starts in chunk_steps(batches, *q.shape):
                gain = products(vectors, q) - missing
                if probed is not None:
                    gain[~probed[:, batch.column("lists").flatten().to_numpy()].T] = -np.inf
                total = np.add.reduceat(np.maximum(np.maximum.reduceat(gain, starts, axis=0), 0), scores.first, axis=1)
                total[total <= 0] = -np.inf
                yield from scores.add(batch.column("chunk_id"), total)
            yield from scores.rows()

        return run

    parts, many, totals = [], [], []
    for part in passes(queries) if len(own) else ():
        q = np.nan_to_num(matrix(part.column("vec")))
        near = q @ own.T
        order = np.argsort(-near, axis=1, kind="stable")
        probed = np.zeros(near.shape, bool)
        np.put_along_axis(probed, order[:, :probes], True, axis=1)
        rest = np.where(probed, -np.inf, near)
        # Below the nearest centroid that isn't probed a product says no more than that there is none.
        missing = np.where(probed.all(axis=1), -1e9, rest.max(axis=1))
        touched = np.flatnonzero(probed.any(axis=0))
        if probed.sum() * GAIN_BYTES > len(touched) * (4 * q.shape[1] + GAIN_BYTES):
            many.append((part, None if probed.all() else probed, missing, touched))
            continue
        wanted = lists.where(F.col("list").isin(touched.tolist()))
        parts.append(wanted.select("list", "chunk_id", "dims", "matrix").mapInArrow(searcher(part, q, probed, missing), schema))
    if parts:
        best = reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id", "q_row").agg(F.max("gain").alias("gain"))
        totals.append(best.groupBy("query_id", "chunk_id").agg(F.sum("gain").alias("gain")))
    if many:
        wanted = lists.where(F.col("list").isin(reduce(np.union1d, (m[3] for m in many)).tolist()))
        whole = stored(gathered(wanted), "gathered")
        totals += [whole.mapInArrow(bounder(*m[:3]), schema.replace("q_row int, gain", "score")).withColumnRenamed("score", "gain") for m in many]
    if not totals:
        return lists.sparkSession.createDataFrame([], schema).select("query_id", "chunk_id")
    return ranked(reduce(DataFrame.unionByName, totals), "gain", keep).select("query_id", "chunk_id")


def calibrated(chunks: DataFrame, lists: DataFrame, own: np.ndarray, k: int, keep: int, target: float = RECALL, n: int = 32) -> tuple[int, float]:
    """(probes, recall): the fewest lists, doubled from PROBES on, by which ``n`` chunks, asked as queries, find the share ``target`` of their k best of an exact search."""
    some = stored(chunks.where(F.size("matrix") > 0).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n), "calibration")
    row = F.slice("matrix", F.col("q_row") * F.col("dims") + 1, F.col("dims"))
    asked = some.select(F.col("chunk_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.least((F.size("matrix") / F.col("dims")).cast("int"), F.lit(QUERY_TOKENS)) - 1)).alias("q_row"), "dims", "matrix")
    asked = stored(asked.select("query_id", "q_row", row.alias("vec")), "calibration")
    found = lambda near=None: {(r["query_id"], r["chunk_id"]) for r in vector_search(chunks, asked, k, candidates=near).select("query_id", "chunk_id").collect()}
    best, probes = found(), PROBES
    while probes < len(own):
        recall = len(best & found(candidates(lists, own, asked, keep, probes))) / max(1, len(best))
        if recall >= target:
            return probes, recall
        probes *= 2
    return len(own), len(best & found(candidates(lists, own, asked, keep, len(own)))) / max(1, len(best))


def put_centroids(spark: SparkSession, own: np.ndarray, path: str) -> None:
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(own)], "list INT, vec ARRAY<DOUBLE>").coalesce(1).write.parquet(path)


def get_centroids(spark: SparkSession, path: str) -> np.ndarray:
    """At most MOST_LISTS rows."""
    rows = spark.read.schema("list INT, vec ARRAY<DOUBLE>").parquet(path).orderBy("list").toArrow()
    return matrix(rows.column("vec")) if rows.num_rows else np.zeros((0, 0))
