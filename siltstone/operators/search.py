"""Late-interaction vector search, hybrid reranking and neighbour reads.

A chunk is one row (chunk_id, dims, matrix): its vectors, one after the other.  Queries come in batches: a table (query_id, q_row, vec) of query
vectors.  Its size is fixed by the user's queries; it goes to the tasks in slices of QUERY_ROWS vectors, one pass over the chunks each, the rows of a query
in one slice.

The exact search is map-only: a task multiplies the matrices it reads with the slice and keeps the best chunks of each query; only those are shuffled.
With an inverted file (``siltstone.operators.lists``) a search reads the lists next to its query vectors, and scores the shortlist exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.lexical import confidence, hybrid, query_terms, summary, term_sets
from siltstone.functions.lexical import symbol as symbol_of
from siltstone.functions.vectors import sane
from siltstone.scratch import stored

#: Query vectors in one broadcast.
QUERY_ROWS = 20_000
#: Products that are held at once.
PRODUCTS = 1 << 22
#: Chunks that a task scores before it keeps the best of them.
PRUNED_AT = 1 << 14


def matching(documents: DataFrame, *, kind: str | None = None, source_set: str | None = None, file_path: str | None = None) -> DataFrame:
    """Equality filters; an empty one doesn't filter."""
    for column, value in (("chunk_kind", kind), ("source_set", source_set), ("file_path", file_path)):
        if value:
            documents = documents.where(F.col(column) == value)
    return documents


def passes(queries: DataFrame) -> Iterator[pa.Table]:
    """The query vectors in slices of about QUERY_ROWS, each small enough to send to every task, in order of query and row."""
    rows = queries.select("query_id", "q_row", "vec")
    n = max(1, -(-rows.count() // QUERY_ROWS))
    for k in range(n):
        part = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)).toArrow()
        if part.num_rows:
            yield part.sort_by([("query_id", "ascending"), ("q_row", "ascending")]).combine_chunks()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of doubles; all must be equally long."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.unique(array.value_lengths().to_numpy(zero_copy_only=False)) if len(array) else np.array([0])
    if len(sizes) != 1 or np.isnan(sizes[0]):
        raise ValueError("vectors of different lengths")
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), int(sizes[0]))


def chunk_steps(batches: Iterator[pa.RecordBatch], width: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(chunks, their vectors as rows, where each chunk's begin), in steps of at most PRODUCTS products with ``width`` query rows; chunks without vectors are left out."""
    for whole in batches:
        whole = whole.filter(pc.greater(pc.list_value_length(whole.column("matrix")), 0))
        if not whole.num_rows:
            continue
        if set(whole.column("dims").unique().to_pylist()) != {dims}:
            raise ValueError("vectors of different lengths")
        sizes = whole.column("matrix").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // dims
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max(1, PRODUCTS // width), "right")))
            part = whole.slice(at, to - at)
            vectors = part.column("matrix").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            yield part, vectors, np.concatenate([[0], ends[at : to - 1] - base])
            at = to


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """All products; NaN ones count as none."""
    dots = vectors @ q.T
    dots[np.isnan(dots)] = -np.inf
    return dots


class _Best:
    """The best scores of each query; with ``k`` only so many are kept (of equal ones the least ids)."""

    def __init__(self, queries: pa.Array, k: int | None):
        self.queries, self.k = queries, k
        self.ids: list[pa.Array] = []
        self.scores: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: pa.Array, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        """score: a row for each id, a column for each query; -inf for none."""
        self.ids.append(ids)
        self.scores.append(score)
        self.n += len(ids)
        if self.k is None or self.n >= PRUNED_AT:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(query_id, chunk_id, score) of what was added since."""
        if not self.n:
            return
        score, ids = np.concatenate(self.scores), pa.concat_arrays(self.ids)
        self.ids, self.scores, self.n = [], [], 0
        able = score > -np.inf
        if self.k is not None and len(ids) > self.k:
            able &= score >= np.partition(score, len(ids) - self.k, axis=0)[len(ids) - self.k]
        query, row = np.nonzero(able.T)
        value = score[row, query].astype(np.float64)
        if self.k is not None:
            place = np.empty(len(ids), np.int64)
            place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
            order = np.lexsort((place[row], -value, query))
            query, row, value = query[order], row[order], value[order]
            begin = np.searchsorted(query, np.arange(len(self.queries)))
            first = np.arange(len(query)) - begin[query] < self.k
            query, row, value = query[first], row[first], value[first]
        for i in range(0, len(row), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(query[s])), ids.take(pa.array(row[s])), pa.array(value[s])], ["query_id", "chunk_id", "score"])


class _Scores(_Best):
    """Scores of chunks for all queries of a slice."""

    def __init__(self, part: pa.Table, k: int | None):
        self.q, ids = matrix(part.column("vec")), part.column("query_id").to_numpy()
        self.first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        super().__init__(part.column("query_id").take(pa.array(self.first)).combine_chunks(), k)

    def scored(self, vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
        best = np.maximum.reduceat(products(vectors, self.q), starts, axis=0)
        known = best > -np.inf
        score = np.add.reduceat(np.where(known, best, 0.0), self.first, axis=1)
        score[np.add.reduceat(known, self.first, axis=1, dtype=np.int64) == 0] = -np.inf
        return score


def _scored_schema(chunks: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double"


def _union(parts: list[DataFrame], chunks: DataFrame, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else chunks.sparkSession.createDataFrame([], schema)


def maxsim(chunks: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the sum over query rows of the best product with the chunk's vectors, NaN ones left out; with ``k`` only the
    best of each task, which are to be ranked further.  Nothing is shuffled."""
    schema = _scored_schema(chunks, queries)

    def scorer(part: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = _Scores(part, k)
            for batch, vectors, starts in chunk_steps(batches, *scores.q.shape):
                yield from scores.add(batch.column("chunk_id"), scores.scored(vectors, starts))
            yield from scores.rows()

        return run

    return _union([chunks.select("chunk_id", "dims", "matrix").mapInArrow(scorer(part), schema) for part in passes(queries)], chunks, schema)


def rescored(chunks: DataFrame, wanted: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of the pairs wanted (query_id, chunk_id): each chunk meets the queries that want it, and no others."""
    schema = _scored_schema(chunks, queries)
    lists = stored(wanted.groupBy("chunk_id").agg(F.collect_set("query_id").alias("asked")), "asked")
    met = chunks.select("chunk_id", "dims", "matrix").join(lists, "chunk_id")

    def scorer(part: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ids = matrix(part.column("vec")), part.column("query_id").to_pylist()
            rows: dict = {}
            for i, name in enumerate(ids):
                rows.setdefault(name, []).append(i)
            for batch, vectors, starts in chunk_steps(batches, *q.shape):
                out, ends = [], [*starts[1:], len(vectors)]
                for chunk, asked, s, e in zip(batch.column("chunk_id").to_pylist(), batch.column("asked").to_pylist(), starts, ends, strict=True):
                    own = [name for name in asked if name in rows]
                    if own:
                        best = products(vectors[s:e], q[np.concatenate([rows[name] for name in own])]).max(axis=0)
                        cuts = np.cumsum([0, *(len(rows[name]) for name in own)])
                        out += [(name, chunk, float(b[b > -np.inf].sum())) for name, b in zip(own, (best[i:j] for i, j in zip(cuts, cuts[1:])), strict=True) if (b > -np.inf).any()]
                kinds = (part.schema.field("query_id").type, batch.schema.field("chunk_id").type, pa.float64())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], ["query_id", "chunk_id", "score"])

        return run

    return _union([met.mapInArrow(scorer(part), schema) for part in passes(queries)], chunks, schema)


#: Different terms of the queries in one broadcast, and cells of a block of documents and terms.
QUERY_TERMS = 1 << 14
CELLS = 1 << 23


def overlaps(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): how many terms a document (chunk_id, terms, each once) shares with a query (query_id, terms); of each task the best k of each query,
    which are to be ranked further.  Documents and terms of a slice of queries make a table of 0 and 1, which is multiplied with that of terms and queries."""
    schema = _scored_schema(documents, queries)
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = max(1, -(-total // QUERY_TERMS))
    parts = [queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]

    def counter(ids: pa.Array, vocabulary: pa.Array, holds: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(ids, k)
            step = max(1, CELLS // max(1, len(vocabulary)))
            for whole in batches:
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    terms = batch.column("terms")
                    code = pc.index_in(terms.flatten(), value_set=vocabulary)
                    known = code.is_valid().to_numpy(zero_copy_only=False)
                    sizes = np.nan_to_num(terms.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                    table = np.zeros((len(batch), len(vocabulary)), np.float32)
                    table[np.repeat(np.arange(len(batch)), sizes)[known], code.drop_null().to_numpy()] = 1
                    count = table @ holds
                    count[count == 0] = -np.inf
                    yield from best.add(batch.column("chunk_id"), count)
            yield from best.rows()

        return run

    out = []
    for part in parts:
        rows = part.select("query_id", F.array_distinct("terms").alias("terms")).where(F.size("terms") > 0).toArrow().combine_chunks()
        if rows.num_rows:
            terms = rows.column("terms").combine_chunks()
            words = terms.flatten().dictionary_encode()
            holds = np.zeros((len(words.dictionary), rows.num_rows), np.float32)
            holds[words.indices.to_numpy(), np.repeat(np.arange(rows.num_rows), terms.value_lengths().to_numpy())] = 1
            out.append(documents.select("chunk_id", "terms").mapInArrow(counter(rows.column("query_id").combine_chunks(), words.dictionary, holds), schema))
    return _union(out, documents, schema)


def dot_totals(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n, total, best): how many vectors each query row met, the sum of all products and the greatest.  Every vector meets every
    query row, in blocks; a task sends one row per query row."""
    kinds = {f"q_{c}": v for c, v in queries.dtypes}
    schema = f"query_id {kinds['q_query_id']}, n long, total double, best double"

    def scorer(part: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = matrix(part.column("vec"))
            n, total, best = 0, np.zeros(len(q)), np.full(len(q), -np.inf)
            step = max(1, PRODUCTS // len(q))
            for whole in batches:
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    own = matrix(batch.column("vec"))
                    if own.shape[1] != q.shape[1]:
                        raise ValueError("vectors of different lengths")
                    dots = own @ q.T
                    n, total, best = n + len(own), total + dots.sum(axis=0), np.maximum(best, dots.max(axis=0))
            if n:
                yield pa.RecordBatch.from_arrays([part.column("query_id").combine_chunks(), pa.array(np.full(len(q), n)), pa.array(total), pa.array(best)], ["query_id", "n", "total", "best"])

        return run

    out = _union([vectors.select("vec").mapInArrow(scorer(part), schema) for part in passes(queries)], vectors, schema)
    return out.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"))


def shortlist(chunks: DataFrame, queries: DataFrame, per_row: int, keep: int) -> DataFrame:
    """(query_id, chunk_id, total): per shard and query row the ``per_row`` best vectors count (of equal ones those of greater chunk_id); chunks are ranked
    by the sum over rows and shards of their best.  chunks: with a column shard.  Each step sends at most ``per_row`` vectors per shard and query row."""
    types = dict(chunks.dtypes)
    asked = queries.withColumn("vec", sane(F.col("vec")))
    schema = f"shard {types['shard']}, query_id {dict(queries.dtypes)['query_id']}, q_row int, chunk_id {types['chunk_id']}, dot double"

    def searcher(part: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = matrix(part.column("vec"))
            for batch, vectors, starts in chunk_steps(batches, *q.shape):
                dots = products(vectors, q)
                owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(vectors)]))
                shard = batch.column("shard").dictionary_encode().indices.to_numpy(zero_copy_only=False)[owner]
                place = np.empty(len(starts), np.int64)
                place[pc.array_sort_indices(batch.column("chunk_id"), order="descending").to_numpy()] = np.arange(len(starts))
                for s in np.unique(shard):
                    rows = np.flatnonzero(shard == s)
                    own = dots[rows]
                    able = own > -np.inf
                    if len(rows) > per_row:
                        able &= own >= np.partition(own, len(rows) - per_row, axis=0)[len(rows) - per_row]
                    col, row = np.nonzero(able.T)
                    order = np.lexsort((place[owner[rows[row]]], -own[row, col], col))
                    col, row = col[order], row[order]
                    first = np.arange(len(col)) - np.searchsorted(col, np.arange(len(q)))[col] < per_row
                    col, row = col[first], row[first]
                    chunk, at = pa.array(owner[rows[row]]), pa.array(col)
                    yield pa.RecordBatch.from_arrays([batch.column("shard").take(chunk), part.column("query_id").take(at).combine_chunks(), part.column("q_row").take(at).cast(pa.int32()).combine_chunks(), batch.column("chunk_id").take(chunk), pa.array(own[row, col])], ["shard", "query_id", "q_row", "chunk_id", "dot"])

        return run

    rows = _union([chunks.select("chunk_id", "dims", "matrix", "shard").mapInArrow(searcher(part), schema) for part in passes(asked)], chunks, schema)
    near = W.partitionBy("query_id", "shard", "q_row").orderBy(F.desc("dot"), F.desc("chunk_id"))
    top = rows.withColumn("r", F.row_number().over(near)).where(F.col("r") <= per_row)
    best = top.groupBy("query_id", "shard", "q_row", "chunk_id").agg(F.max("dot").alias("best"))
    total = best.groupBy("query_id", "chunk_id").agg(F.sum("best").alias("total"))
    return ranked(total, "total", keep).select("query_id", "chunk_id", "total")


def ranked(rows: DataFrame, score: str, k: int, by: str = "query_id") -> DataFrame:
    """The k best rows of each query: highest score, then least chunk_id."""
    order = W.partitionBy(by).orderBy(F.desc(score), F.asc("chunk_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_search(chunks: DataFrame, queries: DataFrame, top_k: int, *, candidates: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact MaxSim over all chunks; or over the pairs of ``candidates`` (query_id, chunk_id), and the chunks of ``fresh``."""
    if top_k <= 0:
        return maxsim(chunks, queries).withColumn("rank", F.lit(0)).where(F.lit(False))
    scores = maxsim(chunks, queries, top_k) if candidates is None else rescored(chunks, candidates, queries)
    return ranked(scores if fresh is None else scores.unionByName(maxsim(fresh, queries, top_k)), "score", top_k)


def widths(top_k: int) -> tuple[int, int]:
    """Of a search for ``top_k`` hits: chunks that are reranked, chunks that a shortlist holds."""
    wide = max(10 * top_k, 50)
    return wide, max(20 * wide, 100)


def hits(found: DataFrame, documents: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """Reranks vector hits (query_id, chunk_id, score) by the hybrid score.  queries: (query_id, query).

    Columns: query_id, rank, chunk_id, kind, symbol, file_path, score, confidence, summary, why_matched, start_line, end_line,
    source_set, has_more.  A blank query has no hits."""
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = query_terms(queries.where(F.trim("query") != "").select("query_id", "query"), F.col("query"))
    wanted = stored(found.select("query_id", "chunk_id", F.col("score").alias("semantic")), "candidates")
    # Each document is tokenised once, for however many queries it is a candidate.  Few rows with much to do: spread
    # them, as adaptive execution goes by bytes alone.
    chosen = documents.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi").repartition(tasks, "chunk_id")
    chosen = chosen.withColumn("symbol", symbol_of(F.col("package"), F.col("owner_chain"), F.col("name")))
    chosen = stored(term_sets(chosen, {"name": F.col("name"), "symbol": F.col("symbol"), "signature": F.col("signature"), "path": F.col("file_path"), "text": F.col("retrieval_text")}), "terms")
    wide = wanted.join(chosen, "chunk_id").join(F.broadcast(own), "query_id").repartition(tasks, "query_id", "chunk_id")
    given = {"name": "name", "symbol": "symbol", "signature": "signature", "path": "file_path", "text": "retrieval_text", "kind": "chunk_kind", "source": "source_text"}
    scored = hybrid(wide, query=F.col("query"), semantic=F.col("semantic"), modifiers=F.col("modifiers"), **{k: F.coalesce(c, F.lit("")) for k, c in given.items()})
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    all_ = scored.withColumn("rank", F.row_number().over(order)).withColumn("has_more", F.count(F.lit(1)).over(W.partitionBy("query_id")) > top_k)
    return all_.where(F.col("rank") <= top_k).select(
        "query_id", "rank", "chunk_id", F.col("chunk_kind").alias("kind"), "symbol", "file_path", "score", confidence(F.col("score")).alias("confidence"),
        summary(F.col("source_text"), F.col("retrieval_text")).alias("summary"), "why_matched", "start_line", "end_line", "source_set", "has_more",
    )


def search(documents: DataFrame, chunks: DataFrame, queries: DataFrame, query_vectors: DataFrame, top_k: int = 5, *, near=None, **filters) -> DataFrame:
    """Filter, vector search for max(10 k, 50) candidates, rerank, first k.  The vector search is exact over all chunks that pass the filters; with ``near``, a function
    of (query vectors, how many chunks to keep, allowed chunks or None) that gives (candidates, fresh chunks), over those."""
    own = matching(documents, **filters)
    left = chunks.join(own.select("chunk_id"), "chunk_id", "left_semi") if any(filters.values()) else chunks
    wide, keep = widths(top_k)
    candidates, fresh = near(query_vectors, keep, own.select("chunk_id") if any(filters.values()) else None) if near else (None, None)
    return hits(vector_search(left, query_vectors, wide, candidates=candidates, fresh=fresh), own, queries, top_k)


def first_of_groups(rows: DataFrame, group: Column, rank: str, limit: int | None = None) -> DataFrame:
    """The first row of each group by ``rank``, in that order."""
    own = rows.withColumn("g_", group).withColumn("r_", F.row_number().over(W.partitionBy("g_").orderBy(rank))).where("r_ = 1").drop("g_", "r_").orderBy(rank)
    return own.limit(limit) if limit is not None else own


def enclosing_group() -> Column:
    """Group of a parsed chunk for first_of_groups: the skeleton of its enclosing type; a type and its skeleton are one group."""
    owner = F.coalesce(F.nullif(F.array_join("owner_chain", "."), F.lit("")), F.lit("-"))
    skeleton = F.concat_ws(":", F.coalesce("filepath", F.lit("<memory>")), F.lit("skeleton"), owner, "name", F.col("span.lo").cast("string"), F.col("span.hi").cast("string"))
    return F.when(F.col("kind").isin("type", "skeleton"), skeleton).otherwise(F.coalesce("parent_chunk_id", "chunk_id"))


def neighbours(targets: DataFrame, documents: DataFrame, limit: int = 2) -> DataFrame:
    """(target_id, rank, chunk_id, ...): the nearest other chunks of the same file by start line, then id; a missing line is 0.

    Of one line only the ``limit`` + 1 least ids can be among the nearest, and of the lines before and after a target only the ``limit`` next ones.  So the
    lines of a file are put in order once, each sees its neighbours there, and a target meets one row."""
    line = F.coalesce("start_line", F.lit(0))
    first = W.partitionBy("file_path", "line_").orderBy("chunk_id")
    heads = documents.select("file_path", line.alias("line_"), "chunk_id").withColumn("r_", F.row_number().over(first)).where(F.col("r_") <= limit + 1)
    lines = heads.groupBy("file_path", "line_").agg(F.collect_list(F.struct("line_", "chunk_id")).alias("heads_"))
    own = targets.select(F.col("chunk_id").alias("target_id"), "file_path", line.alias("line_"))
    # Lines of targets that aren't among the documents have no heads, and take the number of the line before.
    lines = lines.unionByName(own.select("file_path", "line_").distinct().join(lines, ["file_path", "line_"], "left_anti"), allowMissingColumns=True)
    before = W.partitionBy("file_path").orderBy("line_").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("number_", F.count("heads_").over(before))
    around = W.partitionBy("file_path").orderBy("number_").rangeBetween(-limit, limit)
    near = lines.withColumn("near_", F.flatten(F.collect_list("heads_").over(around))).select("file_path", "line_", "near_")
    met = own.join(near, ["file_path", "line_"])
    gaps = F.transform(F.filter("near_", lambda x: x["chunk_id"] != F.col("target_id")), lambda x: F.struct(F.abs(x["line_"] - F.col("line_")).alias("gap"), x["chunk_id"].alias("chunk_id")))
    best = met.select("target_id", "file_path", F.posexplode(F.slice(F.array_sort(gaps), 1, limit)).alias("p", "n"))
    rows = best.select("target_id", "file_path", F.col("n.chunk_id").alias("chunk_id"), F.col("n.gap").alias("gap"), (F.col("p") + 1).alias("rank"))
    return rows.join(documents, ["file_path", "chunk_id"])


def read(documents: DataFrame, chunk_id: str, *, surrounding: bool = True, limit: int = 2) -> DataFrame:
    """One row: the chunk, its context and its neighbours; no row if the id is unknown."""
    one = documents.where(F.col("chunk_id") == chunk_id).limit(1)
    context = F.struct(F.col("package").alias("package_name"), "owner_chain", "source_set", "indexed_at").alias("surrounding_context")
    out = one.select("chunk_id", F.col("chunk_kind").alias("kind"), symbol_of(F.col("package"), F.col("owner_chain"), F.col("name")).alias("symbol"), "file_path", "start_line", "end_line", "source_text", summary(F.col("source_text"), F.col("retrieval_text")).alias("summary"), context)
    none = F.expr("cast(array() as array<struct<rank:int,chunk_id:string,kind:string,symbol:string,start_line:int,end_line:int>>)")
    if not surrounding:
        return out.withColumn("neighbors", none)
    near = neighbours(one, documents.join(F.broadcast(one.select("file_path")), "file_path", "left_semi"), limit)
    listed = near.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col("chunk_kind").alias("kind"), symbol_of(F.col("package"), F.col("owner_chain"), F.col("name")).alias("symbol"), "start_line", "end_line"))).alias("neighbors"))
    return out.join(listed, out["chunk_id"] == listed["target_id"], "left").drop("target_id").withColumn("neighbors", F.coalesce("neighbors", none))
