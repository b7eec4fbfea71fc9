"""Ranked lexical search by WAND, shard by shard.

One pass over the texts makes shards: of a bounded number of documents the places and counts of the words that any item asks for, sorted by
document id.  The shards are stored; their sums give the number of documents N, of words L, and of documents with each word, from which the weights follow.

In each shard every item is answered by itself.  Each of its words has a list of documents, a cursor, and its greatest impact in the
shard.  The cursors stand in order of their documents; the pivot is the first at which the impacts, added up, exceed the heap's
threshold.  No document before the pivot can enter the heap, so all cursors jump there.  From the pivot on, a run of documents is taken at once: those whose own
words' greatest impacts can't beat the threshold are skipped, the others are scored, and the best go to the heap.  The heaps of the shards
are merged by Spark, at most ``k`` rows a shard and item.

Items go in slices of bounded size, one pass over the texts for each slice, so what is sent to the tasks doesn't grow with the table of items.

Results: a null or wordless text matches nothing, as a document or as an item.  Each row of the items is a query, also if its id is null or
occurs twice.  Of equal scores the least doc_id comes first (null ones last); repeated documents each take a rank.  Ids may be of any type that can be
sorted.  An empty table of documents or items gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.textops import LOWER, Shared, chunks, documents, owners, pieces, spans_hash, stored, text_buffers

K = 10
#: Bytes of items in one slice, about.
SLICE_BYTES = 1 << 20
SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 20
#: Documents that are taken at once from a pivot on, at most.
RUN = 512


def _term_table() -> np.ndarray:
    """Bytes of words: ASCII digits and letters, and all bytes of other characters."""
    table = np.zeros(256, dtype=bool)
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = True
    return table


TERM = _term_table()


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each document's first word)."""
    starts, ends, first = pieces(TERM[data], offsets)
    return spans_hash(LOWER[data], starts, ends), first


@dataclass
class Asked:
    """The words of a slice of items: sorted hashes; and for each item its codes (places among the hashes) and how often it has each."""

    hashes: np.ndarray
    names: list
    items: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, names: list, texts: list[str | None]) -> Asked:
        own = []
        for text in texts:
            data = np.frombuffer((text or "").encode(), np.uint8)
            own.append(np.unique(terms(data, np.array([0, len(data)]))[0], return_counts=True))
        hashes = np.unique(np.concatenate([h for h, _ in own])) if own else np.zeros(0, np.uint64)
        return cls(hashes, names, [(np.searchsorted(hashes, h), n) for h, n in own])

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash, -1 for other words."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


@dataclass
class Shard:
    """Documents in order of their ids, with their numbers of words; postings in order of word and document."""

    ids: pa.Array
    lengths: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, lengths: np.ndarray, code: np.ndarray, doc: np.ndarray, count: np.ndarray) -> Shard:
        order = pc.array_sort_indices(ids).to_numpy()  # nulls last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = place[doc]
        by = np.lexsort((doc, code))
        code, doc, count = code[by], doc[by], count[by]
        own, starts = np.unique(code, return_index=True)
        return cls(ids.take(pa.array(order)), lengths[order], own, np.append(starts, len(code)), doc, count)


def _shards(docs: DataFrame, asked: Shared, shard_docs: int, shard_postings: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(ids: list, lengths: list, codes: list, places: list, counts: list, n: int, total: int) -> pa.RecordBatch:
        held = pa.concat_arrays(ids) if ids else None
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        if held is None:
            lists = [None] * 6
        else:
            shard = Shard.of(held, join(lengths, np.int64), join(codes, np.int64), join(places, np.int64), join(counts, np.int64))
            lists = [shard.ids, *(pa.array(x, t) for x, t in zip((shard.lengths, shard.terms, np.diff(shard.starts), shard.docs, shard.counts), KINDS, strict=True))]
        columns = [pa.array([n], pa.int64()), pa.array([total], pa.int64())]
        for x, t in zip(lists, [id_type[0], *KINDS], strict=True):
            columns.append(pa.nulls(1, pa.list_(t)) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
        return pa.RecordBatch.from_arrays(columns, NAMES)

    KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    NAMES = ["n", "total", "ids", "lengths", "terms", "sizes", "docs", "counts"]
    id_type: list = [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, ...] = ([], [], [], [], [])
        held = postings = n = total = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id")
            id_type[0] = ids.type
            for i, j, b, o in chunks(data, offsets):
                hashes, first = terms(b, o)
                sizes = np.diff(first)
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
                code = asked.value.codes(hashes)
                known = code >= 0
                key, count = np.unique(code[known] * (j - i) + owners(first)[known], return_counts=True)
                code, doc = key // (j - i), key % (j - i)
                met, doc = np.unique(doc, return_inverse=True)
                for part, x in zip(parts, (ids.take(pa.array(i + met)), sizes[met], code, held + doc, count), strict=True):
                    part.append(x)
                held, postings = held + len(met), postings + len(key)
                if held >= shard_docs or postings >= shard_postings:
                    yield pack(*parts, n, total)
                    parts, held, postings, n, total = ([], [], [], [], []), 0, 0, 0, 0
        if n:
            yield pack(*parts, n, total)

    return docs.select("doc_id", "text").mapInArrow(run, f"n long, total long, ids array<{kind}>, lengths array<bigint>, terms array<int>, sizes array<int>, docs array<int>, counts array<int>")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def wand(lists: list[tuple[np.ndarray, np.ndarray]], k: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best, best first, of equal ones the first.  lists: the documents of each word, ascending, and their impacts."""
    lists = [x for x in lists if len(x[0])]
    best, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if not lists:
        return best, scores
    most = np.array([impacts.max() for _, impacts in lists])
    cursor = np.zeros(len(lists), np.int64)
    at = np.array([docs[0] for docs, _ in lists])
    end = 1 + max(int(docs[-1]) for docs, _ in lists)
    while True:
        order = np.argsort(at, kind="stable")
        reach = np.cumsum(most[order])
        first = int(np.searchsorted(reach, threshold, "right"))
        if first == len(order) or at[order[first]] == end:
            return best, scores
        pivot = int(at[order[first]])
        after = pivot + run
        docs, impacts, bounds = [], [], []
        for t, (own, gains) in enumerate(lists):
            if at[t] >= after:
                continue
            lo = cursor[t] if at[t] >= pivot else cursor[t] + np.searchsorted(own[cursor[t] :], pivot)
            hi = lo + np.searchsorted(own[lo:], after)
            docs.append(own[lo:hi] - pivot)
            impacts.append(gains[lo:hi])
            bounds.append(np.full(hi - lo, most[t]))
            cursor[t], at[t] = hi, own[hi] if hi < len(own) else end
        place = np.concatenate(docs)
        bound, score = np.zeros(run, np.int64), np.zeros(run, np.int64)
        np.add.at(bound, place, np.concatenate(bounds))
        able = bound > threshold
        use = able[place]
        if not use.any():
            continue
        np.add.at(score, place[use], np.concatenate(impacts)[use])
        new = np.flatnonzero(score > threshold)
        best, scores = np.concatenate([best, pivot + new]), np.concatenate([scores, score[new]])
        keep = np.argsort(-scores, kind="stable")[:k]
        best, scores = best[keep], scores[keep]
        threshold = int(scores[-1]) if len(scores) == k else 0


def answers(shard: Shard, asked: Asked, weights: np.ndarray, n: int, total: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the item, documents, scores) of every item with hits."""
    norm = 100 - 75 + (75 * shard.lengths * n) // total
    sizes = np.diff(shard.starts)
    impact = np.repeat(weights[shard.terms], sizes) * ((1_000_000_000 * shard.counts) // (1000 * shard.counts + 8 * norm[shard.docs]))
    for item, (codes, often) in enumerate(asked.items):
        at = np.searchsorted(shard.terms, codes)
        at_, often_ = at[at < len(shard.terms)], often[at < len(shard.terms)]
        here = shard.terms[at_] == codes[at < len(shard.terms)]
        lists = [(shard.docs[s:e], impact[s:e] * m) for s, e, m in zip(shard.starts[at_[here]], shard.starts[at_[here] + 1], often_[here], strict=True)]
        docs, scores = wand(lists, k)
        if len(docs):
            yield item, docs, scores


def _searched(docs: DataFrame, items: DataFrame, k: int, shard_docs: int, shard_postings: int) -> DataFrame:
    """(item_, doc_id, score): the best k of each shard, for one slice of items (item_, text)."""
    spark = docs.sparkSession
    rows = items.select("item_", "text").collect()
    asked = Asked.of([r["item_"] for r in rows], [r["text"] for r in rows])
    shards = stored(_shards(docs, Shared(spark, asked), shard_docs, shard_postings), "shards")
    n, total = (x or 0 for x in shards.agg(F.sum("n"), F.sum("total")).first())
    found = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes").alias("df")).collect()
    weights = np.zeros(len(asked.hashes), np.int64)
    for r in found:
        weights[r["terms"]] = weight(n, r["df"])
    shared = Shared(spark, (asked, weights))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, *lists = (batch.column(c)[i].values for c in ("ids", "lengths", "terms", "sizes", "docs", "counts"))
                if ids is None:
                    continue
                lengths, terms, sizes, docs, counts = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
                shard = Shard(ids, lengths, terms, np.concatenate([[0], np.cumsum(sizes)]), docs, counts)
                out = list(answers(shard, asked, weights, n, total, k))
                if out:
                    names = [asked.names[item] for item, d, _ in out for _ in range(len(d))]
                    at = pa.array(np.concatenate([d for _, d, _ in out]))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), ids.take(at), pa.array(np.concatenate([s for _, _, s in out]))], ["item_", "doc_id", "score"])

    return shards.select("ids", "lengths", "terms", "sizes", "docs", "counts").mapInArrow(run, f"item_ long, doc_id {kind}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, *, slice_bytes: int = SLICE_BYTES, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank (from 1), doc_id, score: the k highest-scoring documents of each item, all scores above 0."""
    asked = stored(items.select("item_id", "text").withColumn("item_", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // slice_bytes))
    slices = [asked if n == 1 else asked.where(F.pmod(F.xxhash64("item_"), F.lit(n)) == i) for i in range(n)]
    best = reduce(DataFrame.unionByName, [_searched(docs, own, k, shard_docs, shard_postings) for own in slices])
    order = W.partitionBy("item_").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.select("item_", "item_id"), "item_").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle_sql() -> str:
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {words} AS w FROM documents),
    g AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
    q AS (SELECT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {words} AS w FROM benchmark)),
    p AS (SELECT rn, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
    t AS (SELECT rn, any_value(doc_id) AS doc_id, any_value(n) AS dn, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY rn, term),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(g.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, g GROUP BY term),
    s AS (SELECT i, any_value(item_id) AS item_id, any_value(t.doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * dn * g.n) // g.l))))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term), g GROUP BY i, rn)
    SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
