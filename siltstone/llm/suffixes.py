"""Suffix-array removal of repeated passages: every byte that lies in a string of ``length`` bytes which also starts anywhere else.

A full suffix array of the corpus has one suffix a byte.  Here it is sparse.  Each window of ``length`` bytes names one suffix: the one at
its anchor, the place of the least hash among the window's grams.  The choice hangs on the window's bytes alone, so equal windows have
equal anchors at equal places, and about one suffix in 150 bytes is enough to find all repeats:

1. ``anchors``: one pass over the texts gives each anchor with the run of windows that name it.  The bytes of such a run are a block.
2. Grams that occur once can't repeat.  Equal blocks are counted together (so copies of a text, however many, are one row); where a block
   occurs twice, all its windows repeat.
3. Blocks of a gram that has different blocks are suffixes to be sorted.  Sampled splitters range-partition them by their leading bytes from
   the anchor on: the gram's bytes, and for grams with more than BUCKET_BLOCKS blocks all bytes from there and then those before, backwards, so that no
   two keys of such a gram are equal and any number of blocks can be split.  Each bucket sorts its suffixes by multikey quicksort, and the bytes that neighbours share to the right and to the left tell which windows they share; so does an order by the
   bytes to the left.  Windows that both orders leave open are compared by hash.
4. A large gram's blocks lie on both sides of splitters.  A suffix shares no more with those beyond than with the bucket's first or last one; the windows within that are
   compared across all buckets.
5. The windows found go back to every text that holds the block, and each text is cut once.

Grams, blocks and texts are told apart by 64-bit hashes (texts by two of them), and windows within a gram by one more.

Results: a null text is an empty one; texts shorter than ``length`` are kept whole; an empty table gives an empty table; repeated rows are
documents of their own, and so are wholly removed if they are long enough.  Texts are never cut at a length: long ones go in overlapping segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from siltstone.llm.textops import chunks, documents, spans_hash, stored, text_buffers

LENGTH = 400
#: Windows of one text that are handled at once.
SEGMENT = 1 << 22
#: Blocks in one bucket, about.
BUCKET_BLOCKS = 20_000
PLACE_BITS = 24
BLOCK = ["gram", "block", "off", "n"]
KEYS = ["key_a", "key_b"]
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept"]


def gram_length(length: int) -> int:
    return max(1, length // 4)


def anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, anchor, number of windows, gram hash, block hash) of every run of windows with one anchor; places within ``data``."""
    gram, none = gram_length(length), np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    places = np.arange(len(data) - gram + 1)
    hashes = spans_hash(data, places, places + gram)
    # Of equal hashes the leftmost is least.
    key = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places.astype(np.uint64)
    wide = length - gram + 1
    blocks = np.concatenate([key, np.full(-len(key) % wide, ~np.uint64(0))]).reshape(-1, wide)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: len(key) - wide + 1], before[wide - 1 : len(key)])
    at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    windows = np.flatnonzero(np.arange(len(at)) + length <= offsets[doc + 1])
    if not len(windows):
        return none, none, none, none, none, none
    at, doc = at[windows], doc[windows]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    lo, hi = windows[first], windows[last]
    return doc[first], lo, at[first], hi - lo + 1, hashes[at[first]].view(np.int64), spans_hash(data, lo, hi + length).view(np.int64)


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """texts (key_a, key_b, text) -> (gram, block, off, n, key_a, key_b, lo): each block by its hashes, with the place of its anchor, its number of windows, its text and where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            keys = [batch.column(k).to_numpy() for k in KEYS]
            for i, _, own, at in chunks(data, offsets):
                for a in range(0, max(1, len(own) - length + 1), SEGMENT) if len(at) == 2 else (0,):
                    part, part_at = (own[a : a + SEGMENT + length - 1], None) if len(at) == 2 else (own, at)
                    part_at = np.array([0, len(part)]) if part_at is None else part_at
                    doc, lo, anchor, n, gram, block = anchored(part, part_at, length)
                    if len(doc):
                        columns = [gram, block, (anchor - lo).astype(np.int32), n.astype(np.int32), keys[0][i + doc], keys[1][i + doc], lo - part_at[doc] + a]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*BLOCK, *KEYS, "lo"])

    return texts.mapInArrow(run, "gram long, block long, off int, n int, key_a long, key_b long, lo long")


def fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (gram, block, off, n, c, large, key_a, key_b, lo) -> (gram, block, off, n, c, large, right, left): the bytes from the anchor on, and those before it backwards."""
    lists = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct(*BLOCK, "c", "large", "lo")).alias("blocks"))
    lists = stored(lists, "wanted-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # copies of one text would give the same blocks again
        for batch in batches:
            out = []
            for a, b, text, blocks in zip(*(batch.column(c).to_pylist() for c in KEYS), batch.column("text"), batch.column("blocks").to_pylist(), strict=True):
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                data = text.as_py().encode()
                for x in blocks:
                    own, off = data[x["lo"] : x["lo"] + x["n"] - 1 + length], x["off"]
                    out.append((x["gram"], x["block"], off, x["n"], x["c"], x["large"], own[off:], own[:off][::-1]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], [*BLOCK, "c", "large", "right", "left"])

    return texts.join(lists, KEYS).mapInArrow(run, "gram long, block long, off int, n int, c long, large boolean, right binary, left binary")


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix of words: three-way partition by the word at one depth; rows that are equal there go on at the first depth where they differ."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        own = order[lo:hi]
        ahead = words[own, depth:]
        differs = (ahead != ahead[0]).any(axis=0)
        if not differs.any():
            continue
        depth += int(differs.argmax())
        word = words[own, depth]
        pivot = word[len(word) // 2]
        less, equal = word < pivot, word == pivot
        a, b = int(less.sum()), int(equal.sum())
        order[lo:hi] = np.concatenate([own[less], own[equal], own[~less & ~equal]])
        todo += [(lo, lo + a, depth), (lo + a, lo + a + b, depth + 1), (lo + a + b, hi, depth)]
    return order


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of bytes, padded with 0, lengths)."""
    data, offsets = text_buffers(column)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), -(-width // 8) * 8), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(data)) - offsets[row]] = data
    return out, sizes


def _words(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words that sort as the bytes do; the length is the last, since bytes of 0 at an end look like the padding."""
    return np.column_stack([rows.view(">u8").astype(np.uint64), sizes.astype(np.uint64)])


def _shared(rows: np.ndarray, sizes: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows p and q share."""
    differs = rows[p] != rows[q]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[p], sizes[q]))


def bucket_repeats(gram: np.ndarray, off: np.ndarray, n: np.ndarray, c: np.ndarray, right: pa.Array, left: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repeats, edge, hashes): for each block and window whether the window occurs twice among these blocks, and whether the block before the first
    in order, or after the last, could hold it; and a function that hashes windows (block, window)."""
    rights, right_size = _matrix(right, length)
    lefts, left_size = _matrix(left, length)
    window = np.arange(int(n.max()))
    inside = window < n[:, None]
    repeats = inside & (c > 1)[:, None]
    reach_right, reach_left = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)

    def meet(order: np.ndarray) -> None:
        p, q = order[:-1], order[1:]
        same = gram[p] == gram[q]
        p, q = p[same], q[same]
        r, s = _shared(rights, right_size, p, q), _shared(lefts, left_size, p, q)
        for one in (p, q):
            # Window i starts off - i bytes before the anchor.
            repeats[one] |= inside[one] & (window >= (off[one] - s)[:, None]) & (window <= (off[one] + r - length)[:, None])
            np.maximum.at(reach_right, one, r)
            np.maximum.at(reach_left, one, s)

    by_right = multikey_quicksort(_words(rights, right_size))
    meet(by_right)
    meet(multikey_quicksort(np.column_stack([gram.view(np.uint64), _words(lefts, left_size)])))

    flat = np.concatenate([np.concatenate([lefts[i, : left_size[i]][::-1], rights[i, : right_size[i]]]) for i in range(len(n))])
    begin = np.concatenate([[0], np.cumsum(left_size + right_size)])[:-1]

    def hashes(block: np.ndarray, i: np.ndarray) -> np.ndarray:
        return spans_hash(flat, begin[block] + i, begin[block] + i + length).view(np.int64)

    possible = inside & (window >= (off - reach_left)[:, None]) & (window <= (off + reach_right - length)[:, None])
    block, i = np.nonzero(possible)
    if (possible & ~repeats).any():
        group = np.unique(gram, return_inverse=True)[1].astype(np.int64)
        place = group[block] * (length + 1) + off[block] - i
        wanted = np.unique(place[~repeats[block, i]])
        met = np.isin(place, wanted)
        block, i, place = block[met], i[met], place[met]
        h = hashes(block, i)
        order = np.lexsort((h, place))
        equal = (place[order][1:] == place[order][:-1]) & (h[order][1:] == h[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        repeats[block[twice], i[twice]] = True
    reach = np.zeros(len(n), np.int64)
    for end in by_right[[0, -1]]:
        own = np.flatnonzero(gram == gram[end])
        reach[own] = np.maximum(reach[own], _shared(rights, right_size, own, np.full(len(own), end)))
    return repeats, inside & (window <= (off + reach - length)[:, None]), hashes


def sorted_buckets(blocks: DataFrame, length: int, parts: int) -> DataFrame:
    """(gram, block, off, n, first, last, hash, times): runs of repeated windows of a block; and where the gram may go on in another bucket, with their hash,
    single windows: those that occur once here (times 1), and one each of the different ones that repeat here (times 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        rows = rows.combine_chunks()
        names = [rows.column(x).to_numpy() for x in BLOCK]
        keep = np.sort(np.unique(np.column_stack(names), axis=0, return_index=True)[1])
        rows, (gram, block, off, n) = rows.take(pa.array(keep)), (x[keep] for x in names)
        c, large = rows.column("c").to_numpy(), rows.column("large").to_numpy(zero_copy_only=False)
        repeats, edge_windows, hashes = bucket_repeats(gram, off.astype(np.int64), n.astype(np.int64), c, rows.column("right").combine_chunks(), rows.column("left").combine_chunks(), length)
        edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (at, first), (_, after) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        lone = c[at] == 1  # blocks that occur twice are known already
        at, first, last = at[lone], first[lone], after[lone] - 1
        yield _rows(gram, block, off, n, at, first, last, None, 0)
        window = edge_windows & large[:, None]
        for times, cells in ((1, window & ~repeats), (2, window & repeats)):
            at, i = np.nonzero(cells)
            h = hashes(at, i)
            if times == 2:
                different = np.unique(np.column_stack([gram[at], off[at] - i, h]), axis=0, return_index=True)[1]
                at, i, h = at[different], i[different], h[different]
            yield _rows(gram, block, off, n, at, i, i, h, times)

    schema = "gram long, block long, off int, n int, first int, last int, hash long, times int"
    more = (F.when(F.col("large"), F.col(c)) for c in ("right", "left"))
    return blocks.repartitionByRange(parts, F.substring("right", 1, gram_length(length)), *more).mapInArrow(run, schema)


def _rows(gram, block, off, n, at, first, last, hashes, times) -> pa.RecordBatch:
    columns = [gram[at], block[at], off[at].astype(np.int32), n[at].astype(np.int32), first.astype(np.int32), last.astype(np.int32)]
    own = pa.nulls(len(at), pa.int64()) if hashes is None else pa.array(hashes)
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), own, pa.array(np.full(len(at), times, np.int32))], [*BLOCK, "first", "last", "hash", "times"])


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """texts (key_a, key_b, text) -> (key_a, key_b, spans): the byte spans, some of which overlap, that hold every window found elsewhere; texts without any have no row."""
    found = stored(anchors(texts, length), "anchors")
    twice = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("c_")).where("c_ > 1").select("gram"), "repeated-grams")
    found = stored(found.join(twice, "gram", "left_semi"), "repeated-anchors")
    counted = found.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*KEYS, "lo")).alias("where_"))
    counted = stored(counted.select(*BLOCK, "c", "where_.*"), "blocks")
    several = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("v_")).where("v_ > 1").select("gram", (F.col("v_") > BUCKET_BLOCKS).alias("large"))
    blocks = stored(fetched(texts, counted.join(stored(several, "varied-grams"), "gram"), length), "suffixes")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // BUCKET_BLOCKS))
    out = stored(sorted_buckets(blocks, length, parts), "sorted-suffixes")
    edges = out.where("hash IS NOT NULL").withColumn("place", F.col("off") - F.col("first"))
    met = edges.groupBy("gram", "place", "hash").agg(F.sum("times").alias("t_")).where("t_ > 1")
    across = edges.where("times = 1").join(stored(met, "across-buckets"), ["gram", "place", "hash"], "left_semi").select(*BLOCK, "first", "last")
    whole = counted.where("c > 1").select(*BLOCK, F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    runs = stored(out.where("hash IS NULL").select(*BLOCK, "first", "last").unionByName(across).unionByName(whole), "repeated-windows")
    runs = stored(runs.groupBy(*BLOCK).agg(F.collect_set(F.struct("first", "last")).alias("runs")), "runs")
    spans = found.join(runs, BLOCK).select(*KEYS, F.transform("runs", lambda r: F.struct((F.col("lo") + r["first"]).alias("start"), (F.col("lo") + r["last"] + length).alias("end"))).alias("spans"))
    return spans.groupBy(*KEYS).agg(F.flatten(F.collect_set("spans")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and, in place of the text, kept (binary: the bytes that stay,
    joined; they may begin inside a character).  Columns of these names are replaced; the others stay, whatever their names."""
    rest = [c for c in docs.columns if c not in (*RESULTS, text)]
    # Work columns stand in a struct beside the rows, so no name of theirs can clash.
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(F.xxhash64(own).alias("key_a"), F.xxhash64(F.lit(7), own).alias("key_b"), own.alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("row"))
    spans = stored(repeated_spans(keyed.select(*KEYS, "text"), length), "spans")
    wide = keyed.join(spans, KEYS, "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for value, own in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = value.as_py().encode()
                gone = merged([(s["start"], s["end"]) for s in own or ()])
                edges = [0, *(x for span in gone for x in span), len(data)]
                sizes.append(len(data))
                removed.append(sum(e - s for s, e in gone))
                runs.append(len(gone))
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept, pa.binary())], ["row", *RESULTS])

    schema = StructType([wide.schema["row"], *(StructField(c, LongType()) for c in RESULTS[:3]), StructField(RESULTS[3], BinaryType())])
    return wide.mapInArrow(run, schema).select(*(F.col("row").getField(c).alias(c) for c in rest), *RESULTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
