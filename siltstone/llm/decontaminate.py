"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised (A-Z lower-cased, every run of signs and spaces one space).  Benchmark items are cut into overlapping
windows of two lengths: long ones, and short ones so dense that each verbatim passage of LEAST_PASSAGE bytes of an item
holds one of them whole, wherever in the item it begins.  A window of L bytes lies in a document within k edits only if some band of diagonals holds at least
(L + 1 - q) - k q of its q-grams.  Bands overlap so that each run of 2k + 1 diagonals lies in one whole.  Bands that reach
the bound are verified by banded alignment.

A benchmark of up to SLICE_BYTES is broadcast and met in one pass.  A larger one is cut into slices, and the texts still pass by only
once: a bitmap of its q-grams, without the commonest, tells which documents hold any; these are joined, by q-gram, with the slices whose bound
they may reach, and each meets only those, in groups of bounded bytes.

Defined results: null and empty texts match nothing; an item of fewer than q bytes after normalisation matches the documents whose
whole normalised text it is; repeated documents each get their rows; repeated items each match under their own id (null included);
of equally close places the first counts; ids of documents and items may be of any type that can be sorted; very long texts are searched whole; an empty table on either side gives an empty
result; columns beyond doc_id, text and item_id, text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm.textops import LOWER, Shared, bitmap, chunks, documents, in_bitmap, stored, text_buffers

Q = 8
WINDOW = 120
STEP = 60
SHORT_WINDOW = 64
SHORT_STEP = 12
#: Verbatim passages of so many normalised bytes (about 13 words) are found at every offset of an item.
LEAST_PASSAGE = SHORT_WINDOW + SHORT_STEP - 1
EDITS = 0.08
#: Bytes of benchmark text in one slice; a benchmark of one slice is broadcast.
SLICE_BYTES = 1 << 20
#: The commonest q-grams of a larger benchmark that windows are sought without, where their bound allows it.
COMMON = 1 << 14
#: Bits of the bitmap of all q-grams of a larger benchmark; when it fills up, more documents pass on to the exact join.
BITMAP_BITS = 27
#: Bytes of documents that meet one slice in one task, about.
GROUP_BYTES = 32 << 20
FILTER_BITS = 21
#: Pairs of a chunk's documents and windows are counted in a plain array up to so many cells, else by sorting.
DENSE_CELLS = 1 << 21
#: Bands that are verified together.
ALIGNED_AT_ONCE = 1 << 11
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _kept_table() -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        table[a:b] = True
    return table


KEPT = _kept_table()


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal bytes, document offsets among them, and the place of each in ``data``."""
    sign = ~KEPT[data]
    drop = sign.copy()
    drop[1:] &= sign[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    drop[starts] = sign[starts]
    at = np.flatnonzero(~drop)
    return np.where(sign[at], np.uint8(0x20), LOWER[data[at]]), np.searchsorted(at, offsets), at


def grams(b: np.ndarray) -> np.ndarray:
    """Each run of Q = 8 bytes as one number."""
    c = b.astype(np.uint64)
    for n in (1, 2, 4):
        if len(c) <= n:
            return np.zeros(0, np.uint64)
        c = (c[:-n] << np.uint64(8 * n)) | c[n:]
    return c


@dataclass
class Window:
    item: object
    start: int
    text: bytes
    edits: int
    bound: int


def windows_of(item: object, text: str | None, edits: float = EDITS) -> list[Window]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    b = normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")
    if len(b) < Q:
        return []
    spans = {(s, b[s : s + size]) for size, step in ((WINDOW, STEP), (SHORT_WINDOW, SHORT_STEP)) for s in (*range(0, max(1, len(b) - size + 1), step), max(0, len(b) - size))}
    out = []
    for s, own in sorted(spans):
        k = min(int(edits * len(own)), (len(own) - Q) // Q)
        out.append(Window(item, s, own, k, len(own) + 1 - Q - k * Q))
    return out


def short_of(item: object, text: str | None) -> list[tuple[bytes, object]]:
    """The whole normalised text of an item too short for a q-gram."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    b = normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")
    return [(b, item)] if 0 < len(b) < Q else []


class Index:
    """The q-grams of a slice of windows: sorted, with the windows and places of each."""

    def __init__(self, windows: list[Window], short: list[tuple[bytes, object]] = ()):
        # Items too short for a q-gram are looked up as whole texts.
        self.whole: dict[bytes, set] = {}
        for text, item in short:
            self.whole.setdefault(text, set()).add(item)
        self.windows = windows
        codes = [grams(np.frombuffer(w.text, np.uint8)) for w in windows]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.window = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order].astype(np.int32)
        self.place = (np.concatenate([np.arange(len(c)) for c in codes])[order] if codes else order).astype(np.int32)
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.first = np.append(self.first, len(code))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.cell(self.codes)] = True
        self.bound = np.array([w.bound for w in windows])
        self.band = np.array([2 * w.edits + 1 for w in windows])

    @staticmethod
    def cell(codes: np.ndarray) -> np.ndarray:
        return (codes * SPREAD) >> np.uint64(64 - FILTER_BITS)

    def regions(self, b: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, window, least diagonal) of each band that reaches its window's bound; diagonals count from the chunk's start."""
        code = grams(b)
        at = np.flatnonzero(self.filter[self.cell(code)]) if len(code) and len(self.codes) else np.zeros(0, np.int64)
        doc = np.searchsorted(offsets, at, "right") - 1
        at, doc = at[(inside := at + Q <= offsets[doc + 1])], doc[inside]
        found = np.searchsorted(self.codes, code[at])
        found = np.minimum(found, max(0, len(self.codes) - 1))
        at, doc, found = (x[self.codes[found] == code[at]] for x in (at, doc, found)) if len(at) else (at, doc, found)
        n = self.first[found + 1] - self.first[found] if len(at) else np.zeros(0, np.int64)
        entry = np.repeat(self.first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
        window = self.window[entry].astype(np.int64)
        hit_doc, diagonal = np.repeat(doc, n), np.repeat(at, n) - self.place[entry]
        pair = hit_doc * len(self.windows) + window
        cells = (len(offsets) - 1) * len(self.windows)
        if cells <= DENSE_CELLS:
            times = np.bincount(pair, minlength=cells)[pair]
        else:
            _, of, count = np.unique(pair, return_inverse=True, return_counts=True)
            times = count[of]
        enough = times >= self.bound[window]
        hit_doc, window, diagonal, pair = hit_doc[enough], window[enough], diagonal[enough], pair[enough]
        if not len(window):
            return
        band = (diagonal + WINDOW) // self.band[window]
        bands = int(band.max()) + 2
        key, count = np.unique(np.concatenate([pair * bands + band, pair * bands + band - 1]) + 1, return_counts=True)
        pair, band = np.divmod(key, bands)
        doc, window = np.divmod(pair, len(self.windows))
        full = count >= self.bound[window]
        for d, w, k in zip(doc[full].tolist(), window[full].tolist(), (band[full] - 1).tolist()):
            yield d, w, int(k * self.band[w] - WINDOW)


def aligned(pattern: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``pattern`` in ``text`` whose path stays on the diagonals low..high, if within ``most``."""
    exact = text.find(pattern, max(0, low))
    if 0 <= exact <= high:
        return 0, exact, exact + len(pattern)
    one = lambda x: np.array([x])
    _, cost, start, end = aligned_many(np.frombuffer(text, np.uint8), np.frombuffer(pattern, np.uint8)[None], one(low), high - low + 1, one(0), one(len(text)), most)
    return (int(cost[0]), int(start[0]), int(end[0])) if len(cost) else None


def aligned_many(b: np.ndarray, patterns: np.ndarray, low: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Which of the equally long patterns lie within ``most`` edits in their text b[lo:hi] on the ``width`` diagonals from ``low`` on, and the
    (edits, start, end) of the best place of each, all by places of ``b``.

    Row i of the table holds, for each pattern and diagonal d, the least edits of pattern[:i] against a text piece ending at i + d.
    """
    m = patterns.shape[1]
    far, lane, live = m + 1, np.arange(width), np.arange(len(patterns))
    # cost * 2**32 + (start counted from low): the least number has the least cost and the first start.
    unit = 1 << 32
    at = low[:, None] + np.arange(m + width)
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    text = np.full(at.shape, -1, np.int16)
    text[inside] = b[at[inside]]
    begun, ok = at >= lo[:, None], (at >= lo[:, None]) & (at <= hi[:, None])
    row = np.where(ok[:, :width], lane, far * unit)
    for i in range(1, m + 1):
        here = ok[:, i : i + width]
        same = text[:, i - 1 : i - 1 + width] == patterns[:, i - 1, None]
        new = np.where(begun[:, i - 1 : i - 1 + width], row + np.where(same, 0, unit), far * unit)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + unit)
        new = np.where(here, new, far * unit)
        row = np.minimum.accumulate(new - lane * unit, axis=1) + lane * unit
        row = np.where(here, row, far * unit)
        left = row.min(axis=1) < (most + 1) * unit
        if not left.all():
            live, low, row, text, begun, ok, patterns = (x[left] for x in (live, low, row, text, begun, ok, patterns))
            if not len(live):
                break
    if not len(live):
        return live, live, live, live
    best = row.argmin(axis=1)
    cost, start = np.divmod(row[np.arange(len(row)), best], unit)
    return live, cost, low + start, low + m + best


def found(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, object, int, int, int]]:
    """(document, item, edits, start byte, end byte) of every verified window of a chunk, the best band of each."""
    b, at_doc, place = normalised(data, offsets)
    for d in np.flatnonzero(np.diff(at_doc) < Q + 2) if index.whole else ():
        text = b[at_doc[d] : at_doc[d + 1]].tobytes()
        bare = text.strip(b" ")
        for item in index.whole.get(bare, ()):
            s = int(at_doc[d]) + len(text) - len(text.lstrip(b" "))
            yield int(d), item, 0, int(place[s] - offsets[d]), int(place[s + len(bare) - 1] + 1 - offsets[d])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    open_: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}

    def take(d: int, w: int, hit: tuple[int, int, int]) -> None:
        if hit < best.get((d, w), (len(index.windows[w].text) + 1, 0, 0)):
            best[d, w] = hit

    def verify(rows: list[tuple[int, int, int, int, int]]) -> None:
        d, w, low, lo, hi = (np.array(x) for x in zip(*rows))
        own = index.windows[rows[0][1]]
        patterns = np.frombuffer(b"".join(index.windows[x].text for x in w.tolist()), np.uint8).reshape(len(rows), -1)
        k, *hits = aligned_many(b, patterns, low, 2 * (2 * own.edits + 1) + 2 * own.edits, lo, hi, own.edits)
        for x, y, *hit in zip(d[k].tolist(), w[k].tolist(), *(x.tolist() for x in hits)):
            take(x, y, tuple(hit))

    for d, w, diagonal in index.regions(b, at_doc):
        # Bands come in order, so a window found without edits has its first such place.
        if best.get((d, w), (1,))[0] == 0:
            continue
        own = index.windows[w]
        width = 2 * int(index.band[w])
        low, high = diagonal - own.edits, diagonal + width - 1 + own.edits
        start = max(int(at_doc[d]), low)
        stop = min(int(at_doc[d + 1]), diagonal + width + len(own.text) + own.edits)
        exact = b[start:stop].tobytes().find(own.text)
        if 0 <= exact <= high - start:
            take(d, w, (0, start + exact, start + exact + len(own.text)))
            continue
        rows = open_.setdefault((len(own.text), own.edits), [])
        rows.append((d, w, low, start, stop))
        if len(rows) >= ALIGNED_AT_ONCE:
            verify(rows)
            rows.clear()
    for rows in open_.values():
        if rows:
            verify(rows)
    for (d, w), (edits, s, e) in best.items():
        yield d, index.windows[w].item, edits, int(place[s] - offsets[d]), int(place[e - 1] + 1 - offsets[d])


NAMES = ["item_id", "n_windows", "edits", "char_start", "char_end"]


def _index(items: list[tuple[object, str]], edits: float) -> Index:
    items = sorted(items, key=lambda x: (True, x[1]) if x[0] is None else (False, x[0], x[1]))
    return Index([w for i, t in items for w in windows_of(i, t, edits)], [x for i, t in items for x in short_of(i, t)])


def contaminated(docs: DataFrame, benchmark: DataFrame, *keep: str, edits: float = EDITS, slice_bytes: int = SLICE_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, the columns ``keep``, item_id, n_windows (of the item, found), edits (of the
    closest window), and the span of code points from the first to the last window found."""
    types = dict(docs.dtypes)
    names = list(dict.fromkeys(["doc_id", *keep]))
    kept = [f"k{i}_" for i in range(len(names))]
    own = docs.select(*(F.col(c).alias(k) for c, k in zip(names, kept)), "text")
    schema = ", ".join([*(f"{k} {types[c]}" for c, k in zip(names, kept)), f"item_id {dict(benchmark.dtypes)['item_id']}", *(f"{c} long" for c in NAMES[1:])])
    items = benchmark.where(F.length("text") > 0).select("item_id", "text")
    kind = to_arrow_type(items.schema["item_id"].dataType)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= slice_bytes:
        shared = Shared(docs.sparkSession, _index([(r["item_id"], r["text"]) for r in items.collect()], edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _hits(shared.value, batch, kept, kind)

        out = own.mapInArrow(run, schema)
    else:
        out = _routed(own, items, kept, schema, edits, -(-total // slice_bytes), group_bytes, kind)
    return out.select(*(F.col(k).alias(c) for c, k in zip(names, kept)), *NAMES)


def _hits(index: Index, batch: pa.RecordBatch | pa.Table, kept: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """One row per text of the batch and item found in it."""
    data, offsets = text_buffers(batch.column("text"))
    rows: dict[tuple[int, object], list[tuple[int, int, int]]] = {}
    for i, _, b, o in chunks(data, offsets):
        for d, item, cost, s, e in found(index, b, o):
            rows.setdefault((i + d, item), []).append((cost, s, e))
    out: list[list] = [[], [], [], [], [], []]
    for (d, item), hits in rows.items():
        text = data[offsets[d] : offsets[d + 1]]
        point = [int(((text[:x] & 0xC0) != 0x80).sum()) for x in (min(h[1] for h in hits), max(h[2] for h in hits))]
        for column, v in zip(out, (d, item, len(hits), min(h[0] for h in hits), *point)):
            column.append(v)
    at = pa.array(out[0], pa.int64())
    columns = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).take(at) for c in (batch.column(k) for k in kept)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(out[1], kind), *(pa.array(c, pa.int64()) for c in out[2:])], [*kept, *NAMES])


def _marks(item: object, text: str, edits: float, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The q-grams by which an item's windows are sought (of a short item a number for the whole), and the least number of them a match must hold.

    Each edit destroys at most Q places, so a match shares all but k Q of a window's different q-grams.  Of those that it must share, half may be left out: a window is sought
    without its commonest q-grams (``common``: codes, the commonest first), and with a bound that is less by as many.  So a q-gram that is in every text is no key."""
    rank = {c: i for i, c in enumerate(common.tolist())}
    codes = []
    for w in windows_of(item, text, edits):
        own = np.unique(grams(np.frombuffer(w.text, np.uint8)))
        shared = max(1, len(own) - w.edits * Q)
        known = sorted((c for c in own.tolist() if c in rank), key=rank.__getitem__)[: shared // 2]
        codes.append((np.setdiff1d(own, np.array(known, np.uint64)), max(1, shared - len(known))))
    codes += [(np.array([_short(b)]), 1) for b, _ in short_of(item, text)]
    return np.unique(np.concatenate([c for c, _ in codes])) if codes else np.zeros(0, np.uint64), min((n for _, n in codes), default=1)


def _short(text: bytes) -> np.uint64:
    """A number for a text of fewer than Q bytes; no q-gram has a zero first byte."""
    return np.uint64(int.from_bytes(text, "big"))


def _routed(docs: DataFrame, items: DataFrame, kept: list[str], schema: str, edits: float, n_slices: int, group_bytes: int, kind: pa.DataType) -> DataFrame:
    spark = docs.sparkSession
    items = stored(items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)).cast("int")), "items")

    def marks(common: Shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for slice_, item, text in zip(*(batch.column(c).to_pylist() for c in ("slice", "item_id", "text"))):
                    codes, least = _marks(item, text, edits, common.value)
                    n = len(codes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, slice_, np.int32)), pa.array(codes.view(np.int64)), pa.array(np.full(n, least, np.int32))], ["slice", "code", "least"])

        return items.mapInArrow(run, "slice int, code long, least int")

    # How many items hold each q-gram; the driver gets COMMON of them.
    held = marks(Shared(spark, np.zeros(0, np.uint64))).groupBy("code").count().where("count > 1").orderBy(F.desc("count"), "code").limit(COMMON)
    common = np.array([r["code"] for r in held.collect()], np.int64).view(np.uint64)
    known = stored(marks(Shared(spark, common)).groupBy("slice", "code").agg(F.min("least").alias("least")), "q-grams")
    least = stored(known.groupBy("slice").agg(F.min("least").alias("least")), "bounds")
    shared = Shared(spark, bitmap(known, "code", BITMAP_BITS))
    types = dict(docs.dtypes)
    own_schema = ", ".join([*(f"{k} {types[k]}" for k in kept), "text string, codes array<long>"])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            at, codes = [], []
            for i, j, b, o in chunks(data, offsets):
                norm, first, _ = normalised(b, o)
                for d in range(j - i):
                    text = norm[first[d] : first[d + 1]]
                    code = grams(text)
                    bare = text.tobytes().strip(b" ")
                    code = np.append(np.unique(code), _short(bare)) if 0 < len(bare) < Q else np.unique(code)
                    code = code[in_bitmap(shared.value, code, BITMAP_BITS)]
                    if len(code):
                        at.append(i + d)
                        codes.append(code.view(np.int64))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (*kept, "text")), pa.array(codes, pa.list_(pa.int64()))], [*kept, "text", "codes"])

    rows = docs.mapInArrow(screen, own_schema)
    # A row is named by its place in the stored table, as ids may repeat.
    rows = stored(rows.withColumn("row_", F.monotonically_increasing_id()), "screened")
    common = rows.select("row_", F.explode("codes").alias("code")).join(known.select("slice", "code"), "code").groupBy("row_", "slice").agg(F.count(F.lit(1)).alias("n"))
    pairs = common.join(least, "slice").where("n >= least").select("row_", "slice")
    met = stored(rows.drop("codes").join(pairs, "row_"), "routed")
    size = met.groupBy("slice").agg(F.ceil(F.sum(F.octet_length("text")) / group_bytes).cast("int").alias("parts"))
    size = stored(size, "groups")
    left = met.join(size, "slice").withColumn("part", F.pmod(F.xxhash64("row_"), F.col("parts")).cast("int")).drop("parts", "row_")
    right = items.join(size, "slice").select("slice", "item_id", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def search(texts: pa.Table, own: pa.Table) -> pa.Table:
        index = _index(list(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist())), edits)
        return pa.Table.from_batches([_hits(index, texts, kept, kind)])

    return left.groupBy("slice", "part").cogroup(right.groupBy("slice", "part")).applyInArrow(search, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
