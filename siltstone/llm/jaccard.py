"""N-gram Jaccard join by prefix trees.

A text is the set of its k-word shingles (64-bit hashes).  Equal sets form a class; classes link when
their Jaccard similarity reaches ``num / den``.  Only classes that share a shingle in their prefixes (the first
n - ceil(t n) + 1 shingles in one global order: rare ones before frequent ones, then by hash) can link.  Such classes
meet in blocks: the least class that holds the shared shingle, the lead, and the others.  In a block the sets are stored in
a trie, ordered from common to rare, so that near copies share their paths; each set descends it with the overlap counted so
far, and subtrees are pruned that can't reach the overlap that their sizes need, or that are connected already.

Before sets are fetched, blocks are screened by sketches of about one bit per shingle: bits that differ are at most the
shingles that differ, so sets whose sketches are too far apart can't link.  Sets that are left without a partner drop
out, and only the others' sets travel.

A lead whose block would grow beyond ``BLOCK`` sets or ``BLOCK_SHINGLES`` is split into blocks that each hold the lead.  If
that leaves more than one component, the pairs that these blocks kept apart are decided exactly: what isn't linked to the
lead meets block by block, and what is nearly linked to it meets the lead's own (by the triangle inequality of the Jaccard
distance nothing else can link to those).

Counts are exact and only order the search.  Broadcasts are bounded: at most MAX_HOT frequent shingles and a bitmap of
at most 2**MAX_BITMAP bits, which only lets more rows pass when it is full.

Defined results: null, empty and wordless texts have an empty set and link with nothing; equal rows form one class; a
null id never names a component unless all ids of it are null; ties (similarity exactly at the bound) link; very long texts count
whole, as one set, in one task's memory; an empty table gives an empty result; ids may be of any type; columns beyond doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.textops import LOWER, Shared, bitmap, chunks, in_bitmap, mix, prepared, shingle_hashes, spans_hash, stored, text_buffers, words

#: A shingle in the prefixes of more documents than this comes late in the global order.
HOT = 32
MAX_HOT = 1 << 20
BLOCK = 3000
BLOCK_SHINGLES = 4_000_000
BUCKET_ROWS = 400
SKETCH_ROWS = 4000
SKETCH_BITS = (64, 1 << 14)
MAX_BITMAP = 27


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document of a chunk, ascending, and where each document's begin."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h, doc = shingle_hashes(spans_hash(data, starts, ends), first, k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def classes_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        total = np.add.reduceat(mix(h ^ np.uint64(0x5E75)), first[:-1][full])
        out[full] = mix(total + n[full].astype(np.uint64)) | np.uint64(1)
    return out


def needed(a, b, num: int, den: int):
    """Least overlap of linked sets of sizes a and b: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def _first_of(h: np.ndarray, first: np.ndarray, length: np.ndarray, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first ``length`` hashes of each set, those marked late after the others; and where each document's begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if late is not None and late.any():
        order = np.lexsort((h, late, doc))
        h = h[order]
    rank = np.arange(len(h)) - first[:-1][doc]
    return h[rank < length[doc]], np.concatenate([[0], np.cumsum(np.minimum(length, np.diff(first)))])


def sketch(h: np.ndarray) -> bytes:
    """Parity bits of a set, about as many as it has members.  Folding the halves of a sketch together gives the next smaller one."""
    low, high = SKETCH_BITS
    bits = min(high, max(low, 1 << max(len(h) - 1, 0).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(s: np.ndarray, size: int) -> np.ndarray:
    while len(s) > size:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


class Marked:
    """Membership in a sorted array, behind a small bitmap."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        self.map = np.zeros(1 << 22, bool)
        self.map[self.cell(values)] = True

    @staticmethod
    def cell(values: np.ndarray) -> np.ndarray:
        return values >> np.uint64(42)

    def __contains__(self, value: int) -> bool:
        return bool(self.test(np.array([value], np.uint64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        out = self.map[self.cell(h)]
        if len(self.values):
            at = np.flatnonzero(out)
            found = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
            out[at] = self.values[found] == h[at]
        return out


def _early(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(h, n): how many documents have shingle h among the first 2 * prefix of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for _, _, b, o in chunks(data, offsets):
                h, first = sets_of(b, o, k)
                own = _first_of(h, first, 2 * prefix_length(np.diff(first), num, den))[0]
                value, count = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": pa.array(value.view(np.int64)), "n": pa.array(count.astype(np.int64))})

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, k: int, num: int, den: int, hot: int = HOT, most: int = MAX_HOT) -> np.ndarray:
    """The shingles that come late in the global order: those of more than ``hot`` documents, or of more, so that at most ``most`` are held."""
    common = stored(_early(docs, k, num, den).where(F.col("n") > hot), "common")
    while common.where(F.col("n") > hot).count() > most:
        hot *= 2
    table = common.where(F.col("n") > hot).select("h").toArrow()
    return table.column("h").to_numpy().astype(np.int64).view(np.uint64)


def summaries(docs: DataFrame, late: np.ndarray, k: int, num: int, den: int, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, n (size of the set), cls (its name) and prefix of each document."""
    shared = Shared(docs.sparkSession, late)
    types = dict(docs.dtypes)
    names = list(dict.fromkeys(["doc_id", *keep]))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "n long, cls long, prefix array<long>, sketch binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = Marked(shared.value)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j, b, o in chunks(data, offsets):
                h, first = sets_of(b, o, k)
                n = np.diff(first)
                own, at = _first_of(h, first, np.where(n > 0, prefix_length(n, num, den), 0), marked.test(h))
                prefix = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own.view(np.int64)))
                sketches = pa.array([sketch(h[s:e]) if e > s else b"" for s, e in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), pa.array(n.astype(np.int64)), pa.array(classes_of(h, first).view(np.int64)), prefix, sketches], [*names, "n", "cls", "prefix", "sketch"])

    return docs.select(*names, "text").mapInArrow(run, schema)


def chosen_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, n, members): the sets of the classes in ``wanted`` (doc_id of one document, cls); a null id stands for any."""
    spark = docs.sparkSession
    count = wanted.count()
    bits = min(MAX_BITMAP, max(10, int(count * 16).bit_length()))
    shared = Shared(spark, bitmap(wanted.select(F.xxhash64("doc_id").alias("id_")), "id_", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick = np.flatnonzero(in_bitmap(shared.value, batch.column("id_").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits))
            data, offsets = text_buffers(batch.column("text").take(pa.array(pick)))
            for _, _, b, o in chunks(data, offsets):
                h, first = sets_of(b, o, k)
                members = [h[s:e].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(classes_of(h, first).view(np.int64)), pa.array(np.diff(first)), pa.array(members, pa.binary())], ["cls", "n", "members"])

    found = docs.select(F.xxhash64("doc_id").alias("id_"), "text").mapInArrow(run, "cls long, n long, members binary")
    return found.join(wanted.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])


class Trie:
    """Sets as paths of ranks, common ones first; equal beginnings are stored once, and runs without a fork are one node."""

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].tolist())
        self.sizes = sizes[self.order]
        self.paths = [paths[i] for i in self.order]
        self.nodes: list[tuple[np.ndarray, int, int, list[int], int, int, int]] = []
        self.roots = self._built(0, len(paths), 0)

    def _built(self, a: int, b: int, depth: int) -> list[int]:
        """Nodes of the sets a..b, which share their first ``depth`` ranks.  A node: ranks, first and last set, children, longest rest below, least and greatest size."""
        out, todo = [], [(a, b, depth, None)]
        while todo:
            a, b, depth, parent = todo.pop()
            while a < b and len(self.paths[a]) == depth:  # ends at the parent
                a += 1
            while a < b:
                end = a + 1
                while end < b and self.paths[end][depth] == self.paths[a][depth]:
                    end += 1
                low, high = self.paths[a], self.paths[end - 1]
                n = min(len(low), len(high))
                apart = np.flatnonzero(low[depth:n] != high[depth:n])
                to = depth + int(apart[0]) if len(apart) else n
                rest = max(len(p) for p in self.paths[a:end]) - to
                index = len(self.nodes)
                self.nodes.append((low[depth:to], a, end, [], rest, int(self.sizes[a:end].min()), int(self.sizes[a:end].max())))
                (out if parent is None else self.nodes[parent][3]).append(index)
                todo.append((a, end, to, index))
                a = end
        return out

    def overlaps(self, flags: np.ndarray) -> np.ndarray:
        """How many ranks each set, in trie order, has in common with the probe; sets that begin alike share the count."""
        out = np.zeros(len(self.paths), np.int64)
        todo = [(i, 0) for i in self.roots]
        while todo:
            index, overlap = todo.pop()
            ranks, a, b, children, *_ = self.nodes[index]
            overlap += int(flags[ranks].sum())
            out[a : self.nodes[children[0]][1] if children else b] = overlap
            todo += [(c, overlap) for c in children]
        return out

    def near(self, flags: np.ndarray, behind: np.ndarray, size: int, num: int, den: int, open_: np.ndarray) -> Iterator[int]:
        """Sets among ``open_`` that link with the probe: flags[r] tells whether it has rank r, behind[r] how many of its ranks are r or later.  open_ may be cleared meanwhile."""
        todo = [(i, 0) for i in reversed(self.roots)]
        while todo:
            index, overlap = todo.pop()
            ranks, a, b, children, rest, least, most = self.nodes[index]
            if not open_[a:b].any() or den * most < num * size or den * size < num * least:
                continue
            if len(ranks):
                overlap += int(flags[ranks].sum())
                left = int(behind[ranks[-1] + 1])
            else:
                left = int(behind[0])
            if overlap + min(rest, left) < needed(size, least, num, den):
                continue
            i = a
            inner = self.nodes[children[0]][1] if children else b
            while i < inner:  # sets that end here
                if open_[i] and overlap >= needed(size, int(self.sizes[i]), num, den):
                    yield i
                i += 1
            todo += [(c, overlap) for c in reversed(children)]


def _trie(sets: list[np.ndarray]) -> tuple[Trie, list[np.ndarray], int]:
    """The trie of the sets, the path of each, and the number of ranks; what only one set has can't be common and is left out."""
    value, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((value, -count))
    rank = np.empty(len(value), np.int64)
    rank[order] = np.arange(len(value))
    shared = int((count > 1).sum())
    sizes = np.array([len(s) for s in sets])
    paths = [np.sort(r[r < shared]) for r in np.split(rank[of], np.cumsum(sizes)[:-1])]
    return Trie(paths, sizes), paths, shared


def joined(names: list[int], sets: list[np.ndarray], num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect what is connected among the sets, the first set's own first; and the overlap of each set with the first."""
    sizes = np.array([len(s) for s in sets])
    trie, paths, shared = _trie(sets)
    where = {i: at for at, i in enumerate(trie.order)}
    root = np.arange(len(sets))  # component of each set, in trie order
    done = np.zeros(len(sets), bool)
    links = []

    def probe(i: int) -> np.ndarray:
        flags = np.zeros(shared + 1, bool)
        flags[paths[i]] = True
        return flags

    for i in range(len(sets)):
        me = where[i]
        done[me] = True
        if len(paths[i]) < needed(sizes[i], 0, num, den) or (root == root[me]).all():
            continue
        flags = probe(i)
        behind = np.zeros(shared + 2, np.int64)
        behind[: shared + 1] = np.cumsum(flags[::-1])[::-1]
        open_ = (root != root[me]) & ~done
        for at in trie.near(flags, behind, int(sizes[i]), num, den, open_):
            if open_[at]:
                links.append((names[i], names[trie.order[at]]))
                root[root == root[at]] = root[me]
                open_ &= root != root[me]
    common = np.empty(len(sets), np.int64)
    common[trie.order] = trie.overlaps(probe(0))
    return links, common


def screened(n: np.ndarray, sketches: list[bytes], wide: bool, num: int, den: int) -> np.ndarray:
    """Part of each set of a block, by sketches that are near enough to link; -1 for sets without a partner.  In a wide block what
    is within twice the distance of the first set shares its part too."""
    m = len(n)
    raw = [np.frombuffer(s, np.uint8) for s in sketches]
    part = np.arange(m)
    alone = np.ones(m, bool)
    by_size = {size: (at := [i for i in range(m) if len(raw[i]) >= size], np.stack([folded(raw[i], size) for i in at])) for size in sorted({len(r) for r in raw})}
    for i in range(m):
        at, rows = by_size[len(raw[i])]
        own = np.array(at)
        apart = np.bitwise_count(rows ^ raw[i]).sum(axis=1, dtype=np.int64)
        total = n[own] + n[i]
        near = (apart <= total - 2 * needed(n[own], n[i], num, den)) & (np.minimum(n[own], n[i]) * den >= np.maximum(n[own], n[i]) * num)
        if wide:
            near |= ((own == 0) | (i == 0)) & (apart <= total - 2 * needed(n[own], n[i], 2 * num - den, den))
        near &= own != i
        if near.any():
            alone[own[near]] = False
            alone[i] = False
            for k in np.unique(part[own[near]]).tolist():
                part[part == k] = part[i]
    part[alone] = -1
    return part


PARTS = "lead long, sub int, part int, cls long, first boolean, wide boolean"


def _parts(members: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Screens blocks: members (lead, sub, cls, first, wide), classes (cls, n, sketch).  Leaves the sets with a possible partner, and their part of the block."""
    buckets = max(1, members.count() // SKETCH_ROWS)
    rows = members.join(classes.select("cls", "n", "sketch"), "cls")
    rows = rows.withColumn("bucket_", F.pmod(F.xxhash64("lead", "sub"), F.lit(buckets)).cast("int"))
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        blocks: dict[tuple[int, int], list[tuple]] = {}
        for lead, sub, *x in zip(*(table.column(c).to_pylist() for c in ("lead", "sub", "first", "cls", "wide", "n", "sketch"))):
            blocks.setdefault((lead, sub), []).append((not x[0], *x[1:]))
        out: list[tuple] = []
        for (lead, sub), own in sorted(blocks.items()):
            if len(own) < 2:
                continue
            own.sort(key=lambda x: x[:2])
            part = screened(np.array([x[3] for x in own]), [x[4] for x in own], own[0][2], num, den)
            out += [(lead, sub, int(p), x[1], not x[0], x[2]) for p, x in zip(part, own) if p >= 0]
        columns = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()))], names)

    return stored(rows.groupBy("bucket_").applyInArrow(run, PARTS), "parts")


OUT = "lead long, a long, b long, overlap long, link boolean"


def _blocks(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """members (lead, sub, part, cls, first, wide): joins each part and returns its links; of wide ones also each set's overlap with the first."""
    buckets = max(1, members.count() // BUCKET_ROWS)
    rows = members.join(sets.select("cls", "members"), "cls")
    rows = rows.withColumn("bucket_", F.pmod(F.xxhash64("lead", "sub", "part"), F.lit(buckets)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        blocks: dict[tuple[int, int, int], list[tuple[bool, int, np.ndarray, bool]]] = {}
        for lead, sub, part, cls, first, wide, m in zip(*(table.column(c).to_pylist() for c in ("lead", "sub", "part", "cls", "first", "wide", "members"))):
            blocks.setdefault((lead, sub, part), []).append((not first, cls, np.frombuffer(m, np.uint64), wide))
        out: list[tuple] = []
        for (lead, _, _), own in sorted(blocks.items()):
            own.sort(key=lambda x: x[:2])
            names, sets_ = [x[1] for x in own], [x[2] for x in own]
            if len(own) < 2:
                continue
            found, overlap = joined(names, sets_, num, den)
            out += [(lead, a, b, None, True) for a, b in found]
            if own[0][3] and own[0][1] == lead:
                out += [(lead, lead, name, int(c), int(c) >= needed(len(sets_[0]), len(s), num, den)) for name, s, c in zip(names[1:], sets_[1:], overlap[1:])]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], [x.split()[0] for x in OUT.split(", ")])

    return stored(rows.groupBy("bucket_").applyInArrow(run, OUT), "block-links")


class Sets:
    """Sets of classes, fetched once each."""

    def __init__(self, fetch):
        self.fetch, self.held = fetch, None

    def of(self, wanted: DataFrame) -> DataFrame:
        if self.held is None:
            self.held = stored(self.fetch(wanted), "sets")
            return self.held
        more = stored(wanted.join(self.held.select("cls"), "cls", "left_anti"), "wanted")
        if more.head(1):
            self.held = self.held.unionByName(stored(self.fetch(more), "sets"))
        return self.held


def _joined_blocks(members: DataFrame, classes: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """Screens the blocks, fetches what is left, joins it."""
    left = _parts(members, classes, num, den)
    return _blocks(left, sets.of(left.select("cls").distinct()), num, den)


def _parted(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """rows (lead, cls, n): the part of each, and the number of parts of each lead, by sets and by shingles."""
    size = F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)
    parts = stored(rows.groupBy("lead").agg(F.ceil(size).cast("int").alias("parts")), "block-counts")
    return rows.join(parts, "lead").select("lead", "cls", "parts", F.pmod(F.xxhash64("cls", "lead"), F.col("parts")).cast("int").alias("part")), parts


def links(tokens: DataFrame, classes: DataFrame, fetch, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """tokens (h, cls): prefixes; classes (cls, n, sketch); fetch: frame of cls -> frame (cls, members).  Returns links (a, b) whose components are those of all links."""
    sets, size = Sets(fetch), classes.select("cls", "n")
    own = tokens.join(stored(tokens.groupBy("h").agg(F.min("cls").alias("lead")), "leads"), "h").where(F.col("cls") != F.col("lead"))
    pairs = stored(own.select("lead", "cls").distinct().join(size, "cls"), "pairs")
    dealt, parts = _parted(pairs, block)
    wide = F.col("parts") > 1
    others = dealt.select("lead", F.col("part").alias("sub"), "cls", F.lit(False).alias("first"), wide.alias("wide"))
    leads = parts.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"), F.col("lead").alias("cls"), F.lit(True).alias("first"), wide.alias("wide"))
    out = _joined_blocks(others.unionByName(leads), classes, sets, num, den)
    found = out.where("link").select("a", "b")
    split = parts.where("parts > 1").select("lead")
    if not split.head(1):
        return found
    # A split lead is settled with all others.  Of those not linked to it, pairs in different blocks are still open.
    com = stored(components(found), "components")
    component = lambda rows, c, name: rows.join(com.select(F.col("node").alias(c), F.col("component").alias("c_")), c, "left").withColumn(name, F.coalesce("c_", c)).drop("c_")
    seen = out.where(F.col("overlap").isNotNull()).select("lead", F.col("b").alias("cls"), "overlap", "link")
    members = pairs.join(split, "lead", "left_semi").join(seen, ["lead", "cls"], "left").join(size.select(F.col("cls").alias("lead"), F.col("n").alias("lead_n")), "lead")
    members = component(component(members.withColumn("link", F.coalesce("link", F.lit(False))), "cls", "own"), "lead", "its")
    members = stored(members, "split")
    open_ = members.where(F.col("own") != F.col("its")).select("lead").distinct()
    members = members.join(open_, "lead", "left_semi")
    if not members.head(1):
        return found
    rest = members.where(~F.col("link"))
    more = _joined_blocks(_squared(rest, block), classes, sets, num, den)
    found = found.unionByName(more.where("link").select("a", "b"))
    # Within twice the distance of a link from the lead, and not connected with it: these may link to the lead's own.
    close = rest.where((F.col("own") != F.col("its")) & (F.col("overlap") * den >= (2 * num - den) * (F.col("n") + F.col("lead_n") - F.col("overlap"))))
    more = _joined_blocks(_crossed(close, members.where("link"), block), classes, sets, num, den)
    return found.unionByName(more.where("link").select("a", "b"))


def _every(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _squared(rows: DataFrame, block: int) -> DataFrame:
    """Blocks in which every part of a lead's rows meets every part, itself included."""
    dealt, _ = _parted(rows, max(1, block // 2))
    each = dealt.select("lead", "cls", "parts", "part", _every("parts").alias("to"))
    low, high = F.least("part", "to"), F.greatest("part", "to")
    return each.select("lead", (low * F.col("parts") + high).alias("sub"), "cls", F.lit(False).alias("first"), F.lit(False).alias("wide"))


def _crossed(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """Blocks in which every part of a lead's left rows meets every part of its right ones."""
    (one, l), (two, r) = (_parted(x, max(1, block // 2)) for x in (left, right))
    both = l.withColumnRenamed("parts", "l").join(r.withColumnRenamed("parts", "r"), "lead")
    first = one.join(both, "lead").select("lead", "cls", "part", "r", _every("r").alias("to")).select("lead", (F.col("part") * F.col("r") + F.col("to")).alias("sub"), "cls")
    second = two.join(both, "lead").select("lead", "cls", "part", "r", _every("l").alias("to")).select("lead", (F.col("to") * F.col("r") + F.col("part")).alias("sub"), "cls")
    return first.unionByName(second).select("lead", "sub", "cls", F.lit(False).alias("first"), F.lit(False).alias("wide"))


def clustered(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, *keep: str, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, the columns ``keep``, n_shingles, component_id (least id of the documents reachable
    by links) and component (a name of the component that null ids don't share; null for the empty set)."""
    late = frequent(docs, k, num, den, hot)
    own = stored(summaries(docs, late, k, num, den, *keep), "prefixes")
    # One document speaks for its class.  What is joined on a key that may be hot is stored first, so that Spark can split the hot side.
    full = own.where(F.col("n") > 0)
    reps = stored(full.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "classes")
    least = reps.select("cls", "doc_id")
    spread = reps.select(F.explode("prefix").alias("h"), "cls")
    shared = stored(spread.groupBy("h").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where(F.col("x") != F.col("y")).select("h"), "shared")
    tokens = stored(spread.join(shared, "h", "left_semi"), "shared-prefixes")
    classes = stored(reps.select("cls", "n", "sketch").join(tokens.select("cls").distinct(), "cls", "left_semi"), "sketches")

    def fetch(wanted: DataFrame) -> DataFrame:
        return chosen_sets(docs, stored(least.join(wanted, "cls", "left_semi"), "wanted"), k)

    com = stored(components(links(tokens, classes, fetch, num, den, block)), "components")
    named = com.join(least.withColumnRenamed("cls", "node"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = com.join(named, "component").select(F.col("node").alias("cls"), "component_id", "component")
    whole = least.select("cls", F.col("doc_id").alias("least_id")).join(of, "cls", "left").select("cls", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("component", "cls").alias("component"))
    whole = stored(whole, "component-names")
    names = list(dict.fromkeys(["doc_id", *keep]))
    rows = own.select(*names, "n", "cls").join(whole, "cls", "left")
    least_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select(*names, F.col("n").alias("n_shingles"), least_id.alias("component_id"), "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
