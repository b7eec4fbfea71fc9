"""Vectorised text primitives over Arrow string buffers, and small Spark helpers shared by the operators.

Texts are handled as one byte array with document offsets, in chunks of bounded size, so memory does not
depend on the number of rows in an Arrow batch.  A chunk always holds whole documents.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.scratch import scratch as scratch
from siltstone.scratch import stored as stored
from siltstone.session import spread

CHUNK_BYTES = 1 << 20
#: Rows in one Arrow batch of texts, at most.  Off-heap buffers grow with it.
ARROW_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def _space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


SPACE = _space_table()
LOWER = _lower_table()
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "pow" not in _POWERS or len(_POWERS["pow"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["pow"][:n], _POWERS["inv"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of whole documents, of at most ``limit`` bytes unless one document is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    _trim()


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def prepared(spark: SparkSession) -> SparkSession:
    """The session, sending Arrow batches of at most ARROW_ROWS rows.  Called by registered queries and stages, not by operators."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents (doc_id, text, and ``columns``), in as many tasks as there are cores at least.  For registered queries."""
    return spread(prepared(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns))


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Shared:
    """A broadcast value.  It travels as bytes that hold its classes too, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "held": None}

    @property
    def value(self):
        if self.held is None:
            self.held = pickle.loads(self.sent.value)
        return self.held

    def release(self) -> None:
        self.sent.unpersist()


def pieces(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within documents: starts, ends, and the index of each document's first run (length n + 1)."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = is_word[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    starts = np.flatnonzero(is_word & (~before | cut[:-1]))
    ends = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pieces(~SPACE[data], offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """Document index of each run, from the index of each document's first run."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the document of each; a document of 1 to k - 1 words gives one hash of them all."""
    count = np.diff(first)
    total = np.zeros(max(len(word_hash) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        total += word_hash[j : j + len(total)] * MULTIPLIERS[j]
    doc = owners(first)[: len(total)]
    whole = np.arange(len(total)) + k <= first[1:][doc]
    out, at = mix(total[whole]), doc[whole]
    for d in np.flatnonzero((count > 0) & (count < k)):
        own = word_hash[first[d] : first[d + 1]]
        short = mix((own * MULTIPLIERS[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
        out, at = np.append(out, short), np.append(at, d)
    return out, at


def fold_of(column: str = "doc_id", modulus: int = 5):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def numbered(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """``rows``, stored, with copy_: how many rows of the same key (a long) come before each, from 0.

    Rows of one key are counted within each stored part and shifted by the parts before, so a key that holds a third of all rows
    spreads over as many tasks as it had parts.
    """
    own = stored(rows.withColumn("key_", key).withColumn("part_", F.spark_partition_id()), name)
    counts = own.groupBy("key_", "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(W.partitionBy("key_").orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    shifts = counts.select("key_", "part_", before.alias("shift_")).where("shift_ > 0")
    place = F.row_number().over(W.partitionBy("key_", "part_").orderBy(F.lit(0))) - 1
    wide = own.withColumn("place_", place).join(shifts, ["key_", "part_"], "left")
    return wide.withColumn("copy_", (F.col("place_") + F.coalesce("shift_", F.lit(0))).cast("long")).drop("key_", "part_", "place_", "shift_")


#: Blocks are added up in so many groups of tasks, then over the groups.
SENDER_GROUPS = 256


def added_up(blocks: DataFrame, dtype: str = "float64") -> dict[int, np.ndarray]:
    """Adds equally long binary blocks by ``part``: frame (part int, block binary) -> {part: sum}, in two levels, so that no task holds the blocks of all tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for block in table.column("block"):
            value = np.frombuffer(block.as_py(), dtype)
            total = value.copy() if total is None else np.add(total, value, out=total)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, block binary"
    grouped = blocks.withColumn("sender_", F.pmod(F.spark_partition_id(), F.lit(SENDER_GROUPS)))
    rows = grouped.groupBy("part", "sender_").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema).collect()
    return {r["part"]: np.frombuffer(r["block"], dtype).copy() for r in rows}


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits cells of the hashes in a long column; each task sends the blocks of cells it has set, joined by block."""
    block_bits = min(bits, 19)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [cell_of(b.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits) for b in batches]
        if not cells:
            return
        cells = np.unique(np.concatenate(cells))
        part = (cells >> np.uint64(block_bits)).astype(np.int64)
        for p in np.unique(part).tolist():
            own = np.zeros(1 << (block_bits - 3), np.uint8)
            c = cells[part == p] & np.uint64((1 << block_bits) - 1)
            np.bitwise_or.at(own, (c >> np.uint64(3)).astype(np.int64), np.uint8(1) << (c & np.uint64(7)).astype(np.uint8))
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "block": pa.array([own.tobytes()], pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << (block_bits - 3), np.uint8)
        for block in table.column("block"):
            total |= np.frombuffer(block.as_py(), np.uint8)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    schema = "part int, block binary"
    for r in hashes.select(column).mapInArrow(run, schema).groupBy("part").applyInArrow(join, schema).collect():
        size = 1 << (block_bits - 3)
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["block"], np.uint8)
    return out


def cell_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return mix(hashes) >> np.uint64(64 - bits)


def in_bitmap(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    cell = cell_of(hashes, bits)
    return ((table[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
