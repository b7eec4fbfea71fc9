"""Variable-capacity best-fit packing.

Documents become pieces of at most the largest capacity.  Pieces are dealt into groups of bounded size and packed per group,
longest first: a piece goes into the open bin it fills best; else it opens a bin of the capacity that costs least
for it.  Costs are set jointly for all capacities: a bin costs its capacity plus ``overhead``, and a capacity is charged by
the share of it that the pieces still to come can fill.  In the end each bin is downsized to the
smallest capacity that holds its contents.

Defined results: a text's tokens are its words and one end, so null and empty texts are one token; very long texts, longer
than the largest capacity, are cut into consecutive pieces, none lost; repeated rows are packed each, and dealt to groups by their copy number,
so that they spread like others; of bins with equal room the one last filled takes the piece; ids may be null and of any type;
an empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.textops import WORD, numbered, prepared, stored

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
#: Pieces packed together, on average.
GROUP_PIECES = 20_000


class Bins:
    """Open bins by the room left in them, for best fit in logarithmic time."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.of: dict[int, list[int]] = {}

    def put(self, room: int, index: int) -> None:
        if room <= 0:
            return
        if room not in self.of:
            bisect.insort(self.rooms, room)
            self.of[room] = []
        self.of[room].append(index)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) with the least room that holds ``size``."""
        i = bisect.bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        index = self.of[room].pop()
        if not self.of[room]:
            del self.of[room]
            self.rooms.pop(i)
        return room, index


def packed(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece, its offset there, and the capacity of each bin."""
    capacities = tuple(sorted(capacities))
    order = np.argsort(-sizes, kind="stable")
    # What pieces to come could fill: below[i] is the number of tokens in pieces no longer than i.
    below = np.zeros(capacities[-1] + 2)
    np.add.at(below, sizes, sizes)
    below = np.cumsum(below)
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    opened: list[int] = []
    open_bins = Bins()
    left = below[-1]
    for p in order.tolist():
        size = int(sizes[p])
        left -= size
        hit = open_bins.take(size)
        if hit is None:
            def cost(c: int) -> float:
                # Cost per token expected to fill the bin: its own piece, and of the room what pieces that fit there can supply.
                filled = size + min(c - size, left, below[min(c - size, size)])
                return (c + overhead) / filled

            capacity = min((c for c in capacities if c >= size), key=lambda c: (cost(c), c))
            hit = capacity, len(used)
            used.append(0)
            opened.append(capacity)
        room, b = hit
        bins[p], offset[p] = b, used[b]
        used[b] += size
        open_bins.put(room - size, b)
    final = np.array([capacities[bisect.bisect_left(capacities, u)] for u in used], dtype=np.int64)
    return bins, offset, final


def pieces(docs: DataFrame, largest: int = CAPACITIES[-1]) -> DataFrame:
    """doc_id, piece (from 0), token_start and n_tokens: consecutive pieces of each document."""
    tokens = (F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)) + 1).cast("long")
    own = docs.select("doc_id", tokens.alias("n"))
    parts = own.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest).cast("long"))).alias("piece"))
    return parts.select("doc_id", "piece", (F.col("piece") * largest).alias("token_start"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("n_tokens"))


def packing(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, token_start, n_tokens, bin_group and bin (together the bin's name), capacity, bin_offset."""
    own = stored(numbered(pieces(docs, max(capacities)), F.xxhash64("doc_id", "piece", "n_tokens"), "pieces"), "numbered-pieces")
    n = max(1, -(-own.count() // group_pieces))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "copy_"), F.lit(n)) if n > 1 else F.lit(0)
    dealt = own.withColumn("bin_group", salt.cast("int"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece long, token_start long, n_tokens long, bin_group int, bin long, capacity long, bin_offset long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "n_tokens", "copy_")]).drop_columns(["copy_"])
        bins, offset, capacity = packed(table.column("n_tokens").to_numpy(), capacities, overhead)
        for name, v in (("bin", bins), ("capacity", capacity[bins]), ("bin_offset", offset)):
            table = table.append_column(name, pa.array(v))
        return table

    return dealt.groupBy("bin_group").applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(prepared(spark).read.parquet(f"{sf_dir}/documents.parquet"))


