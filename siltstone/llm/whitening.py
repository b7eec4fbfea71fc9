"""Whitening of vectors from exact integer sums.

Entries become integers x = floor(64 c) + 1000000.  Each task subtracts the shift, splits its integers into limbs of 20 bits and multiplies limbs
in blocks of rows so small that every product is exact in doubles; sums and cross-products are kept as limbs of any number (``Exact``), so they
never overflow or round, and are added up in two levels of tasks.  The driver gets one pair of sums, whose size is the square of the dimension, forms
n XᵀX - SSᵀ in Python's integers (the shift cancels), and only then goes to doubles: divided by n², each entry rounded once, and decomposed by ``eigh``.

Results: rows whose vector is null, or holds a null, NaN or infinite entry, are left out; entries beyond 2**56 are held there; vectors of different lengths are
an error; repeated rows and ids each count.  A component is numbered only if its variance stands out from rounding (e > dimension x 2**-52 x the
largest): constant dimensions, one row alone, or fewer rows than dimensions give fewer components, and an empty table gives no rows.
``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from siltstone.llm.textops import Shared, added_up, prepared

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LIMB = 20
#: Rows multiplied at once: products of signed limbs stay under 2**38, their sums under 2**51.
ROWS = 1 << 13
#: Entries are held within this.
LARGEST = 1 << 62
SENDERS = 256


class Exact:
    """An array of integers of any size: the sum of ``limbs[k] << (20 k)``, each limb below 2**19 in magnitude but the last."""

    def __init__(self, shape: tuple[int, ...], limbs: list[np.ndarray] | None = None):
        self.shape, self.limbs = shape, limbs or []

    def add(self, value: np.ndarray, k: int) -> None:
        """Adds ``value << (20 k)``; |value| < 2**62."""
        while np.any(value):
            while len(self.limbs) <= k:
                self.limbs.append(np.zeros(self.shape, np.int64))
            total = self.limbs[k] + value
            value = (total + (1 << (LIMB - 1))) >> LIMB
            self.limbs[k] = total - (value << LIMB)
            k += 1

    def join(self, other: Exact) -> None:
        for k, limb in enumerate(other.limbs):
            self.add(limb, k)

    def numbers(self) -> np.ndarray:
        """As Python's integers."""
        out = np.zeros(self.shape, object)
        for k, limb in enumerate(self.limbs):
            out = out + limb.astype(object) * (1 << (LIMB * k))
        return out

    def bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in self.limbs)

    @classmethod
    def of(cls, data: bytes, shape: tuple[int, ...]) -> Exact:
        flat = np.frombuffer(data, np.int64).reshape(-1, *shape)
        return cls(shape, [x.copy() for x in flat])


def limbs_of(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of 20 bits, as doubles."""
    out = []
    while np.any(y):
        up = (y + (1 << (LIMB - 1))) >> LIMB
        out.append((y - (up << LIMB)).astype(np.float64))
        y = up
    return out


@dataclass
class Scatter:
    """Number of rows, and the exact sums and cross-products of their shifted integers."""

    n: int
    sums: Exact
    products: Exact

    @classmethod
    def empty(cls, d: int) -> Scatter:
        return cls(0, Exact((d,)), Exact((d, d)))

    def add(self, y: np.ndarray) -> None:
        for i in range(0, len(y), ROWS):
            limbs = limbs_of(y[i : i + ROWS])
            for a, left in enumerate(limbs):
                self.sums.add(left.sum(axis=0).astype(np.int64), a)
                for b, right in enumerate(limbs):
                    self.products.add((left.T @ right).astype(np.int64), a + b)
        self.n += len(y)

    def join(self, other: Scatter) -> None:
        self.n += other.n
        self.sums.join(other.sums)
        self.products.join(other.products)


def integers(vectors: pa.Array) -> np.ndarray:
    """floor(64 c) of each entry, which is x without its shift."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64)


def usable(vector: str) -> F.Column:
    v = F.col(vector)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, good) & (F.size(v) > 0)


SUMS = "part int, d int, n long, sums binary, products binary"


def _sent(scatter: Scatter, part: int) -> dict:
    return {"part": part, "d": scatter.sums.shape[0], "n": scatter.n, "sums": scatter.sums.bytes(), "products": scatter.products.bytes()}


def _added(rows: list[dict]) -> Scatter:
    if len(sizes := {r["d"] for r in rows}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    d = rows[0]["d"]
    total = Scatter.empty(d)
    for r in rows:
        total.join(Scatter(r["n"], Exact.of(r["sums"], (d,)), Exact.of(r["products"], (d, d))))
    return total


def scatter(rows: DataFrame, vector: str) -> Scatter | None:
    """The exact sums of all vectors; None without any."""
    kinds = pa.schema([("part", pa.int32()), ("d", pa.int32()), ("n", pa.int64()), ("sums", pa.binary()), ("products", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(integers(batch.column(0)))
            n += batch.num_rows
            own = own or Scatter.empty(held[0].shape[1])
            if any(x.shape[1] != own.sums.shape[0] for x in held):
                raise ValueError("vectors of different lengths")
            if n >= ROWS:
                own.add(np.concatenate(held))
                held, n = [], 0
        if own is not None:
            if held:
                own.add(np.concatenate(held))
            yield pa.RecordBatch.from_pylist([_sent(own, 0)], kinds)

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_sent(_added(table.select(kinds.names).to_pylist()), 0)], kinds)

    sums = rows.select(vector).mapInArrow(run, SUMS).withColumn("sender_", F.pmod(F.spark_partition_id(), F.lit(SENDERS)))
    total = sums.groupBy("part", "sender_").applyInArrow(add, SUMS).groupBy("part").applyInArrow(add, SUMS).collect()
    return _added([r.asDict() for r in total]) if total else None


@dataclass
class Whitening:
    """n, the shifted integers' sums, and the components as columns: unit eigenvectors over the roots of their variances, by falling variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    explained: np.ndarray
    components: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n x - S, exactly: longs where they fit, else Python's integers."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        most = int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1]
        if most < 1 << 63:
            return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in centred]
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.components


def fitted(total: Scatter, components: int = COMPONENTS) -> Whitening:
    n, sums, products = total.n, total.sums.numbers(), total.products.numbers()
    exact = n * products - np.outer(sums, sums)
    square = n * n
    # Integers are divided as integers: each entry is rounded once.
    v = np.array([[int(x) / square for x in row] for row in exact], np.float64)
    e, vectors = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")
    e, vectors = e[order], vectors[:, order]
    keep = np.flatnonzero(e > len(e) * np.finfo(float).eps * max(e[0], 0))[:components]
    trace = sum(int(exact[i, i]) for i in range(len(exact))) / square
    e, vectors = e[keep], vectors[:, keep]
    return Whitening(n, [int(s) for s in sums], e, e / trace if trace else e, vectors / np.sqrt(e))


def identity_error(rows: DataFrame, vector: str, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    shared, k = Shared(rows.sparkSession, model), model.components.shape[1]
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            if batch.num_rows:
                w = shared.value.whitened(shared.value.centred(integers(batch.column(0))))
                total += np.concatenate([[len(w)], w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    total = added_up(rows.select(vector).mapInArrow(run, "part int, block binary"))[0]
    n, mean = total[0], total[1 : 1 + k] / total[0]
    return float(np.abs(total[1 + k :].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """(rows, model, identity error): the usable rows with n, deviation (the exact sum of (n x - S)²) and whitened (array<double>), which replace
    columns of the same names; all other columns stay."""
    new = [StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]
    names = [f.name for f in new]
    own = rows.where(usable(vector))
    total = scatter(own, vector)
    kept = [c for c in rows.columns if c not in names]
    wide = own.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(vector).alias("vector"))
    if total is None:
        return own.select(*kept, *(F.lit(None).cast(f.dataType).alias(f.name) for f in new)), None, 0.0
    model = fitted(total, components)
    shared = Shared(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = shared.value.centred(integers(batch.column("vector")))
            w = shared.value.whitened(centred)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(w), shared.value.n)), pa.array(shared.value.deviations(centred), pa.int64()), lists], ["row", *names])

    out = wide.mapInArrow(run, StructType([wide.schema["row"], *new]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), *names), model, identity_error(own, vector, model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whitened(prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    explained = F.array(*(F.lit(float(x)) for x in (model.explained if model else []))).cast("array<double>")
    each = rows.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
