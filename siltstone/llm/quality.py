"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

Every token has a fixed sparse index vector drawn from its hash.  A token's vector is the sum of the index vectors of
its neighbours over the whole corpus; tokens share WORD_BUCKETS such sums by their hashes.  Documents pool (average) the vectors of their tokens.  Two streams are
pooled: the tokens themselves, and their shapes (case, length, kind), which carry what rare tokens can't.
The corpus pass adds up blocks of a fixed size; the network learns on the driver from a bounded sample
of labelled rows; its probabilities are calibrated by a temperature fitted on rows it didn't learn from.

Defined results: null and empty texts pool to zeros and are scored like any other text; repeated rows each get their
row, and an id on several rows teaches by one of them; very long texts are pooled whole; equal texts get equal scores; ids may be of any type;
an empty table gives an empty result; without labels of both classes every score is the labels' mean
(0.5 without labels); columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.rules import labelled
from siltstone.llm.textops import Shared, SPACE, added_up, chunks, documents, fold_of, mix, owners, spans_hash, text_buffers

DIMS = 32
WORD_BUCKETS = 1 << 13
SHAPES = 256
NONZERO = 2
WINDOW = 2
PARTS = 16
#: The network learns from all labelled rows outside fold 0, or about so many chosen by a hash of the id.
LABELLED_ROWS = 20_000
CUT = 0.3


def _classes() -> np.ndarray:
    table = np.full(256, 3, np.uint8)
    table[SPACE] = 0
    table[0x0A] = 4
    table[0x30:0x3A] = 2
    for a, b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        table[a:b] = 1
    return table


CLASS = _classes()
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[0x30:0x3A] = 0x30


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each token (a run of letters, digits, signs or line ends), and each document's first token."""
    kind = CLASS[data]
    if not len(kind):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(kind) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= kind[1:] != kind[:-1]
    cut[0] = cut[-1] = True
    edges = np.flatnonzero(cut)
    full = kind[edges[:-1]] != 0
    starts, ends = edges[:-1][full], edges[1:][full]
    kind, size = kind[starts], ends - starts
    h = spans_hash(PLAIN[data], starts, ends)
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(UPPER[data], out=upper[1:])
    capital, all_capital = UPPER[data[starts]], upper[ends] - upper[starts] == size
    short = np.minimum(size, 15)
    sign = 80 + (h % np.uint64(160)).astype(np.int64)
    shape = np.select([kind == 1, kind == 2, kind == 3], [16 * (capital + 2 * all_capital) + short, 64 + short, sign], 240 + short)
    return h, shape, np.searchsorted(starts, offsets)


def index_vectors(names: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of the sparse index vector of each name."""
    h = mix(names.astype(np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64) + np.uint64(seed * 1_000_003))
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


STREAMS = ((WORD_BUCKETS, 1), (SHAPES, 2))


def rows_of(names: np.ndarray, n: int) -> np.ndarray:
    return (names % n).astype(np.int64)


def contexts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For both streams: the sums of the index vectors of the neighbours, by the row of each token."""
    *ids, first = tokens(data, offsets)
    doc = owners(first)
    out = []
    for own, (n, seed) in zip(ids, STREAMS):
        place, sign = index_vectors(own, seed)
        row, total = rows_of(own, n), np.zeros(n * DIMS)
        for step in range(1, WINDOW + 1):
            near = np.flatnonzero(doc[step:] == doc[:-step]) if len(doc) > step else np.zeros(0, np.int64)
            for a, b in ((near, near + step), (near + step, near)):
                for j in range(NONZERO):
                    total += np.bincount(row[a] * DIMS + place[b, j], sign[b, j], n * DIMS)
        out.append(total)
    return out


def word_vectors(docs: DataFrame) -> list[np.ndarray]:
    """Unit vectors of all buckets of both streams, from the whole corpus: a fixed number of bytes from each task, added up in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(n * DIMS) for n, _ in STREAMS]
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for _, _, b, o in chunks(data, offsets):
                for t, own in zip(total, contexts(b, o)):
                    t += own
        blocks = np.split(np.concatenate(total), PARTS)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "block": pa.array([b.tobytes() for b in blocks], pa.binary())})

    sums = added_up(docs.select("text").mapInArrow(run, "part int, block binary"))
    size = sum(n for n, _ in STREAMS) * DIMS
    flat = np.concatenate([sums[k] for k in range(PARTS)]) if sums else np.zeros(size)
    out, at = [], 0
    for n, _ in STREAMS:
        v = flat[at * DIMS : (at + n) * DIMS].reshape(n, DIMS)
        at += n
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1.0)
        used = np.abs(v).sum(axis=1) > 0
        if used.any():
            v[used] -= v[used].mean(axis=0)
        out.append(v.astype(np.float32))
    return out


def pooled(vectors: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean vector of each document in both streams, and the logarithm of its length."""
    *ids, first = tokens(data, offsets)
    n = np.diff(first)
    full = np.flatnonzero(n)
    parts = []
    for own, v in zip(ids, vectors):
        mean = np.zeros((len(n), DIMS), np.float32)
        if len(full):
            mean[full] = np.add.reduceat(v[rows_of(own, len(v))], first[:-1][full], axis=0) / n[full, None]
        parts.append(mean)
    return np.concatenate([*parts, np.log1p(n)[:, None].astype(np.float32)], axis=1)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fitted(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 0) -> Network:
    """Learns by Adam on four fifths of the rows, keeps the best epoch and fits the temperature on the other fifth."""
    d = x.shape[1] if x.ndim == 2 else 2 * DIMS + 1
    if len(y) < 10 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    p = {"w1": rng.normal(0, 1 / np.sqrt(d), (d, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.array(np.log(y.mean() / (1 - y.mean())))}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    xs, t, best, kept = (x - mean) / scale, 0, np.inf, {k: a.copy() for k, a in p.items()}
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            h = np.tanh(xs[at] @ p["w1"] + p["b1"])
            e = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - y[at]) / len(at)
            back = e[:, None] * p["w2"] * (1 - h * h)
            grad = {"w1": xs[at].T @ back + decay * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ e + decay * p["w2"], "b2": e.sum()}
            t += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if (now := _loss(np.tanh(xs[held] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"], y[held])) < best:
            best, kept = now, {k: np.copy(a) for k, a in p.items()}
    net = Network(mean, scale, kept["w1"], kept["b1"], kept["w2"], float(kept["b2"]), 1.0)
    z = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 101), key=lambda s: _loss(z / s, y[held])))
    return net


def _features(rows: DataFrame, vectors: list[np.ndarray], name: str, columns: list[str], then, schema: str) -> DataFrame:
    """Applies ``then`` to the pooled vectors of each chunk; the result is column ``name`` beside ``columns``."""
    shared = Shared(rows.sparkSession, vectors)
    kind = pa.binary() if schema.endswith("binary") else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            parts = [then(pooled(shared.value, b, o)) for _, _, b, o in chunks(data, offsets)]
            flat = [v for p in parts for v in p]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(flat, kind)], [*columns, name])

    return rows.select(*columns, "text").mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, vectors: list[np.ndarray], bound: int = LABELLED_ROWS) -> Network:
    """Learns from labelled rows outside fold 0, all of them or about ``bound``."""
    sample = labelled(labels.where(fold_of() != 0), "quality", bound)
    # At most about ``bound`` ids, and one vector for each: an id on very many rows is reduced before it is collected.
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kind = dict(known.dtypes)["doc_id"]
    rows = _features(known, vectors, "x", ["doc_id", "label"], lambda p: [v.tobytes() for v in p], f"doc_id {kind}, label int, x binary")
    rows = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).select("doc_id", "r.*").collect(), key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(float) if rows else np.zeros((0, 2 * DIMS + 1))
    return fitted(x, np.array([r["label"] for r in rows], float))


def scored(docs: DataFrame, vectors: list[np.ndarray], net: Network) -> DataFrame:
    """doc_id, score and predicted of each text."""
    kind = dict(docs.dtypes)["doc_id"]
    out = _features(docs, vectors, "score", ["doc_id"], lambda p: net.scores(p.astype(float)).tolist(), f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vectors = word_vectors(docs)
    net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), vectors)
    return scored(docs, vectors, net).select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted")
