"""Token encoders.  An encoder turns a text into one vector per token; any object with this protocol will do.

The default needs no model: each token's vector is drawn from its hash and normalised, so equal tokens have a product of 1 and others one
near 0.  It makes results repeatable; it doesn't claim the quality of a trained model.  A text is cut at the encoder's length (DOCUMENT_TOKENS,
QUERY_TOKENS), and a token that comes again in it gives no second vector, since an equal vector can't change a maximum.
``TrainedEncoder`` wraps a late-interaction model where one is installed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.schemas import VECTORS

QUERY_TOKENS = 32
DOCUMENT_TOKENS = 8192
_CAMEL = re.compile("([a-z0-9])([A-Z])")
_SPLIT = re.compile("[^a-z0-9]+")


class Encoder(Protocol):
    name: str

    def documents(self, texts: list[str]) -> list[list[list[float]]]: ...

    def queries(self, texts: list[str]) -> list[list[list[float]]]: ...

    def prepare(self) -> None: ...

    def close(self) -> None: ...


#: Vectors of tokens that a process keeps: drawing one takes longer than all else that is done with it, and few tokens make most of any text.
KEPT_VECTORS = 1 << 16


@lru_cache(KEPT_VECTORS)
def _drawn(token: str, dims: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "big")
    v = np.random.Generator(np.random.PCG64(seed)).standard_normal(dims)
    own = (v / np.linalg.norm(v)).astype(np.float32)
    own.setflags(write=False)
    return own


class HashedEncoder:
    def __init__(self, dims: int = 32):
        self.dims, self.name = dims, f"hashed-tokens-{dims}"

    def vector(self, token: str) -> list[float]:
        return _drawn(token, self.dims).tolist()

    def _rows(self, text: str, most: int) -> list[np.ndarray]:
        tokens = [t for t in _SPLIT.split(_CAMEL.sub(r"\1 \2", text or "").lower()) if t]
        return [_drawn(t, self.dims) for t in dict.fromkeys(tokens[:most])]

    def documents(self, texts: list[str]) -> list[list[list[float]]]:
        return [self._rows(t, DOCUMENT_TOKENS) for t in texts]

    def queries(self, texts: list[str]) -> list[list[list[float]]]:
        return [self._rows(t, QUERY_TOKENS) for t in texts]

    def prepare(self) -> None:
        pass

    def close(self) -> None:
        pass


class TrainedEncoder:
    """A trained late-interaction model, by the optional package ``pylate``; loaded once per task."""

    def __init__(self, name: str, device: str | None = None):
        self.name, self.device, self.model = name, device, None

    def __getstate__(self) -> dict:
        return {"name": self.name, "device": self.device, "model": None}

    def prepare(self) -> None:
        if self.model is None:
            try:
                from pylate import models
            except ImportError as error:
                raise RuntimeError("a trained encoder needs the package pylate") from error
            self.model = models.ColBERT(model_name_or_path=self.name, device=self.device, query_length=QUERY_TOKENS, document_length=DOCUMENT_TOKENS)

    def _matrices(self, texts: list[str], is_query: bool) -> list[list[list[float]]]:
        self.prepare()
        return [[list(map(float, v)) for v in m] for m in self.model.encode(texts, is_query=is_query, show_progress_bar=False)]

    def documents(self, texts: list[str]) -> list[list[list[float]]]:
        return self._matrices(texts, False)

    def queries(self, texts: list[str]) -> list[list[list[float]]]:
        return self._matrices(texts, True)

    def close(self) -> None:
        self.model = None


def encoder_of(name: str | None = None, device: str | None = None) -> Encoder:
    """The encoder of that name, which an index keeps: hashed tokens of so many dimensions, the default, or else a trained model."""
    hashed = re.fullmatch(r"hashed-tokens-(\d+)", name or "hashed-tokens-32")
    return HashedEncoder(int(hashed[1])) if hashed else TrainedEncoder(name, device)


# What the messages of memory errors say.
MEMORY_MESSAGES = ("out of memory", "oom", "invalid buffer size", "not enough memory", "insufficient memory")
# End of fixed values.


def out_of_memory(error: BaseException) -> bool:
    return isinstance(error, MemoryError) or any(m in str(error).lower() for m in MEMORY_MESSAGES)


def bisected(embed, texts: list[str]) -> list:
    """Embeds a batch; one that doesn't fit in memory is halved, down to single texts, which raise."""
    try:
        out = embed(texts)
    except Exception as error:
        if len(texts) <= 1 or not out_of_memory(error):
            raise
        half = len(texts) // 2
        return bisected(embed, texts[:half]) + bisected(embed, texts[half:])
    if len(out) != len(texts):
        raise ValueError(f"{len(texts)} texts gave {len(out)} matrices")
    return out


#: Numbers that a task gathers before it gives the rows back, and those of one text more.  A few texts at a time would cost more to hand over than to embed.
GATHERED_NUMBERS = 1 << 20


def embedded(documents: DataFrame, encoder: Encoder, batch: int = 32) -> DataFrame:
    """documents (chunk_id, file_path, retrieval_text) -> (chunk_id, file_path, dims, matrix), in batches; the encoder is prepared once per task.  A text without tokens
    has an empty matrix."""

    def vectors(keys: pa.RecordBatch, matrices: list) -> pa.RecordBatch:
        """The keys with their matrices, whose vectors come one after the other."""
        dims = [len(own[0]) if own else 0 for own in matrices]
        ends = np.cumsum([0, *(len(own) * d for own, d in zip(matrices, dims))], dtype=np.int32)
        flat = [v for own in matrices for v in own]
        numbers = np.concatenate(flat).astype(np.float32, copy=False) if flat else np.empty(0, np.float32)
        return pa.RecordBatch.from_arrays([*keys.columns, pa.array(dims, pa.int32()), pa.ListArray.from_arrays(ends, numbers)], names=[*keys.schema.names, "dims", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.prepare()
        try:
            for rows in batches:
                keys, texts = rows.select(["chunk_id", "file_path"]), rows.column("retrieval_text")
                begin, held, numbers = 0, [], 0
                for i in range(0, len(texts), batch):
                    for own in bisected(encoder.documents, [t or "" for t in texts.slice(i, batch).to_pylist()]):
                        if len(set(map(len, own))) > 1:
                            raise ValueError("vectors of different lengths")
                        held.append(own)
                        numbers += len(own) * len(own[0]) if own else 0
                        if numbers >= GATHERED_NUMBERS:
                            yield vectors(keys.slice(begin, len(held)), held)
                            begin, held, numbers = begin + len(held), [], 0
                if held:
                    yield vectors(keys.slice(begin, len(held)), held)
        finally:
            encoder.close()

    return documents.select("chunk_id", "file_path", "retrieval_text").mapInArrow(run, VECTORS)


def query_vectors(spark, queries: list[tuple[str, str]], encoder: Encoder) -> DataFrame:
    """(query_id, q_row, vec) of the given queries; blank ones have none."""
    own = [(i, q) for i, q in queries if q.strip()]
    matrices = encoder.queries([q for _, q in own]) if own else []
    return spark.createDataFrame([(i, k, [float(x) for x in v]) for (i, _), m in zip(own, matrices) for k, v in enumerate(m)], "query_id STRING, q_row INT, vec ARRAY<FLOAT>")
