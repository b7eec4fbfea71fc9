"""Language identification by prediction by partial matching.

Each language has byte context trees of orders 0 to ``ORDER``, frozen after training.  A byte costs
log2((N + D) / n) bits in the longest context that has seen it, after an escape of log2((N + D) / D) bits in each
longer context that was seen without it (N bytes and D different bytes followed the context; below order 0 every byte
costs 8 bits).  A text's code length under a language is the exact sum; the shortest code wins.

Since the statistics are frozen, a byte's cost depends only on it and the ORDER bytes before it.  Tables of all such
byte groups seen in training are laid out once, as sorted arrays; a group outside them is priced exactly by escaping
order by order.

Learning takes a bounded number of pieces of each language, drawn by a hash from all its texts, long ones included.  However many
languages there are, all are learned: in slices of SLICE, one model each.  With several slices the texts pass by once
for each, carrying the shortest code so far, and no more than one model is in memory at a time.

Defined results: null, empty and letterless texts are ``und`` with score 0; whole texts count, whatever their length;
of equally short codes the language first by name wins; repeated rows each get their row; an empty table, or one without usable
rows to learn from, makes every text ``und``; columns beyond doc_id, text and, for learning, lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.textops import LOWER, Shared, chunks, documents, fold_of, stored, text_buffers

ORDER = 4
#: The classifier learns from at most so many pieces of each language, of so many characters each.
PIECES = 400
PIECE_CHARS = 4096
#: Languages in one model.
SLICE = 16
UNKNOWN = "und"
#: Code lengths are compared as if the text had so many bytes, so that scores don't all saturate.
SCORED_BYTES = 64
DOC_BITS = 24


def _normal_table() -> np.ndarray:
    table = LOWER.copy()
    table[0x30:0x3A] = 0x30
    table[0x09:0x0E] = 0x20
    return table


NORMAL = _normal_table()


def _letter_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x41:0x5B] = True
    table[0x61:0x7B] = True
    return table


LETTER = _letter_table()


def groups(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, it and the ``order`` bytes before it in its document as one number (zeros before the start)."""
    b = NORMAL[data].astype(np.uint64)
    out = b.copy()
    for k in range(1, order + 1):
        out[k:] |= b[:-k] << np.uint64(8 * k)
    length = np.diff(offsets)
    for k in range(order):
        at = offsets[:-1][length > k] + k
        out[at] &= np.uint64((1 << (8 * (k + 1))) - 1)
    return out


@dataclass
class Model:
    """codes[k]: sorted groups of k + 1 bytes that some language has seen; costs[k]: their bits in each language.
    contexts[k], escapes[k]: the same for the k bytes before, and the bits of escaping from them (0 where unseen)."""

    languages: list[str]
    codes: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def price(self, group: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each group in each language."""
        if order < 0:
            return np.full((len(group), len(self.languages)), 8.0)
        at, known = _find(self.codes[order], group)
        out = np.empty((len(group), len(self.languages)))
        out[known] = self.costs[order][at[known]]
        rest = group[~known]
        if len(rest):
            shorter = rest & np.uint64((1 << (8 * order)) - 1)
            bits = self.price(shorter, order - 1)
            at, seen = _find(self.contexts[order], rest >> np.uint64(8))
            bits[seen] += self.escapes[order][at[seen]]
            out[~known] = bits
        return out


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def trained(texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """The frozen model of {language: texts}."""
    languages = sorted(texts)
    seen: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        data = np.frombuffer(b"".join(texts[lang]), np.uint8)
        own = groups(data, np.cumsum([0, *map(len, texts[lang])]), order)
        seen.append([np.unique(own & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True) for k in range(order + 1)])
    model = Model(languages, [], [], [], [])
    for k in range(order + 1):
        codes = np.unique(np.concatenate([s[k][0] for s in seen] or [np.zeros(0, np.uint64)]))
        contexts = np.unique(codes >> np.uint64(8))
        n = np.zeros((len(codes), len(languages)))
        for j, s in enumerate(seen):
            n[np.searchsorted(codes, s[k][0]), j] = s[k][1]
        of = np.searchsorted(contexts, codes >> np.uint64(8))
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, of, n)
        np.add.at(kinds, of, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
            direct = np.log2((total + kinds)[of] / n)
        shorter = model.price(codes & np.uint64((1 << (8 * k)) - 1), k - 1) if len(codes) else np.zeros((0, len(languages)))
        model.codes.append(codes)
        model.contexts.append(contexts)
        model.escapes.append(escape)
        model.costs.append(np.where(n > 0, direct, escape[of] + shorter))
    return model


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each document of a chunk in each language."""
    n, k = len(offsets) - 1, len(model.languages)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    key = (groups(data, offsets) << np.uint64(DOC_BITS)) | doc
    key.sort()
    group = key >> np.uint64(DOC_BITS)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    bits = model.price(group[new])
    times = np.diff(np.append(new, len(group)))
    at = (key & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
    return np.stack([np.bincount(at, np.repeat(bits[:, j], times), n) for j in range(k)], axis=1) if k else np.zeros((n, 0))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LETTER[data], out=total[1:])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for d in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def weight(n_bytes: np.ndarray) -> np.ndarray:
    """What one bit counts in the score of a text of so many bytes."""
    return np.minimum(1.0, SCORED_BYTES / np.maximum(n_bytes, 1))


def decided(bits: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the shortest code, and the weight of all codes against it (1 or more)."""
    over = (bits - bits.min(axis=1, keepdims=True)) * weight(n_bytes)[:, None]
    return bits.argmin(axis=1), np.exp2(-over).sum(axis=1)


STATE = "lang_pred string, bits_ double, mass_ double, bytes_ long"
COLUMNS = [x.split()[0] for x in STATE.split(", ")]
KEYS = ["key_a", "key_b"]


def _priced(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """The shortest code (lang_pred, bits_) by one model, the weight of all codes against it (mass_) and the text's bytes, beside the columns ``names``; lang_pred is null for
    a text without letters."""
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), STATE])
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            n = len(offsets) - 1
            lang, bits, mass = [None] * n, np.full(n, np.inf), np.zeros(n)
            for i, j, b, o in chunks(data, offsets):
                size, letters = np.diff(o), has_letter(b, o)
                if not model.languages or not letters.any():
                    continue
                all_bits = code_lengths(model, b, o)
                best, share = decided(all_bits, size)
                for d in np.flatnonzero(letters):
                    lang[i + d] = model.languages[best[d]]
                bits[i:j], mass[i:j] = np.where(letters, all_bits[np.arange(j - i), best], np.inf), np.where(letters, share, 0.0)
            new = [pa.array(lang, pa.string()), pa.array(bits), pa.array(mass), pa.array(np.diff(offsets))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, *COLUMNS])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def _best_of_slices(docs: DataFrame, models: list[Model], names: list[str]) -> DataFrame:
    """As ``_priced``, by several models: each reads the texts and gives one row of numbers for each, under two hashes of the text; equal texts are one. Only these rows are
    shuffled, no texts are written."""
    own = F.coalesce("text", F.lit(""))
    texts = docs.select(F.xxhash64(own).alias("key_a"), F.xxhash64(F.lit(5), own).alias("key_b"), "text")
    priced = [_priced(texts, model, KEYS).where("lang_pred IS NOT NULL").withColumn("slice_", F.lit(i)) for i, model in enumerate(models)]
    rows = reduce(DataFrame.unionByName, priced).groupBy(*KEYS, "bytes_").agg(F.array_sort(F.collect_set(F.struct("bits_", "slice_", "lang_pred", "mass_"))).alias("s"))
    weight_ = F.least(F.lit(1.0), F.lit(float(SCORED_BYTES)) / F.greatest("bytes_", F.lit(1)))
    mass = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["mass_"] * F.pow(F.lit(2.0), (F.col("s")[0]["bits_"] - x["bits_"]) * weight_))
    best = stored(rows.select(*KEYS, F.col("s")[0]["lang_pred"].alias("lang_pred"), F.col("s")[0]["bits_"].alias("bits_"), mass.alias("mass_"), "bytes_"), "languages")
    keyed = docs.select(*names, F.xxhash64(own).alias("key_a"), F.xxhash64(F.lit(5), own).alias("key_b"))
    return keyed.join(best, KEYS, "left").drop(*KEYS)


def identified(docs: DataFrame, models: Model | list[Model], *keep: str) -> DataFrame:
    """lang_pred, score and bits_per_byte of each text, beside doc_id and the columns ``keep``."""
    models = [models] if isinstance(models, Model) else models
    names = list(dict.fromkeys(["doc_id", *keep]))
    # Columns to keep travel under names of their own, so that none clashes with the state.
    kept = [f"k{i}_" for i in range(len(names))]
    own = docs.select(*(F.col(c).alias(k) for c, k in zip(names, kept)), "text")
    own = _priced(own, models[0], kept) if len(models) == 1 else _best_of_slices(own, models, kept)
    size = F.greatest("bytes_", F.lit(1))
    known = F.col("lang_pred").isNotNull()
    score = F.when(known, 1 / F.col("mass_")).otherwise(0.0)
    rate = F.when(known, F.col("bits_") / size).otherwise(0.0)
    return own.select(*(F.col(k).alias(c) for c, k in zip(names, kept)), F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), rate.alias("bits_per_byte"))


def learn(docs: DataFrame, pieces: int = PIECES, piece_chars: int = PIECE_CHARS, slice_: int = SLICE) -> list[Model]:
    """Learns from rows outside fold 0 that have a lang: of each language the first pieces by a hash of the id and the place.

    The driver holds the names of the languages, and the pieces and the model of one slice of them at a time while it learns.
    """
    usable = docs.where(F.col("lang").isNotNull() & (fold_of() != 0) & (F.octet_length("text") > 0))
    mark = F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")))
    n = F.ceil(F.char_length("text") / piece_chars).cast("long")
    own = usable.select("lang", mark.alias("mark"), n.alias("n"))
    total = sorted((r["lang"], r["n"]) for r in own.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    if not total:
        return [trained({})]
    models = []
    order = W.partitionBy("lang").orderBy(F.xxhash64("mark", "piece", F.lit(1)), "mark", "piece")
    for i in range(0, len(total), slice_):
        part = total[i : i + slice_]
        # A threshold on the hash leaves about three times as many as wanted, however many there are; of these the first are taken.
        share = F.create_map(*(x for lang, count in part for x in (F.lit(lang), F.lit(int(min(1.0, 3 * pieces / count) * (1 << 24)) + 1))))
        spread = own.where(F.col("lang").isin(*(lang for lang, _ in part))).select("lang", "mark", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("piece"))
        ids = spread.where(F.pmod(F.xxhash64("mark", "piece"), F.lit(1 << 24)) < F.element_at(share, F.col("lang"))).distinct()
        chosen = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pieces).select("lang", "mark", "piece")
        # At most ``slice_ * pieces`` rows of three values are broadcast, and as many pieces collected.
        met = usable.select("lang", "text", mark.alias("mark")).join(F.broadcast(chosen), ["lang", "mark"])
        cut = met.select("lang", "mark", "piece", F.substring(F.col("text"), F.col("piece").cast("int") * piece_chars + 1, F.lit(piece_chars)).cast("binary").alias("text"))
        texts: dict[str, list[bytes]] = {}
        for r in cut.groupBy("lang", "mark", "piece").agg(F.min("text").alias("text")).collect():
            texts.setdefault(r["lang"], []).append(bytes(r["text"]))
        models.append(trained({k: sorted(v) for k, v in texts.items()}))
    return models


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang")
    return identified(docs, learn(docs)).select("doc_id", (fold_of() == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")
