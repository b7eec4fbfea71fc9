"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

Words are hashed into ``CLASSES`` x ``MEMBERS`` buckets.  The probability of a token is that of its class, times that of its bucket
within the class, times the token's smoothed share of its bucket's training tokens.  Class and bucket are log-linear in two sets
of hashed features:

* n-gram features that grow with the corpus: the word before together with the class, and with the bucket.  Every pair that
  occurs in training has a weight.  Pairs are dealt, by the word before, to as many parts as they need; a part holds all pairs of a word, so it
  knows the exact gradient of their weights, takes STEPS gradient updates, and knows the exact normaliser.
* n-gram and skip features of the class in a table of fixed size: the word before, the word two before, and both.  Every task runs
  adaptive gradient steps over its share of the training documents, and the tasks' weights are averaged, for ROUNDS rounds.

The class is a mixture of both sets; the first counts N / (N + TRUST) where the word before occurred N times in training (255 for more).  Log
probabilities travel to the blocks as half-precision numbers, so each is off by up to one part in 2,048.

Nothing that grows with the input is broadcast or reaches the driver: texts are dealt into blocks of bounded bytes; each block sends its
distinct words and pairs to the parts, as sorted numbers, with their counts in its training documents, and gets counts
and log probabilities back, which meet the block's texts in one task.  Blocks and parts number at most about
sqrt(pairs / 64) each, so beyond some 0.4 TB they grow with the square root of the input (about 250 MB at 100 TB).

Defined results: a null text counts as empty, which is one end token; whole texts count, very long ones in one task; repeated rows
each get their row and are dealt apart; ids may be null; an empty table gives an empty result; without training documents all counts are 0
and the base score is 0; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.textops import LOWER, MULTIPLIERS, Shared, added_up, chunks, fold_of, mix, prepared, spans_hash, stored, text_buffers, words

CLASSES = 16
MEMBERS = 64
BUCKETS = CLASSES * MEMBERS
BUCKET_BITS = 10
MEMBER_BITS = 6
SLOTS = 1 << 12
FEATURES = 3
#: Gradients are taken at every token of each training document, in batches of BATCH.
BATCH = 4096
ROUNDS = 2
RATE = 0.1
PARTS = 8
#: Bits of a pair: the word before, hashed, and the bucket.
PAIR_BITS = 48
#: Gradient updates of the pairs' weights, their squared penalty, and how far few occurrences are trusted.
STEPS = 12
PENALTY = 0.2
TRUST = 1.0
#: Texts are scored in blocks of about so many bytes; small inputs in up to LEAST_BLOCKS smaller ones, for parallelism.
BLOCK_BYTES = 12 << 20
LEAST_BLOCKS = 64
#: Bytes of text whose pairs make up a part, about.
PART_BYTES = 24 << 20
END = mix(np.array([0xE0D], dtype=np.uint64))[0]
BEGIN = mix(np.array([0xB0E], dtype=np.uint64))[0]


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a chunk, each document's words and then one end; and each document's first token."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    n = len(offsets) - 1
    own = first + np.arange(n + 1)
    out = np.empty(own[-1], np.uint64)
    is_end = np.zeros(own[-1], bool)
    is_end[own[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = spans_hash(data, starts, ends)
    return out, own


def history(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two places before each token; BEGIN before the start of a document."""
    one, two = np.full(len(tokens), BEGIN), np.full(len(tokens), BEGIN)
    one[1:] = tokens[:-1]
    one[first[:-1]] = BEGIN
    two[1:] = one[:-1]
    two[first[:-1]] = BEGIN
    return one, two


def feature_rows(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Rows of the class table: the word before, the word before that, and both."""
    m = np.uint64(SLOTS)
    both = mix(one * MULTIPLIERS[1] + two * MULTIPLIERS[2])
    return np.stack([one % m, mix(two + MULTIPLIERS[3]) % m + m, both % m + m + m], axis=1).astype(np.int64)


@dataclass
class Model:
    """Weights of the table of fixed size, natural logarithms.  base: log10 of the share of each class, and of each bucket within its
    class; log_room: log10 of (tokens + distinct + 1) of each bucket; room: the same of the corpus."""

    class_bias: np.ndarray
    class_weights: np.ndarray
    base_class: np.ndarray
    base_member: np.ndarray
    log_room: np.ndarray
    train_tokens: int
    room: int

    def class_logits(self, rows: np.ndarray) -> np.ndarray:
        out = self.class_bias + self.class_weights[rows[:, 0]]
        for j in range(1, FEATURES):
            out += self.class_weights[rows[:, j]]
        return out

    def class_share(self, cls: np.ndarray, one: np.ndarray, two: np.ndarray, step: int = 1 << 13) -> np.ndarray:
        """Probability of each token's class by the table of fixed size."""
        out = np.empty(len(cls))
        for i in range(0, len(cls), step):
            s = slice(i, i + step)
            shares = _shares(self.class_logits(feature_rows(one[s], two[s])))
            out[s] = shares[np.arange(len(shares)), cls[s]]
        return out


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens % np.uint64(BUCKETS)).astype(np.int64)


def _shares(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, error: np.ndarray, rate: float) -> None:
    """One adaptive gradient step on the rows of a table; error: logit errors of each token of the batch."""
    used = np.zeros(len(table), bool)
    used[rows] = True
    at = np.flatnonzero(used)
    place = (np.cumsum(used) - 1)[rows.T.ravel()]
    own = error.T.astype(np.float64, order="C")
    grad = np.array([np.bincount(place, np.concatenate([x] * rows.shape[1]), len(at)) for x in own]).astype(np.float32)
    squares[at] += np.square(grad).mean(axis=0)
    table[at] -= (rate * grad / np.sqrt(squares[at] + 1.0)).T


def trained_on(model: Model, tokens: np.ndarray, one: np.ndarray, two: np.ndarray, squares: np.ndarray, rate: float = RATE) -> None:
    """Gradient steps over the given tokens, in place."""
    for i in range(0, len(tokens), BATCH):
        s = slice(i, i + BATCH)
        cls = bucket_of(tokens[s]) >> MEMBER_BITS
        rows = feature_rows(one[s], two[s])
        error = _shares(model.class_logits(rows))
        error[np.arange(len(cls)), cls] -= 1
        _step(model.class_weights, squares, rows, error, rate)


def counted(docs: DataFrame, train) -> DataFrame:
    """(h, c): the count of each distinct token, by its hash, over the documents where ``train`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[new], np.add.reduceat(n, new)

        def out(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[i : i + (1 << 16)].view(np.int64)), "n": pa.array(n[i : i + (1 << 16)])})

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for _, _, b, o in chunks(data, offsets):
                held.append(np.unique(token_hashes(b, o)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 20:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())

    return docs.where(train).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def start(counts: DataFrame) -> Model:
    """A model of the bucket shares alone, from the counts: one row per bucket reaches the driver."""
    bucket = F.pmod("h", F.lit(BUCKETS))
    n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    # The remainder of an unsigned number by a power of two is that of its signed twin.
    for r in counts.groupBy(bucket.cast("int").alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["b"]], v[r["b"]] = r["n"], r["v"]
    room = n + v + 1
    by_class = room.reshape(CLASSES, MEMBERS).sum(axis=1)
    return Model(
        np.log(by_class).astype(np.float32), np.zeros((FEATURES * SLOTS, CLASSES), np.float32),
        np.log10(by_class / by_class.sum()), np.log10(room / np.repeat(by_class, MEMBERS)), np.log10(room), int(n.sum()), int(n.sum() + v.sum() + 1),
    )


def updated(docs: DataFrame, train, model: Model) -> Model:
    """One round: every task steps through its training documents from the given weights; the weights are averaged by tokens."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(shared.value, class_weights=shared.value.class_weights.copy())
        squares, seen = np.zeros(len(own.class_weights), np.float32), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for _, _, b, o in chunks(data, offsets):
                tokens, first = token_hashes(b, o)
                trained_on(own, tokens, *history(tokens, first), squares)
                seen += len(tokens)
        if seen:
            flat = own.class_weights.ravel() * np.float32(seen)
            blocks = [x.tobytes() for x in np.split(flat, PARTS)] + [np.array([seen], np.float32).tobytes()]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS + 1), pa.int32()), "block": pa.array(blocks, pa.binary())})

    sums = added_up(docs.where(train).select("text").mapInArrow(run, "part int, block binary"), "float32")
    if not sums:
        return model
    flat = np.concatenate([sums[k] for k in range(PARTS)]) / sums[PARTS][0]
    return replace(model, class_weights=flat.reshape(model.class_weights.shape))


def learn(docs: DataFrame, train, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model (but for its pairs, which ``scored`` learns) and the stored token counts of the documents where ``train`` holds."""
    counts = stored(counted(docs, train), "token-counts")
    model = start(counts)
    for _ in range(rounds):
        model = updated(docs, train, model)
    return model, counts


def pair_keys(tokens: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The word before each token, hashed, and the token's bucket, as one number of PAIR_BITS bits."""
    return (mix(one * MULTIPLIERS[5]) >> np.uint64(64 - PAIR_BITS + BUCKET_BITS) << np.uint64(BUCKET_BITS)) | (tokens % np.uint64(BUCKETS))


def packed_numbers(values: np.ndarray) -> bytes:
    """Ascending numbers as differences of 4 bytes, where they fit."""
    if not len(values):
        return b""
    steps = np.diff(values)
    if len(steps) and steps.max() >= np.uint64(1 << 32):
        return b"8" + values.tobytes()
    return b"4" + values[:1].tobytes() + steps.astype(np.uint32).tobytes()


def unpacked_numbers(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    if blob[:1] == b"8":
        return np.frombuffer(blob, np.uint64, offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.uint64, 1, 1), np.frombuffer(blob, np.uint32, offset=9).astype(np.uint64)]), dtype=np.uint64)


def small_numbers(values: np.ndarray) -> bytes:
    """Counts in the least width that holds them all."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"u{width}").tobytes()


def unpacked_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"u{blob[0]}", offset=1).astype(np.int64)


def _solved(group: np.ndarray, share: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of items that occur n times in their group (ascending numbers) and have ``share`` of what all items, listed or not,
    weigh there without them; and the logarithm of each group's normaliser."""
    total = np.bincount(group, n)[group]
    w = np.log((n + PENALTY) / (total * share + PENALTY))
    for _ in range(STEPS):
        e = share * np.exp(w)
        p = e / (1 + np.bincount(group, e - share))[group]
        w += 0.8 * np.clip((n - total * p - PENALTY * w) / (total * p * (1 - p) + PENALTY), -3, 3)
    return w, np.log(1 + np.bincount(group, share * np.expm1(w)))


def learned_pairs(keys: np.ndarray, n: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending, distinct pairs that occur n times in training, all pairs of a word among them: log10 probability of the class
    after the word; of the bucket within the class after the word; and how often the word occurred before anything."""
    bucket = (keys & np.uint64(BUCKETS - 1)).astype(np.int64)
    cls = bucket >> MEMBER_BITS
    numbered = lambda x: np.cumsum(np.concatenate([[0], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    word, both = numbered(keys >> np.uint64(BUCKET_BITS)), numbered(keys >> np.uint64(MEMBER_BITS))
    n = n.astype(float)
    # Members: pairs that occur have weights; the others of a group share its normaliser.
    seen = np.flatnonzero(n > 0)
    own = np.unique(both[seen], return_inverse=True)
    w, log_z = _solved(own[1], 10 ** model.base_member[bucket[seen]], n[seen])
    weight, norm = np.zeros(len(keys)), np.zeros(both[-1] + 1 if len(both) else 0)
    weight[seen] = w
    norm[own[0]] = log_z
    member = model.base_member[bucket] + (weight - norm[both]) / math.log(10)
    # Classes, in the same way: one item for each word and class.
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    of_class = np.bincount(both, n) if len(both) else np.zeros(0)
    item_word, item_class = word[first], cls[first]
    seen = np.flatnonzero(of_class > 0)
    own = np.unique(item_word[seen], return_inverse=True)
    w, log_z = _solved(own[1], 10 ** model.base_class[item_class[seen]], of_class[seen])
    weight, norm = np.zeros(len(first)), np.zeros(word[-1] + 1 if len(word) else 0)
    weight[seen] = w
    norm[own[0]] = log_z
    class_log = model.base_class[item_class] + (weight - norm[item_word]) / math.log(10)
    return class_log[both], member, np.bincount(word, n)[word] if len(word) else n


def _block_tokens(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last + 1, tokens, each document's first token, the tokens one and two before) of the chunks of a block."""
    data, offsets = text_buffers(table.column("text_"))
    for i, j, b, o in chunks(data, offsets):
        tokens, first = token_hashes(b, o)
        yield i, j, tokens, first, *history(tokens, first)


ASKED = "part int, block_ int, words binary, word_n binary, pairs binary, pair_n binary"
GIVEN = "block_ int, part int, counts binary, logs binary, seen binary"


def _asking(bits: int):
    """Each block's distinct words and pairs, dealt to 2**bits parts, with their counts in training documents."""

    def ask(table: pa.Table) -> pa.Table:
        learns = table.column("train_").to_numpy()
        held: list[list[np.ndarray]] = [[], []]
        taught: list[np.ndarray] = []
        for i, j, tokens, first, one, _ in _block_tokens(table):
            held[0].append(tokens)
            held[1].append(pair_keys(tokens, one))
            taught.append(np.repeat(learns[i:j], np.diff(first)))
        train = np.concatenate(taught)
        own = []
        for values, width in zip(held, (64, PAIR_BITS)):
            keys, of = np.unique(np.concatenate(values), return_inverse=True)
            n = np.bincount(of[train], minlength=len(keys))
            edge = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)) if bits else np.zeros(1, np.int64)
            own.append((keys, n, np.append(edge, len(keys))))
        block, rows = table.column("block_")[0].as_py(), []
        for p in range(1 << bits):
            blobs = []
            for keys, n, edge in own:
                s = slice(edge[p], edge[p + 1])
                blobs += [packed_numbers(keys[s]), small_numbers(n[s])]
            if blobs[0] or blobs[2]:
                rows.append((p, block, *blobs))
        columns = list(zip(*rows))
        types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in ASKED.split(", ")])

    return ask


def _answering(shared: Shared):
    """What the blocks asked of a part: the counts of their words; for their pairs the two log probabilities, and how often the word before occurred."""

    def answer(table: pa.Table) -> pa.Table:
        model = shared.value

        def summed(names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            keys = [unpacked_numbers(x.as_py()) for x in table.column(names[0])]
            n = [unpacked_counts(x.as_py()) for x in table.column(names[1])]
            every, of = np.unique(np.concatenate(keys), return_inverse=True)
            return every, np.bincount(of, np.concatenate(n), len(every)).astype(np.int64), np.split(of, np.cumsum([len(k) for k in keys])[:-1])

        _, n, places = summed(("words", "word_n"))
        counts = [small_numbers(n[at]) for at in places]
        keys, n, places = summed(("pairs", "pair_n"))
        cls, member, seen = learned_pairs(keys, n, model)
        both = np.stack([cls, member], axis=1).astype(np.float16)
        few = np.minimum(seen, 255).astype(np.uint8)
        logs = [both[at].tobytes() for at in places]
        return pa.table([table.column("block_"), table.column("part"), pa.array(counts, pa.binary()), pa.array(logs, pa.binary()), pa.array([few[at].tobytes() for at in places], pa.binary())], [x.split()[0] for x in GIVEN.split(", ")])

    return answer


def scored(docs: DataFrame, model: Model, train, *keep: str) -> DataFrame:
    """n_tokens, n_known, base_score and score (log10) of each text, beside doc_id and the columns ``keep``; pairs are learned from the
    documents where ``train`` holds, which must be those that ``model`` was learned from."""
    names = list(dict.fromkeys(["doc_id", *keep]))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # At least about 64 pairs in what a block sends to a part.
    most = max(1, int(math.sqrt(total / 6 / 64)))
    n_blocks = max(1, min(most, math.ceil(total / BLOCK_BYTES)), min(LEAST_BLOCKS, total >> 20))
    bits = max(0, min(most, math.ceil(total / PART_BYTES), 1 << 20) - 1).bit_length()
    text = F.coalesce(F.col("text"), F.lit(""))
    # Which block a row goes to is all the same for its score; the row's number keeps equal rows apart.
    block = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    kept = [f"k{i}_" for i in range(len(names))]
    dealt = docs.select(block.alias("block_"), *(F.col(c).alias(k) for c, k in zip(names, kept)), F.coalesce(train, F.lit(False)).alias("train_"), text.alias("text_"))
    # Dealt once, with all columns, for both passes over the texts; small inputs too are spread over many tasks.
    dealt = dealt.repartition(n_blocks, "block_")
    asked = dealt.groupBy("block_").applyInArrow(_asking(bits), ASKED)
    shared = Shared(docs.sparkSession, model)
    given = asked.repartition(1 << bits, "part").groupBy("part").applyInArrow(_answering(shared), GIVEN)
    types = dict(docs.dtypes)
    results = "n_tokens long, n_known long, base_score double, score double"
    schema = ", ".join([*(f"{k} {types[c]}" for c, k in zip(names, kept)), results])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        right = right.sort_by("part")
        counts = np.concatenate([unpacked_counts(x.as_py()) for x in right.column("counts")])
        logs = np.concatenate([np.frombuffer(x.as_py(), np.float16).reshape(-1, 2) for x in right.column("logs")])
        seen = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in right.column("seen")])
        held = []
        for _, _, tokens, first, one, two in _block_tokens(left):
            own = [(x[0], x[1].astype(np.int32)) for x in (np.unique(v, return_inverse=True) for v in (tokens, pair_keys(tokens, one)))]
            held.append((bucket_of(tokens).astype(np.int16), one, two, first, *own))
        every, pairs = (np.unique(np.concatenate([x[k][0] for x in held])) for k in (4, 5))
        parts = [_scored_chunk(m, *x, every, counts, pairs, logs, seen) for x in held]
        new = [np.concatenate(x) for x in zip(*parts)]
        out = [pa.array(x, t) for x, t in zip(new, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.table([*(left.column(x) for x in kept), *out], [*kept, *(x.split()[0] for x in results.split(", "))])

    out = dealt.groupBy("block_").cogroup(given.groupBy("block_")).applyInArrow(run, schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(names, kept)), "n_tokens", "n_known", "base_score", "score")


def _scored_chunk(m: Model, bucket, one, two, first, word, pair, every, counts, pairs, logs, seen) -> tuple[np.ndarray, ...]:
    count = counts[np.searchsorted(every, word[0])]
    at = np.searchsorted(pairs, pair[0])
    class_log, member, trust = logs[at, 0].astype(float), logs[at, 1].astype(float), seen[at] / (seen[at] + TRUST)
    class_log = trust * 10**class_log
    bucket = bucket.astype(np.int64)
    share, of = np.log10(count + 1.0)[word[1]], pair[1]
    cls = class_log[of] + (1 - trust)[of] * m.class_share(bucket >> MEMBER_BITS, one, two)
    full = np.log10(cls) + member[of] + share - m.log_room[bucket]
    n, begin = np.diff(first), first[:-1]
    return n, np.add.reduceat((count > 0)[word[1]].astype(np.int64), begin), np.add.reduceat(share, begin) - n * math.log10(m.room), np.add.reduceat(full, begin)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    train = fold_of(modulus=7) != 2
    model, _ = learn(docs, train)
    out = scored(docs, model, train)
    return out.select("doc_id", (fold_of(modulus=7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
