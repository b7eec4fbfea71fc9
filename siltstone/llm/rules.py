"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditional expressions.

Statistics of each whole text are counted in numpy batches; the learned rules are conjunctions of thresholds on
ratios of these counts and run as one CASE expression.

Defined results: a null or empty text has zero in every count, fails the base rule and is not kept; repeated rows each
get their row; ids may be null; very long texts are counted whole; of rules that hold the first decides, and of equally good
conditions the first in feature order is grown; an empty table gives an empty result; columns beyond doc_id and text are ignored.
An id labelled more than once counts as good if one label says so, and an id on several rows teaches by one of them.
Without labels of both classes the list is empty, so the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.textops import MULTIPLIERS, SPACE, chunks, documents, mix, owners, pieces, spans_hash, text_buffers, words

#: Labelled rows that the learner sees: all of them, or about so many chosen by a hash of the id.
LABELLED_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct")


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


SYMBOL = _table("#*$%&|<>")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _table("0123456789")
PUNCT = _table("!\"'()+,-./:;=?@[\\]^_`{}~")


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: does its value occur twice or more in its document, and did it occur earlier there?"""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = mix(hashes + doc.astype(np.uint64) * MULTIPLIERS[63])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return again, earlier


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every document of a chunk."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    doc, n_words = owners(first), np.diff(first)
    h = spans_hash(data, starts, ends)
    out = {"n_words": n_words, "word_chars": _per_doc(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)}
    out |= {k: _per_doc(t[data], offsets) for k, t in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_punct", PUNCT))}
    _, earlier = _repeats(h, doc)
    out["n_distinct"] = n_words - np.bincount(doc[earlier], minlength=n)
    line_from, line_to, line_first = pieces(data != 0x0A, offsets)
    word_in = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_doc = owners(line_first)[word_in]
    _, earlier = _repeats(spans_hash(data, line_from, line_to)[word_in], line_doc)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[earlier], minlength=n)
    m = max(len(h) - 2, 0)
    window = h[:m] * MULTIPLIERS[0] + h[1 : m + 1] * MULTIPLIERS[1] + h[2 : m + 2] * MULTIPLIERS[2]
    whole = np.flatnonzero(np.arange(m) + 3 <= first[1:][doc[:m]])
    again, _ = _repeats(window[whole], doc[whole])
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[whole[again] + j] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts of each whole text, beside doc_id and the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            parts = [counts(b, o) for _, _, b, o in chunks(data, offsets)]
            columns = {k: pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for k in COUNTS}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | columns)

    names = list(dict.fromkeys(["doc_id", *keep]))
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), *(f"{k} long" for k in COUNTS)])
    return docs.select(*names, "text").mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """The ratios that thresholds apply to."""
    n, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "punct_per_word": F.col("n_punct") / n,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
        "distinct_share": F.col("n_distinct") / n,
        "words_per_line": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, least: int) -> Condition | None:
    """The condition of greatest information gain that holds for at least ``least`` bad rows: every place between two different values of a
    feature is tried, and the threshold lies half-way between them."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best, most = None, 1e-9
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        own, below = v[order], np.cumsum(bad[order])
        cut = np.flatnonzero(own[1:] > own[:-1])
        for above in (True, False):
            p = (p0 - below[cut]) if above else below[cut]
            total = (len(v) - 1 - cut) if above else cut + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p >= max(1, least), p * (np.log2(p / total) - np.log2(p0 / (p0 + n0))), 0.0)
            if len(gain) and gain.max() > most + 1e-9:
                i = int(gain.argmax())
                best, most = Condition(name, above, float((own[cut[i]] + own[cut[i] + 1]) / 2)), float(gain[i])
    return best


def learned(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.7, least: int = 5, longest: int = 4, most: int = 16) -> list[Rule]:
    """Sequential covering: each rule is grown on two thirds of the rows by information gain, pruned on the other third,
    taken if it is right often enough there, and its rows are removed.  Stops at the first rule that isn't."""
    rules: list[Rule] = []
    n = len(bad)
    third = np.arange(n) % 3 == 0
    left = np.ones(n, bool)
    while len(rules) < most and bad[left].any() and not bad[left].all():
        grow, prune = left & ~third, left & third
        inside, rule = grow.copy(), ()
        while len(rule) < longest:
            p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
            if p0 == 0 or n0 == 0:
                break
            best = _best({k: v[inside] for k, v in x.items()}, bad[inside], least)
            if best is None:
                break
            rule += (best,)
            inside &= best.holds(x)
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            hit = _covered(r, x, n) & prune
            p, q = int(bad[hit].sum()), int((~bad[hit]).sum())
            return ((p - q) / (p + q) if p + q else -1.0, p)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (round(worth(r)[0], 2), worth(r)[1], -len(r)))
        hit = _covered(rule, x, n)
        right, all_hit = bad[hit & prune].sum(), (hit & prune).sum()
        if all_hit < 2 or right < precision * all_hit or bad[hit & left].sum() < least:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def labelled(labels: DataFrame, column: str, bound: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, label): one row per labelled id, all of them or about ``bound`` chosen by a hash of the id."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    n = own.count()
    share = min(1.0, bound / max(1, n))
    return own.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS, **options) -> list[Rule]:
    """The decision list for rejecting quality 0, from at most about ``bound`` labelled rows."""
    sample = labelled(labels, "quality", bound)
    # At most about ``bound`` ids, and one row of numbers for each: an id on very many rows is reduced before it is collected.
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    own = features()
    stats = statistics(known, "label").where(~base_failed())
    numbers = F.struct("label", *(e.alias(k) for k, e in own.items()))
    # Ids may be of any type: rows are put in order by a hash of theirs, which also deals them to growing and pruning.
    rows = stats.groupBy("doc_id").agg(F.min(numbers).alias("r")).select(F.xxhash64(F.lit(3), "doc_id").alias("mark_"), "r.*").toPandas().sort_values(["mark_", *own], ignore_index=True)
    return learned({k: rows[k].to_numpy(float) for k in own}, rows["label"].to_numpy() == 0, **options)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = F.when(condition, F.lit(i)) if out is None else out.when(condition, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judged(docs: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """The counts of each text, base_failed, rule (number of the deciding rule or 0) and kept."""
    stats = statistics(docs, *keep)
    wide = stats.select("*", *(e.alias(k) for k, e in features().items())).withColumn("rule", verdict(rules))
    kept = ~F.col("base_failed") & (F.col("rule") == 0)
    return wide.drop(*features()).withColumn("base_failed", base_failed()).withColumn("kept", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
