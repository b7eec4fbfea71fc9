import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import lm
from siltstone.llm.textops import fold_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


ROWS = [(i, f"The cat number {i % 9} sat on the mat with Word{i % 40}" + " and the dog" * (i % 5)) for i in range(400)] + [(500, None), (501, ""), (502, " \n"), (None, "the cat"), (7, "the cat"), (7, "the cat"), (503, "brandnew " * 3), (504, "the mat " * 30000)]


def test_counts_and_base_score_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS c", "3 AS score").repartition(3)
    model, counts = lm.learn(docs, fold_of(modulus=7) != 2)
    c = Counter(t for i, text in ROWS if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    assert (model.train_tokens, counts.count()) == (n, v)
    out = lm.scored(docs, model, fold_of(modulus=7) != 2, "text").collect()
    assert len(out) == len(ROWS)
    for r in out:
        own = tokens(r.text)
        assert (r.n_tokens, r.n_known) == (len(own), sum(c[t] > 0 for t in own))
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
    apart = [r for r in out if held(r.doc_id) and r.n_tokens > 5]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def solved_model(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return lm.learn(docs, fold_of(modulus=7) != 2)[0]


def test_probabilities_add_up_to_one(spark):
    """Over all buckets after a word: classes by both sets of features, and buckets within each class."""
    m = solved_model(spark)
    every = np.arange(lm.BUCKETS, dtype=np.uint64)
    one = np.full(lm.BUCKETS, 12345, np.uint64)
    keys = np.unique(lm.pair_keys(every, one))
    n = np.zeros(lm.BUCKETS, np.int64)
    n[[3, 70, 71, 900]] = (5, 1, 40, 2)
    cls, member, seen = lm.learned_pairs(keys, n, m)
    assert (seen == 48).all()
    assert (10 ** (cls + member)).sum() == pytest.approx(1, abs=1e-9)
    assert (10**member).reshape(lm.CLASSES, lm.MEMBERS).sum(axis=1) == pytest.approx(np.ones(lm.CLASSES))
    wide = m.class_share(np.arange(lm.CLASSES), one[: lm.CLASSES], one[: lm.CLASSES])
    assert wide.sum() == pytest.approx(1, abs=1e-5)
    likely = (10 ** (cls + member))[[3, 70, 71, 900]]
    assert likely[2] > 0.5 > likely[0] > likely[1] and likely[0] > 0.05


def test_pair_weights_have_no_gradient_left():
    """The updates end where the penalised likelihood is greatest."""
    rng = np.random.default_rng(5)
    group = np.sort(rng.integers(0, 40, 300))
    group = np.unique(group, return_inverse=True)[1]
    share, n = rng.random(300) / 400, rng.integers(1, 30, 300).astype(float)
    w, log_z = lm._solved(group, share, n)
    p = share * np.exp(w - log_z[group])
    total = np.bincount(group, n)[group]
    assert np.abs((n - total * p - lm.PENALTY * w) / total).max() < 0.01


def test_numbers_travel_unchanged():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64)), np.unique(rng.integers(0, 2**40, 50000, dtype=np.uint64))):
        assert (lm.unpacked_numbers(lm.packed_numbers(values)) == values).all()
    for values in (np.zeros(0, np.int64), np.array([0, 255]), np.array([256, 3]), np.array([1 << 40])):
        assert (lm.unpacked_counts(lm.small_numbers(values)) == values).all()


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame(ROWS[:5], "doc_id long, text string")
    never = fold_of(modulus=7) == 9
    model, counts = lm.learn(docs, never)
    rows = lm.scored(docs, model, never).collect()
    assert len(rows) == 5 and all(r.base_score == 0 and r.n_known == 0 and r.score < 0 for r in rows)
    assert lm.scored(docs.limit(0), model, never).count() == 0


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    """Many blocks and parts give the scores of one; equal rows are dealt apart."""
    docs = spark.createDataFrame(ROWS + [(9000, "same words again")] * 3000, "doc_id long, text string").repartition(5)
    train = fold_of(modulus=7) != 2
    model, _ = lm.learn(docs, train)
    one = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in lm.scored(docs, model, train).collect())
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm, "PART_BYTES", 40_000)
    many = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in lm.scored(docs, model, train).collect())
    assert many == one


def test_repeated_documents_score_apart(spark):
    """A held-out text that the corpus holds too scores far better than one of the same words in another order."""
    import random

    r = random.Random(2)
    rows = [(i, " ".join(f"v{r.randrange(300)}" for _ in range(80))) for i in range(400)]
    out = [i for i in range(1000, 2000) if held(i)][:40]
    inside = [(i, rows[j][1]) for j, i in enumerate(out[:20]) if not held(j)]
    outside = [(i, " ".join(sorted(rows[j][1].split(), key=lambda w: hash((w, j))))) for j, i in enumerate(out[20:])]
    docs = spark.createDataFrame(rows + inside + outside, "doc_id long, text string")
    train = fold_of(modulus=7) != 2
    got = {x.doc_id: x.score / x.n_tokens for x in lm.scored(docs, lm.learn(docs, train)[0], train).collect()}
    assert min(got[i] for i, _ in inside) > max(got[i] for i, _ in outside)


def test_every_training_token_is_learned_from(spark):
    """Each context of a training text, wherever it stands, gets weights."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(41)))], "doc_id long, text string")
    train = fold_of(modulus=7) != 9
    model, _ = lm.learn(docs, train)
    text = docs.first().text.encode()
    own, first = lm.token_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    rows = lm.feature_rows(*lm.history(own, first))
    assert model.class_weights[rows].any(axis=2).all()
