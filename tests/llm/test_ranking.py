"""Ranked search against a plain scan of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siltstone.llm.ranking import ranked, wand

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            own = sum(bag.values())
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * (25 + 75 * own * n // total))) for t in words(text) if bag[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked(d, i, **options).collect()), key=str)


def corpus(seed):
    pick = random.Random(seed)
    word = lambda: pick.choice("abcdefgh") * int(pick.expovariate(0.7) + 1)
    text = lambda k: " ".join(word() + pick.choice(["", "", "É", "-x", "9", "_"]) for _ in range(k))
    docs = [(i, text(pick.randint(0, 40))) for i in range(300)]
    docs += [(i + 300, docs[i % 5][1]) for i in range(40)] + [(1000, None), (1001, ""), (None, docs[3][1]), (7, docs[7][1]), (1002, text(5000)), (1003, "İSTANBUL ÀÉ")]
    items = [(i, text(pick.randint(1, 60))) for i in range(20)] + [(20, None), (21, "... !"), (None, "aa bb"), (3, docs[3][1]), (22, "àÉ İstanbul aa aa aa")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_docs": 20, "k": 3}, {"slice_bytes": 500, "shard_postings": 100}])
def test_against_a_plain_scan(spark, options):
    docs, items = corpus(len(options))
    assert result(spark, docs, items, **options) == brute(docs, items, options.get("k", 10))


def test_empty_tables_and_other_columns(spark):
    docs, items = corpus(9)
    assert result(spark, [], items) == result(spark, docs, []) == result(spark, [(1, None)], items) == []
    d = spark.createDataFrame([("b", "aa bb", 1, "x"), ("a", "aa bb", 2, "y"), ("c", None, 3, "z")], "doc_id string, text string, score int, item_ string")
    i = spark.createDataFrame([("q", "aa", 5)], "item_id string, text string, rank int")
    assert [tuple(r)[:3] for r in ranked(d, i).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]


@pytest.mark.parametrize("run", [1, 3, 64])
def test_wand_finds_the_best_and_skips(run):
    pick = np.random.default_rng(run)
    for _ in range(30):
        lists = [(d, pick.integers(0, 6, len(d))) for d in (np.flatnonzero(pick.random(200) < p) for p in (0.02, 0.1, 0.5, 0.9, 0.0))]
        total = np.zeros(200, np.int64)
        for docs, gains in lists:
            total[docs] += gains
        order = [d for d in np.argsort(-total, kind="stable") if total[d] > 0][:4]
        docs, scores = wand(lists, 4, run)
        assert docs.tolist() == order and scores.tolist() == total[order].tolist()


def test_documents_that_cannot_win_are_not_scored(monkeypatch):
    """A word of great impact in the first documents, and one of small impact in all: after the heap is full, nothing is left to score."""
    rare, common = np.arange(3), np.arange(100_000)
    seen = []
    real = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **b: seen.append(1) or real(*a, **b))
    docs, _ = wand([(rare, np.full(3, 1000)), (common, np.full(100_000, 1))], 3, 16)
    assert docs.tolist() == [0, 1, 2] and len(seen) < 12
