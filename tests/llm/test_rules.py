import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm.rules import Condition, counts, judged, learn, learned, verdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "a", "a b", "a b c a b c", "x\nx\n\nx ", "é#$ ü|\r\né#$ ü|", "\x00 \x00", "a b c " * 60, "\n".join(["l i n e"] * 5), "日本 語 " * 20, "w " * 49, "w%d " * 3]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines), "n_distinct": len(set(words))}


def check(texts):
    raw = [(t or "").encode() for t in texts]
    got = counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: int(got[k][i]) for k in want} == want, t


def test_counts_on_odd_texts():
    check(ODD)
    check([])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é|\x0b\x1c", max_size=40), max_size=6))
def test_counts_against_brute_force(texts):
    check(texts)


def test_learner_finds_the_thresholds():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] > 0.9) & (x["a"] < 0.5))
    rules = learned(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= np.logical_and.reduce([c.holds(x) for c in r])
    assert (hit == bad).mean() > 0.97
    assert learned(x, np.zeros(3000, bool)) == [] and learned(x, np.ones(3000, bool)) == []


def test_order_of_rules(spark):
    frame = spark.createDataFrame([(0.5,), (0.9,), (0.1,)], "a double")
    rules = [(Condition("a", True, 0.8),), (Condition("a", True, 0.4), Condition("a", False, 0.95))]
    assert [r[0] for r in frame.select(verdict(rules)).collect()] == [2, 1, 0]
    assert frame.select(verdict([])).first()[0] == 0


def test_judged_rows(spark):
    good = [(i, " ".join(f"wort{i}x{j}" for j in range(80)), 1) for i in range(120)]
    junk = [(i + 200, " ".join(f"w{i}{j}###" for j in range(80)), 0) for i in range(120)]
    odd = [(None, None, None), (900, "", 0), (901, "short", 1), (901, "short", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + junk + odd], "doc_id long, text string").selectExpr("*", "0 AS n_words", "'k' AS kept", "'r' AS rule")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + junk + odd], "doc_id long, quality int")
    rows = judged(docs, learn(docs, labels)).collect()
    assert len(rows) == 244
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in junk + odd)
    assert all(r.base_failed == (r.doc_id is None or r.doc_id >= 900) for r in rows)
    assert judged(docs.limit(0), []).count() == 0
    assert learn(docs, labels.limit(0)) == []


def test_ids_of_any_type_and_thresholds_between_the_classes(spark):
    """Text ids, a null one and repeated rows among them; a threshold lies half-way between good and bad."""
    texts = [(" ".join(f"w{i}x{j}{'' if i % 3 else '#'}" for j in range(60)), int(i % 3 > 0)) for i in range(90)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, (t, _) in enumerate(texts)] + [("d0", texts[0][0]), (None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", q) for i, (_, q) in enumerate(texts)] + [(None, 0)], "doc_id string, quality int")
    (rule,) = learn(docs, labels)
    assert [str(c) for c in rule] == ["symbols_per_word >= 0.5"]
    got = {r.doc_id: r.kept for r in judged(docs, [rule]).collect()}
    assert got == {f"d{i}": q > 0 for i, (_, q) in enumerate(texts)} | {None: False}
    x = {"a": np.array([0.0] * 50 + [0.4] * 20), "b": np.arange(70.0) % 7}
    order = np.random.default_rng(1).permutation(70)
    (rule,) = learned({k: v[order] for k, v in x.items()}, (x["a"] > 0)[order])
    assert [str(c) for c in rule] == ["a >= 0.2"]
