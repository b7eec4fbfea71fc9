import random
import re

import numpy as np
import pytest

from siltstone.llm.components import components
from siltstone.llm.jaccard import clustered, joined, needed, prefix_length

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def changed(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


def corpus(seed):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for g in range(25):
        text = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 5, 12, 40, 150]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            rows.append(" ".join(changed(r, text, r.choice([0, 0, 1, 2, 5]) if len(text) > 20 else 0)))
    rows += [" ".join([f"x{i}{j}" for j in range(30)] + passage) for i in range(40)]
    hot = [f"h{i}" for i in range(200)]
    rows += [" ".join(changed(r, hot, r.randrange(6))) for _ in range(60)]
    rows += ["A b C", "a B c", "", None, " \n", "one", "ONE", "one two", "a b c d", "a  b\tc D"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,hot,block,k,num,den", [(2, 5, 12, 4, 85, 100), (3, 10**9, 200, 5, 8, 10)])
def test_against_brute_force(spark, seed, hot, block, k, num, den):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS cls", "3 AS h").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in clustered(docs, k, num, den, hot=hot, block=block).collect())
    assert got == brute(rows, k, num, den)


def test_repeated_rows_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "z y x w"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in clustered(docs).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 1, None), (None, 0, None)], key=str)
    assert clustered(docs.limit(0)).count() == 0


def test_trie_finds_every_component():
    r = random.Random(5)
    for _ in range(60):
        base = r.sample(range(1000), 40)
        sets = []
        for _ in range(r.randrange(2, 14)):
            s = set(base[: r.choice([6, 20, 40])])
            for _ in range(r.randrange(4)):
                s.discard(r.choice(base))
                s.add(r.randrange(2000, 2020))
            sets.append(np.array(sorted(s), np.uint64))
        root = list(range(len(sets)))
        for a, b in joined(list(range(len(sets))), sets, 85, 100)[0]:
            assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
            x, y = root[a], root[b]
            root = [x if v == y else v for v in root]
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
                    assert root[i] == root[j]


def test_bounds():
    for a in range(1, 60):
        assert a - prefix_length(a, 85, 100) + 1 == -(-85 * a // 100)
        for b in range(1, 60):
            i = needed(a, b, 85, 100)
            assert 100 * i >= 85 * (a + b - i) and 100 * (i - 1) < 85 * (a + b - i + 1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0
