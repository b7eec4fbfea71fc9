import random
import re

import numpy as np

from siltstone.llm import quality
from siltstone.llm.textops import fold_of
from pyspark.sql import functions as F


def area(y, s):
    rank = np.argsort(np.argsort(s, kind="stable")) + 1
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_texts_are_told_apart(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioubcdfgst") for _ in range(r.randint(2, 9)))
    rows = []
    for i in range(600):
        good = i % 3 > 0
        rows.append((i, " ".join(word() if good else word().upper() + r.choice(["!!", "###"]) for _ in range(60)), int(good)))
    odd = [(None, None, 1), (900, "", None), (901, None, None), (902, "a" * 200000, None), (5, rows[5][1], 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + odd], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label", "3 AS x")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows + odd], "doc_id long, quality int")
    vectors = quality.word_vectors(docs)
    out = quality.scored(docs, vectors, quality.learn(docs, labels, vectors)).withColumn("held", fold_of() == 0).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out)
    truth = {i: q for i, _, q in rows}
    apart = [x for x in out if x.held and x.doc_id in truth]
    assert len(apart) > 50 and area(np.array([truth[x.doc_id] for x in apart]), np.array([x.score for x in apart])) > 0.95


def test_empty_tables_and_one_class(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    vectors = quality.word_vectors(docs)
    for own in (labels, labels.limit(0)):
        scores = [x.score for x in quality.scored(docs, vectors, quality.learn(docs, own, vectors)).collect()]
        assert len(scores) == 30 and len(set(scores)) == 1
    assert quality.scored(docs.limit(0), quality.word_vectors(docs.limit(0)), quality.learn(docs, labels, vectors)).count() == 0


def test_vectors_do_not_depend_on_the_partitions(spark):
    docs = spark.createDataFrame([(i, f"the cat {i} sat\non a mat of {i * i}") for i in range(200)], "doc_id long, text string")
    a, b = (quality.word_vectors(docs.repartition(n)) for n in (1, 5))
    assert all((x == y).all() for x, y in zip(a, b))
    assert docs.select(F.count(F.lit(1))).first()[0] == 200


def test_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    s = quality.fitted(x, y).scores(x)
    for low in (0.0, 0.25, 0.5, 0.75):
        own = (s >= low) & (s < low + 0.25)
        assert abs(s[own].mean() - y[own].mean()) < 0.07


def test_vectors_and_pooling_against_loops(spark):
    r = random.Random(4)
    texts = ["", None, "one", "The cat 12 sat!!\n\nThe CAT 99 sat??", "é" * 7 + " x"] + [" ".join(r.choice(["red", "Blue", "77", "--", "\n", "tree"]) for _ in range(r.randint(1, 40))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|\n+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")
    sums = [np.zeros((n, quality.DIMS)) for n, _ in quality.STREAMS]
    own, seen = [], {}
    for text in texts:
        data = (text or "").encode()
        names, shapes, first = quality.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        parts = split.findall(data)
        assert len(parts) == len(names) == len(shapes) == first[-1]
        for part, name in zip(parts, names.tolist()):
            assert seen.setdefault(re.sub(rb"[0-9]", b"0", part), name) == name
        own.append([(int(a) % quality.WORD_BUCKETS, int(b)) for a, b in zip(names, shapes)])
        for (n, seed), total, ids in zip(quality.STREAMS, sums, (names, shapes)):
            places, signs = quality.index_vectors(ids, seed)
            for i in range(len(ids)):
                for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                    if i != j:
                        for p, s in zip(places[j], signs[j]):
                            total[int(ids[i]) % n, p] += s
    assert len(set(seen.values())) == len(seen)
    got = quality.word_vectors(docs)
    for total, vectors in zip(sums, got):
        unit = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1.0)
        used = np.abs(unit).sum(axis=1) > 0
        unit[used] -= unit[used].mean(axis=0)
        assert np.allclose(unit, vectors, atol=1e-6)
    flat = b"".join((t or "").encode() for t in texts)
    ends = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    pooled = quality.pooled(got, np.frombuffer(flat, np.uint8), ends)
    for row, ids in zip(pooled, own):
        want = [np.mean([got[k][t[k]] for t in ids], axis=0) if ids else np.zeros(quality.DIMS) for k in range(2)]
        assert np.allclose(row, np.concatenate([*want, [np.log1p(len(ids))]]), atol=1e-5)
