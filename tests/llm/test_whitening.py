"""Whitening against Python's integers and fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from siltstone.llm.whitening import Exact, Scatter, fitted, whitened


def xs(vectors):
    return [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def test_sums_of_any_size_are_exact():
    pick = random.Random(1)
    rows = [[pick.randint(-(2**62), 2**62) >> pick.randint(0, 60) for _ in range(5)] for _ in range(300)]
    parts = [Scatter.empty(5) for _ in range(3)]
    for part, own in zip(parts, (rows[:1], rows[1:200], rows[200:])):
        part.add(np.array(own, np.int64))
    for part in parts[1:]:
        parts[0].join(part)
    total = parts[0]
    assert total.n == 300 and total.sums.numbers().tolist() == [sum(r[i] for r in rows) for i in range(5)]
    assert total.products.numbers().tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]
    again = Exact.of(total.products.bytes(), (5, 5))
    assert (again.numbers() == total.products.numbers()).all()


def test_covariance_is_rounded_once():
    """A spread of one unit around a large mean, where doubles would cancel."""
    pick = random.Random(2)
    rows = [[10**15 + pick.randint(0, 1), pick.randint(-5, 5), 3] for _ in range(200)]
    total = Scatter.empty(3)
    total.add(np.array(rows, np.int64))
    model = fitted(total)
    means = [Fraction(sum(r[i] for r in rows), 200) for i in range(3)]
    cov = np.array([[float(sum((r[i] - means[i]) * (r[j] - means[j]) for r in rows) / 200) for j in range(3)] for i in range(3)])
    assert model.components.shape == (3, 2)  # the third dimension doesn't vary
    assert np.allclose(model.components.T @ cov @ model.components, np.eye(2), atol=1e-12)
    assert model.variances[0] > model.variances[1] and np.isclose(model.explained.sum(), 1)


@pytest.mark.parametrize("scale", [0.2, 1e6, 1e15])
def test_against_plain_integers(spark, scale):
    pick = random.Random(3)
    vectors = [[pick.gauss(0.1 * i, scale) for i in range(6)] for _ in range(400)]
    vectors += [vectors[0]] * 50 + [None, [None] * 6, [1.0, float("nan")] + [0.0] * 4, [float("inf")] + [0.0] * 5]
    rows = spark.createDataFrame([(i if i % 90 else None, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n string").repartition(5)
    out, model, error = whitened(rows, components=4)
    got = [r.asDict() for r in out.collect()]
    want = xs(vectors)
    n, sums = len(want), [sum(c) for c in zip(*want)]
    deviations = sorted(sum((n * v - s) ** 2 for v, s in zip(x, sums)) for x in want)
    assert sorted(r["deviation"] or 2**63 for r in got) == [min(d, 2**63) for d in deviations]
    assert {r["n"] for r in got} == {n} and error < 1e-9 and model.components.shape == (6, 4)
    w = np.array([r["whitened"] for r in got])
    assert np.abs(w.T @ w / n - np.eye(4)).max() < 1e-6 and np.abs(w.mean(axis=0)).max() < 1e-6
    x = np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(r, sums)] for r in want])
    assert np.allclose(model.variances, np.linalg.eigvalsh(x.T @ x / n)[::-1][:4])


def test_few_rows_empty_tables_and_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitened(spark.createDataFrame([], schema))[0].count() == 0
    alone, model, error = whitened(spark.createDataFrame([(1, [1.0, 2.0])], schema))
    assert alone.collect()[0].whitened == [] and model.components.shape == (2, 0) and error == 0
    two, model, _ = whitened(spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [1.0, 2.0, 1.0])], schema))
    assert sorted(round(r.whitened[0] ** 2, 9) for r in two.collect()) == [1.0, 1.0] and model.components.shape == (3, 1)
    with pytest.raises(Exception, match="different lengths"):
        whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))
