import numpy as np
import pytest

from textloom.operators import models


def test_subsets_reach_the_optimum_in_few_passes(spark, monkeypatch):
    """The gradient of the penalised, balanced loss vanishes for each subset; passes don't grow with max_iter or the number of models."""
    r = np.random.default_rng(3)
    x = r.standard_normal((600, 3)) * [1, 2, 0.5]
    y = (x[:, 0] - x[:, 1] + r.standard_normal(600) > 1).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double").repartition(3)
    passes, real = [], models._sums
    monkeypatch.setattr(models, "_sums", lambda *a: passes.append(1) or real(*a))
    subsets = [[0, 1, 2], [1], [2, 0]]
    found = models.Logistic(50).together(rows, subsets)
    assert len(passes) <= 12
    w = np.where(y == 1, 600 / (2 * y.sum()), 600 / (2 * (600 - y.sum())))
    for m, own in zip(found, subsets):
        b = np.array(m.coefficients)
        e = w * (1 / (1 + np.exp(-m.intercept - x[:, own] @ b)) - y)
        assert e.sum() == pytest.approx(0, abs=1e-3) and x[:, own].T @ e + b == pytest.approx(0 * b, abs=1e-3)


def test_tasks_of_a_fit_are_bounded(spark):
    rows = spark.range(1000).coalesce(1)
    assert models.dealt(rows, 1000, 300).rdd.getNumPartitions() == 4 and models.dealt(rows, 1000, 1000).rdd.getNumPartitions() == 1
