"""Statistics on shapes that break naive plans: millions of ties, hundreds of columns with gaps, classes of any size."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import prep, stats

from .shuffles import shuffled


def ranks(x):
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def gappy(spark, n, p, seed=0, alike=False):
    r = np.random.default_rng(seed)
    x = np.round(r.standard_normal((n, p)) + r.standard_normal((n, 1)), 1) + 1000.0
    x[:, p - 1] = 5.0
    gone = r.random((n, p)) < 0.1
    if alike:
        gone[:, 1:3] = gone[:, :1]
    x[gone] = np.nan
    names = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in names))
    return x, names, df.repartition(5)


def test_ties_in_the_millions(spark):
    """Cubes and products of 2.2 million equal values leave 64 bits."""
    df = spark.range(2_200_000).select(F.lit(0.0).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    row = stats.rank_sums(df, ["x"], "y").first()
    assert row.n0 == row.n1 == 1_100_000 and row.u == 1_100_000**2 / 2 and row.rank_biserial == 0 and row.ties == pytest.approx(2.2e6**3 - 2.2e6)
    assert stats.mann_whitney(df, ["x"], "y").first().p_value == pytest.approx(1.0)
    assert stats.roc_auc(df, "y", "x").first().roc_auc == 0.5


def test_correlations_of_300_columns_with_gaps(spark):
    x, names, df = gappy(spark, 200, 300)
    got = {(r.a, r.b): r.r for r in stats.correlation_matrix(df, names).collect()}
    assert len(got) == 300 * 299 // 2
    for a in range(0, 300, 7):
        for b in range(a + 1, 300, 11):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            if b == 299:
                assert got[names[a], names[b]] is None
            else:
                assert got[names[a], names[b]] == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-9)
    one = df.select(F.corr("c0", "c9")).first()[0]
    assert got["c0", "c9"] == pytest.approx(one, abs=1e-9)


def test_rank_correlations_with_gaps(spark):
    x, names, df = gappy(spark, 300, 6, seed=3, alike=True)
    got = {(r.a, r.b): r.r for r in stats.correlation_matrix(df, names, ranks=True).collect()}
    assert len(got) == 15
    for a in range(6):
        for b in range(a + 1, 6):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            want = None if b == 5 else np.corrcoef(ranks(x[both, a]), ranks(x[both, b]))[0, 1]
            assert got[names[a], names[b]] == (None if want is None else pytest.approx(want, abs=1e-9))
    assert "ArrayTransform" not in df._jdf.queryExecution().toString()


def test_one_hot_value_in_most_rows(spark):
    """Spearman's of a column that is 0 in most rows counts equal pairs first."""
    r = np.random.default_rng(4)
    x, y = np.where(r.random(4000) < 0.9, 0.0, np.round(r.standard_normal(4000), 1)), np.round(r.standard_normal(4000), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    row = stats.spearman(df, ["x"], "y").first()
    assert row.n == 4000 and row.rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-9)


def test_highly_correlated_columns(spark):
    x, names, df = gappy(spark, 300, 5, seed=5)
    df = df.withColumn("twice", F.col("c1") * 2).withColumn("again", F.col("twice") + 1)
    assert prep.highly_correlated(df, [*names, "twice", "again"], 0.95) == ["twice", "again"]
    assert prep.highly_correlated(df.limit(0), names) == [] and prep.highly_correlated(df, ["c0"]) == []


def test_capped_classes(spark):
    rows = [(i, c) for i, c in enumerate(["a"] * 300 + ["b"] * 20 + [None] * 30)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(6)
    got = prep.cap_classes(df, "label", 25, "id").collect()
    order = lambda i: (hashlib.md5(f"{i}42".encode()).hexdigest(), i)
    want = {c: set(sorted((i for i, x in rows if x == c), key=order)[:25]) for c in ("a", "b", None)}
    assert {c: {r.id for r in got if r.label == c} for c in want} == want and len(got) == 70
    plan = prep.cap_classes(df, "label", 25, "id")._jdf.queryExecution().toString()
    assert "row_number" not in plan


def test_distinct_counts_up_to_three(spark):
    df = spark.createDataFrame([(1, 1, "x", None, 1.0), (1, 2, "x", None, 2.0), (1, 2, None, None, 3.0)], "one int, two int, text string, none int, many double")
    assert prep.distinct_counts(df, df.columns) == {"one": 1, "two": 2, "text": 1, "none": 0, "many": 3}
    assert prep.constant_columns(df, df.columns) == ["one", "text", "none"] and prep.continuous_columns(df, df.columns) == ["many"]


def test_rank_correlations_of_few_values_and_many(spark, monkeypatch):
    """With gaps in each column, on both ways."""
    x, names, df = gappy(spark, 400, 5, seed=8)
    both = []
    for few in (stats.FEW, 30, 0):
        monkeypatch.setattr(stats, "FEW", few)
        got = {r.feature: (r.n, r.rho) for r in stats.spearman(df, names[1:], "c0").collect()}
        assert set(got) == set(names[1:])
        for a in range(1, 5):
            known = ~np.isnan(x[:, 0]) & ~np.isnan(x[:, a])
            want = None if a == 4 else np.corrcoef(ranks(x[known, 0]), ranks(x[known, a]))[0, 1]
            assert got[names[a]] == (known.sum(), None if want is None else pytest.approx(want, abs=1e-9))
        both.append(got)
    none = df.withColumns({"none": F.lit(None).cast("double")})
    assert stats.spearman(none, ["none"], "c0").count() == 0 and stats.spearman(df.limit(0), names[1:], "c0").count() == 0


def test_features_of_few_values_are_shuffled_once_for_each_value_of_the_target(spark):
    df = spark.range(0, 60_000, 1, 4).select("id", *[(F.xxhash64("id", F.lit(k)) % m).cast("double").alias(c) for k, (c, m) in enumerate({"a": 50, "b": 11, "c": 9, "y": 2000}.items())])
    got = []
    assert shuffled(spark, lambda: got.extend(stats.spearman(df, ["a", "b", "c"], "y").collect())) < 1_500_000
    assert {r.feature: r.n for r in got} == dict.fromkeys("abc", 60_000)
