"""Null groups are groups, counts of any size do not overflow, and the varimax criterion."""

import numpy as np
from pyspark.sql import functions as F

from cohortry.operators import cluster, labels, rotate, stats
from cohortry.operators.ranks import quantiles


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, v double")
    got = {r.g: r.m for r in quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 2.0, None: 6.0}
    labelled = labels.group_median_label(df, ["g"], "v", "y").collect()
    assert sorted((r.v, r.y) for r in labelled) == [(1.0, 0), (3.0, 1), (5.0, 0), (7.0, 1)]
    centres = spark.createDataFrame([("a", 9.0), (None, 1.0)], "g string, centre double")
    tiers = cluster.order_labels(df, centres, "g").collect()
    assert sorted((r.v, r.tier) for r in tiers) == [(1.0, 1), (3.0, 1), (5.0, 0), (7.0, 0)]


def test_null_groups_in_regressions(spark):
    rows = [(g, float(i), 2.0 * i + (3 if g else 5)) for g in ("a", None) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: round(r.intercept, 6) for r in stats.regressions(df, ["g"], "y", ["x"]).collect()}
    assert got == {"a": 3.0, None: 5.0}


def test_association_of_large_counts(spark):
    cells = [("a", "x", 4_000_000_000), ("a", "y", 1_000_000_000), ("b", "x", 1_000_000_000), ("b", "y", 4_000_000_000)]
    got = stats._association(spark.createDataFrame(cells, "a string, b string, n long"), "a", "b").head()
    assert got.n == 10_000_000_000 and abs(got.cramers_v - 0.6) < 1e-6
    pairs = spark.range(1).select(stats._pairs(F.lit(10 ** 11))).head()[0]
    assert abs(pairs / (10 ** 22 / 2) - 1) < 1e-9


def test_varimax_is_an_orthogonal_optimum():
    x = np.random.default_rng(1).standard_normal((12, 4))
    out = rotate.varimax(x)
    assert np.allclose(out @ out.T, x @ x.T)

    def criterion(a):
        return (a ** 4).sum() - ((a ** 2).sum(axis=0) ** 2).sum() / len(a)

    assert criterion(out) > criterion(x)
    for angle in (-0.01, 0.01):
        for i in range(4):
            for j in range(i):
                turn = np.eye(4)
                turn[[i, j], [i, j]] = np.cos(angle)
                turn[i, j], turn[j, i] = np.sin(angle), -np.sin(angle)
                assert criterion(out @ turn) <= criterion(out)
