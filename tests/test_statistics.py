"""Statistics and cluster measures against direct formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions.special import f_tail
from cohortry.operators import classify as CL, cluster as K, evaluate as E, experiments as EX
from cohortry.operators import mlprep as MP, rotate as R, stats as ST
from cohortry.session import materialize


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [4, 0, 1], [0, 5, -2]])
    label = rng.integers(0, 3, 150)
    points = centres[label] + rng.normal(size=(150, 3))
    frame = pd.DataFrame(points, columns=["a", "b", "c"])
    frame["label"], frame["USER_ID"] = label.astype("int32"), np.arange(150)
    frame["persist_median"] = (label > 0).astype("int32")
    return spark.createDataFrame(frame), frame


XS = ["a", "b", "c"]


def test_yates_only_for_two_by_two(spark):
    rows = [(0, 0)] * 10 + [(0, 1)] * 5 + [(1, 0)] * 3 + [(1, 1)] * 12
    got = ST.association(spark.createDataFrame(rows, "a int, b int"), "a", "b").head()
    observed = np.array([[10, 5], [3, 12]], float)
    expected = np.outer(observed.sum(1), observed.sum(0)) / 30
    assert got.corrected and abs(got.chi2 - ((abs(observed - expected) - 0.5) ** 2 / expected).sum()) < 1e-9
    three = spark.createDataFrame(rows + [(2, 0)] * 6, "a int, b int")
    wide = np.vstack([observed, [6, 0]])
    fit = np.outer(wide.sum(1), wide.sum(0)) / wide.sum()
    got = ST.association(three, "a", "b").head()
    assert not got.corrected and abs(got.chi2 - ((wide - fit) ** 2 / fit).sum()) < 1e-9


def test_rand_index_of_identical_permuted_and_independent_labels(spark):
    rows = [(i % 3, (i % 3 + 1) % 3, i % 2, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "x int, y int, z int, o int")
    assert abs(ST.adjusted_rand(df, "x", "x").head().ari - 1) < 1e-12
    assert abs(ST.adjusted_rand(df, "x", "y").head().ari - 1) < 1e-12
    assert abs(ST.adjusted_rand(df, "x", "z").head().ari) < 0.05
    assert ST.adjusted_rand(df, "o", "o").head().ari == 1.0
    every = {(r.a, r.b): r.ari for r in ST.adjusted_rand_all(df, ["x", "y", "z"]).collect()}
    for a, b in every:
        assert abs(every[a, b] - ST.adjusted_rand(df, a, b).head().ari) < 1e-12
    assert len(every) == 3


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 6, 80).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(ST.auc(df, [], "y", "s").head().auc - want) < 1e-12
    assert ST.auc(df.filter("y = 1"), [], "y", "s").head().auc == 0.5


def test_regression_and_partials(blobs):
    df, frame = blobs
    fit = ST.regressions(df, ["persist_median"], "c", ["a", "b"]).toPandas().set_index("persist_median")
    for g, part in frame.groupby("persist_median"):
        design = np.column_stack([part[["a", "b"]], np.ones(len(part))])
        beta = np.linalg.lstsq(design, part.c, rcond=None)[0]
        assert np.allclose([*fit.loc[g].coefficients, fit.loc[g].intercept], beta)
    got = ST.partial_correlations(df, [], "c", ["a"], ["b"]).head()
    rest = frame.c - np.polyval(np.polyfit(frame.a, frame.c, 1), frame.a)
    assert abs(got.r_partial - np.corrcoef(rest, frame.b)[0, 1]) < 1e-9


def test_cluster_measures_against_brute_force(blobs):
    df, frame = blobs
    x, label = frame[XS].to_numpy(), frame.label.to_numpy()
    centres = np.array([x[label == c].mean(0) for c in range(3)])
    sizes = np.bincount(label)
    within = sum(((x[label == c] - centres[c]) ** 2).sum() for c in range(3))
    between = (sizes[:, None] * (centres - x.mean(0)) ** 2).sum()
    ch = (between / 2) / (within / (len(x) - 3))
    spread = np.array([np.linalg.norm(x[label == c] - centres[c], axis=1).mean() for c in range(3)])
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(centres[i] - centres[j])
                      for j in range(3) if j != i) for i in range(3)])

    def silhouette(power):
        gap = ((x[:, None] - x[None]) ** 2).sum(2) ** (power / 2)
        out = []
        for i in range(len(x)):
            mean = [gap[i, label == c].sum() / (sizes[c] - (c == label[i])) for c in range(3)]
            a = mean.pop(label[i])
            out.append((min(mean) - a) / max(a, min(mean)))
        return np.array(out)

    assert abs(E.calinski_harabasz(df, XS, "label").head().calinski_harabasz - ch) < 1e-8
    assert abs(E.davies_bouldin(df, XS, "label").head().davies_bouldin - db) < 1e-9
    assert abs(E.silhouette_squared(df, XS, "label") - silhouette(2).mean()) < 1e-9
    rows = E.silhouette_squared_rows(df, XS, "label").toPandas().sort_values("USER_ID")
    assert np.allclose(rows.silhouette_squared, silhouette(2))
    found = materialize(MP.assemble(df, XS, ["persist_median", "label"]))
    quality = EX.evaluate_solution(found, "label")
    assert quality[0] == 3 and abs(quality[1] - silhouette(2).mean()) < 1e-4
    assert abs(quality[2] - ch) < 0.01 and abs(quality[3] - db) < 1e-4 and quality[6] == 0
    v = ST.association(df, "label", "persist_median").head().cramers_v
    assert abs(quality[4] - v) < 1e-4


def test_noise_label_stays_out(blobs):
    df, _ = blobs
    noisy = df.withColumn("label", F.when(F.col("USER_ID") < 10, -1).otherwise(F.col("label")))
    found = materialize(MP.assemble(noisy, XS, ["persist_median", "label"]))
    assert EX.evaluate_solution(found, "label")[6] == 10


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "k double, v double")
    assert [tuple(r) for r in MP.standardize(df, ["k", "v"]).collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_projections(blobs):
    df, frame = blobs
    data = materialize(MP.standardize(df, XS))
    z = (frame[XS] - frame[XS].mean()) / frame[XS].std(ddof=0)
    pca = R.fit_pca(data, XS, 3)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(z.T)))[::-1]
    assert np.allclose(pca.variance, values / 3) and np.all(np.abs(pca.weights).max(0) == pca.weights.max(0))
    scores = pca.apply(data).orderBy("USER_ID").select(*pca.names).toPandas()
    assert np.allclose(scores, z.to_numpy() @ pca.weights)
    turned = R.fit_varimax(data, XS, 2)
    assert np.allclose(turned.weights.T @ turned.weights, np.eye(2), atol=1e-8)
    one = R.fit_factors(data, XS, 1)
    model = one.loadings @ one.loadings.T
    assert np.allclose(model[0, 1], np.corrcoef(z.T)[0, 1], atol=0.05)
    ica = R.fit_ica(data, XS, 2)
    unmixed = z.to_numpy() @ ica.weights
    assert np.allclose(np.cov(unmixed.T, ddof=0), np.eye(2), atol=1e-6)


def test_discriminant_matches_closed_form(blobs):
    df, frame = blobs
    data = materialize(MP.standardize(df, XS))
    z = ((frame[XS] - frame[XS].mean()) / frame[XS].std(ddof=0)).to_numpy()
    y = frame.persist_median.to_numpy()
    m0, m1 = z[y == 0].mean(0), z[y == 1].mean(0)
    rest = z - np.where(y[:, None] == 1, m1, m0)
    pooled = rest.T @ rest / (len(z) - 2)
    got = R.fit_discriminant(data, XS, "persist_median")
    assert np.allclose(got.coefficients, np.linalg.solve(pooled, m1 - m0))
    scores = CL.discriminant_auc(df.withColumn("split", F.when(F.col("USER_ID") % 3 > 0, "train")
                                               .otherwise("test")), [], "persist_median", {"x": XS})
    assert scores.head().auc > 0.9


def test_kmeans_ward_and_tiers(blobs):
    df, _ = blobs
    vectors = materialize(MP.assemble(df, XS, ["USER_ID", "label"]))
    costs = [K.inertia(vectors, k, restarts=3) for k in (2, 3, 4)]
    assert costs == sorted(costs, reverse=True)
    model = K.fit_kmeans(vectors, 3, restarts=3)
    assert ST.adjusted_rand(model.transform(vectors), "label", "cluster").head().ari > 0.8
    ward = K.ward_clusters(vectors, 3, micro=30)
    assert ST.adjusted_rand(ward, "label", "cluster").head().ari > 0.8
    tiers = K.ordered_tiers(df.select("USER_ID", "a"), "a", 3, restarts=2)
    means = [r[1] for r in tiers.groupBy("tier").agg(F.avg("a")).orderBy("tier").collect()]
    assert means == sorted(means) and len(means) == 3


def test_tail_probability():
    # known values: F(1, 10) = 4.965 and F(3, 20) = 3.098 cut off five percent
    assert abs(f_tail(4.9646, 1, 10) - 0.05) < 1e-4 and abs(f_tail(3.0984, 3, 20) - 0.05) < 1e-4
    assert f_tail(0.0, 1, 5) == 1.0


def test_survival_ends_at_zero_and_censors(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, True)], "d int, e boolean")
    rows = [(r.d, r.n_at_risk, round(r.survival, 6)) for r in
            ST.kaplan_meier(df, [], "d", "e").orderBy("d").collect()]
    assert rows == [(1, 3, 0.666667), (2, 2, 0.666667), (3, 1, 0.0)]


def test_weights_sum_per_construct():
    got = MP.weights(["logins_90d", "names_90d", "funnel_stage"], "equal_construct")
    assert got == {"logins_90d": 0.5, "names_90d": 0.5, "funnel_stage": 1.0}
    with pytest.raises(KeyError):
        MP.weights(["logins_90d"], "no_such_strategy")
