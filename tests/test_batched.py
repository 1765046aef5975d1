"""Side-by-side fits against plain NumPy on the same rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry import config as C
from cohortry.operators import batched as B, grid as G, sampling as M
from cohortry.operators.cluster import ward_levels
from cohortry.session import materialize

P = 4


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(4, P)) * 4
    z = np.vstack([m + rng.normal(size=(60, P)) * (0.5 + i / 3) for i, m in enumerate(middles)])
    return z, (np.arange(len(z)) % 3 == 0).astype(float), rng.integers(0, 3, size=len(z)).astype(float)


@pytest.fixture(scope="module")
def rows(spark, points):
    z, y, w = points
    df = spark.createDataFrame([(i, *map(float, z[i]), float(y[i]), float(w[i])) for i in range(len(z))],
                               "USER_ID long, a double, b double, c double, d double, y double, w double")
    return materialize(B.vector_rows(df.repartition(5), ["a", "b", "c", "d"], "y", weights=[F.col("w")]))


SPACES = [np.eye(P), np.diag([2.0, 1.0, 0.5, 0.1]), np.eye(P)[:, :2]]


def lloyd(x, w, centres, scale, tolerance=1e-4, rounds=100):
    for _ in range(rounds):
        label = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([np.average(x[label == c], axis=0, weights=w[label == c]) if w[label == c].sum() else centres[c]
                        for c in range(len(centres))])
        if ((new - centres) ** 2).sum() <= tolerance * scale:
            return centres, float((w * ((x - centres[label]) ** 2).sum(1)).sum())
        centres = new
    raise AssertionError("did not settle")


def test_kmeans_fits_equal_single_fits(rows, points):
    z, _, w = points
    fits = [B.KMeansFit(s, k, weight, i) for s in range(3) for k in (2, 4) for weight in (None, 0) for i in range(2)]
    B.seed_centres(rows, SPACES, fits)
    starts = [f.centres.copy() for f in fits]
    assert np.isin(starts[0], z @ SPACES[0]).all()
    B.kmeans(rows, SPACES, fits)
    for fit, start in zip(fits, starts):
        x = z @ SPACES[fit.space]
        centres, cost = lloyd(x, w if fit.weight == 0 else np.ones(len(z)), start, x.var(axis=0).mean())
        assert fit.settled and np.allclose(fit.centres, centres) and fit.cost == pytest.approx(cost)
    assert B.best_of(fits)[(0, 4, None)].cost == min(f.cost for f in fits if (f.space, f.k, f.weight) == (0, 4, None))


def em_step(x, share, means, covs, ridge=1e-6):
    dens = np.stack([s * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))
                     / np.sqrt(np.linalg.det(2 * np.pi * c)) for s, m, c in zip(share, means, covs)], axis=1)
    r = dens / dens.sum(1, keepdims=True)
    n = r.sum(0)
    means = (r.T @ x) / n[:, None]
    covs = np.stack([((r[:, j, None] * (x - means[j])).T @ (x - means[j])) / n[j] + ridge * np.eye(x.shape[1]) for j in range(len(n))])
    return n / n.sum(), means, covs, np.log(dens.sum(1)).mean()


def test_mixtures_are_fixed_points_and_climb(rows, points):
    z, _, _ = points
    starts = B.kmeans(rows, SPACES, [B.KMeansFit(s, k, None, 0) for s in (0, 2) for k in (2, 4)])
    fits = B.mixtures(rows, SPACES, [B.MixtureFit(f.space, f.k, None, 0, f.centres) for f in starts], tolerance=1e-9)
    for fit in fits:
        assert fit.settled and all(b >= a - 1e-7 for a, b in zip(fit.history, fit.history[1:]))
        share, means, covs, mean_log = em_step(z @ SPACES[fit.space], np.exp(fit.log_share), fit.means, fit.covariances)
        assert mean_log == pytest.approx(fit.likelihood, abs=1e-9)
        assert np.allclose(share, np.exp(fit.log_share), atol=1e-3) and np.allclose(means, fit.means, atol=1e-2)
        assert np.allclose(covs, fit.covariances, atol=2e-2)


def quality_of(x, label, y):
    ks = np.unique(label)
    square = ((x[:, None] - x[None]) ** 2).sum(-1)
    scores = []
    for i in range(len(x)):
        same = label == label[i]
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = square[i, same].sum() / (same.sum() - 1)
        b = min(square[i, label == c].mean() for c in ks if c != label[i])
        scores.append((b - a) / max(a, b))
    centres = np.array([x[label == c].mean(0) for c in ks])
    spread = np.array([np.sqrt(((x[label == c] - m) ** 2).sum(1)).mean() for c, m in zip(ks, centres)])
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1)) + np.diag([np.inf] * len(ks))
    within = sum(((x[label == c] - m) ** 2).sum() for c, m in zip(ks, centres))
    between = sum((label == c).sum() * ((m - x.mean(0)) ** 2).sum() for c, m in zip(ks, centres))
    return np.mean(scores), (between / (len(ks) - 1)) / (within / (len(x) - len(ks))), \
        ((spread[:, None] + spread[None]) / apart).max(1).mean(), within, between


def test_quality_equals_brute_force(rows, points):
    z, y, w = points
    fits = [B.Solution.of(B.best_of(B.kmeans(rows, SPACES, [B.KMeansFit(1, 3)]))[(1, 3, None)])]
    fits.append(B.Solution(2, 2, centres=np.eye(3)[:, :2] * 3, groups=np.array([0, 1, 1])))
    for solution, got in zip(fits, B.evaluate(rows, SPACES, fits)):
        x = z @ SPACES[solution.space]
        want = quality_of(x, solution.label(x), y)
        assert (got.silhouette, got.calinski_harabasz, got.davies_bouldin, got.within, got.between) == pytest.approx(want)
        assert got.within + got.between == pytest.approx(got.total) and got.hits.sum() == y.sum()
    weighted = B.Solution(0, 2, 0, np.array([z[0], z[-1]]))  # weights count as repeated rows
    again = np.repeat(np.arange(len(z)), w.astype(int))
    got = B.evaluate(rows, SPACES, [weighted])[0]
    want = quality_of(z[again], weighted.label(z[again]), y[again])
    assert (got.silhouette, got.calinski_harabasz, got.davies_bouldin) == pytest.approx(want[:3])


def test_agreement_of_labels(rows, points):
    z, _, _ = points
    a, b = B.Solution(0, 2, centres=z[[0, 239]]), B.Solution(0, 2, centres=z[[239, 0]])
    c = B.Solution(2, 3, centres=z[[0, 100, 239]][:, :2])
    same = B.agreement(rows, SPACES, [a, b, c])
    assert same[0, 1] == pytest.approx(1.0) and same[0, 2] == pytest.approx(same[1, 2]) and same[0, 2] < 1
    placed = B.place(rows, SPACES, {"one": a, "two": c}).orderBy("key").toPandas()
    assert (placed["one"].to_numpy() == a.label(z)).all() and (placed["two"].to_numpy() == c.label(z[:, :2])).all()


def test_mini_batches_equal_numpy(rows, points):
    z, _, _ = points
    batch = np.array([int(hashlib.md5(f"{i}|{C.BASE_SEED}".encode()).hexdigest()[:8], 16) % 4 for i in range(len(z))])
    start = z[[0, 70, 130]]
    centres, seen = start.copy(), np.zeros(3)
    for turn in range(8):
        x = z[batch == turn % 4]
        label = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        old = centres.copy()
        for c in range(3):
            if (label == c).any():
                seen[c] += (label == c).sum()
                centres[c] = old[c] + (label == c).sum() / seen[c] * (x[label == c].mean(0) - old[c])
    got, count = B.mini_batch_kmeans(rows, np.eye(P), start, batches=4, rounds=2)
    assert np.allclose(got, centres) and (count == seen).all()


def test_exact_bootstraps(spark):
    df = spark.createDataFrame([(7 * i,) for i in range(100)], "USER_ID long").repartition(4)
    numbered = M.row_numbers(df, "USER_ID").orderBy("USER_ID").collect()
    assert [(r.USER_ID, r.number) for r in numbered] == [(7 * i, i) for i in range(100)]
    found = M.exact_bootstraps(df, 3).collect()
    assert {b: sum(r.weight for r in found if r.bootstrap == b) for b in range(3)} == {0: 100, 1: 100, 2: 100}
    wide = M.with_bootstraps(df, 3).collect()
    assert len(wide) == 100 and {r.USER_ID: r.bootstraps[1] for r in wide if r.bootstraps[1]} == {
        r.USER_ID: r.weight for r in found if r.bootstrap == 1}
    assert any(r.bootstraps[0] == 0 for r in wide)


def test_ward_levels_follow_the_costs():
    rng = np.random.default_rng(1)
    centres, sizes = rng.normal(size=(12, 3)), rng.integers(1, 5, 12).astype(float)
    groups, n, c = [{i} for i in range(12)], list(sizes), list(centres)
    while len(groups) > 3:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)),
                   key=lambda t: n[t[0]] * n[t[1]] / (n[t[0]] + n[t[1]]) * ((c[t[0]] - c[t[1]]) ** 2).sum())
        c[j] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
        n[j] += n[i]
        groups[j] |= groups[i]
        del groups[i], n[i], c[i]
    label = ward_levels(centres, sizes, [3, 5])[3]
    assert {frozenset(np.flatnonzero(label == x)) for x in range(3)} == set(map(frozenset, groups))


def test_independent_components_part_sources(spark):
    rng = np.random.default_rng(5)
    source = np.column_stack([rng.uniform(-1, 1, 3000), rng.laplace(size=3000)])
    mixed = source @ np.array([[1.0, 0.6], [0.4, 1.0]])
    mixed = (mixed - mixed.mean(0)) / mixed.std(0)
    df = spark.createDataFrame([(i, float(a), float(b), 0) for i, (a, b) in enumerate(mixed)], "USER_ID long, a double, b double, y int")
    vectors = G.vectors_of(B.vector_rows(df, ["a", "b"], "y"), ["a", "b"])
    (space, settled), = G.independent(vectors, [np.eye(2)], [2])
    r = np.abs(np.corrcoef((mixed @ space).T, source.T)[:2, 2:])
    assert settled and r.max(axis=1).min() > 0.99


def test_small_sums_take_no_shuffle(rows, monkeypatch):
    def fits():
        starts = B.kmeans(rows, SPACES, [B.KMeansFit(s, k, 0, i) for s in range(3) for k in (1, 3) for i in range(2)])
        mixed = B.mixtures(rows, SPACES, [B.MixtureFit(f.space, f.k, 0, f.start, f.centres) for f in starts])
        vectors = G.Vectors(rows, ["a", "b", "c", "d"], B.moments(rows)[0])
        found = G.independent(vectors, [np.eye(P), SPACES[2]], [3, 2], rounds=5)
        return [f.cost for f in starts], [f.likelihood for f in mixed], [s for s, _ in found]

    shuffles, before = [], type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: shuffles.append(a) or before(self, *a))
    direct, few = fits(), len(shuffles)
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)
    for a, b in zip(direct, fits()):
        for x, y in zip(a, b):
            np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)
    assert few <= 3 < len(shuffles) - few  # moments alone are still added over the shuffle


def test_grids_have_all_cells_and_add_up(spark, sf):
    from cohortry.plans import experiments as X

    vectors = X.grid_vectors(spark, sf)
    sets = {n: C.FEATURE_SETS[n] for n in ("behavioral_only", "volume_reduced")}
    few = {"restarts": 2, "mixture_starts": 1}
    tables = [G.clustering_grid(vectors, sets, ["uniform", "velocity_boost"], ks=(3, 4), micro=20, **few),
              G.rotation_experiment(vectors, {"volume_reduced": (sets["volume_reduced"], "uniform")}, components=(2, 3), ks=(3,), **few),
              G.guided_experiment(vectors, sets, components=(3,), ks=(3,), **few),
              G.compression_experiment(vectors, C.FEATURE_SETS["combined_full"], weightings=("uniform",), ks=(3,), **few)]
    assert [t.count() for t in tables] == [24, 20, 4, 10]
    n = vectors.moments.n
    for t in tables:
        for r in t.collect():
            assert r.n_users == n and r.within_ss + r.between_ss == pytest.approx(r.total_ss)
            assert 1 <= r.n_clusters <= r.k and r.composite_score == pytest.approx(r.silhouette_squared * r.cramers_v, abs=1e-3) or r.n_clusters < 2


def test_mixture_sums_are_those_of_the_densities(monkeypatch):
    rng = np.random.default_rng(3)
    x, weight = rng.standard_t(3, size=(3000, 4)) * [1, 5, 1, 100], rng.integers(0, 3, 3000).astype(float)
    members = []
    for i, k in enumerate((2, 3)):
        half = rng.normal(size=(k, 4, 4))
        half[:, 2] = 0.0  # a column without variance in any component
        model = (np.log(np.full(k, 1 / k)), rng.normal(size=(k, 4)), *B._whiteners(half @ half.transpose(0, 2, 1) + 1e-6 * np.eye(4)))
        members.append((i, model[1], model))
    members.append((2, rng.normal(size=(3, 4)), None))
    for (_, centres, model), (fit, sums) in zip(members, B._mixture_sums(x, weight, members)):
        if model is None:
            label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            held, expected = np.eye(len(centres))[label], 0.0
        else:
            logs = B.log_density(x, *model)
            top = logs.max(axis=1, keepdims=True)
            total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
            held, expected = np.exp(logs - total), float(weight @ total[:, 0])
        held = held * weight[:, None]
        a, b = np.triu_indices(4)
        assert np.isclose(fit, expected, rtol=1e-9)
        assert np.allclose(sums, held.T @ np.column_stack([x[:, a] * x[:, b], x, np.ones(len(x))]), rtol=1e-6, atol=1e-4)


def test_centre_sums_take_the_first_of_equally_near_centres():
    x, weight = np.random.default_rng(4).normal(size=(2500, 3)), np.arange(2500.0) % 3
    sets = [x[:4], np.vstack([x[5], x[5], x[6]])]
    sums, costs = B._centre_sums(x, weight, sets)
    at = 0
    for j, centres in enumerate(sets):
        far = ((x[:, None] - centres) ** 2).sum(axis=2)
        held = np.eye(len(centres))[far.argmin(axis=1)] * weight[:, None]
        assert np.allclose(sums[at:at + len(centres)], held.T @ np.column_stack([x, np.ones(len(x))]))
        assert np.isclose(costs[j], weight @ far.min(axis=1))
        at += len(centres)


def test_centre_sums_of_many_sets_equal_brute_force():
    """Sets of equal size, sets of many centres and repeated centres, in any order."""
    rng = np.random.default_rng(4)
    x, weight = np.round(rng.normal(size=(1500, 3)), 1), rng.poisson(1.0, 1500).astype(float)
    centres = [np.round(rng.normal(size=(k, 3)), 1) for k in (3, 4, 3, 50, 1, 4, 40)]
    centres[1][3] = centres[1][0]
    centres[6][:] = centres[6][0]
    assert B._runs([3, 3, 1, 4, 4]) == [(0, 2, 3), (2, 3, 1), (3, 5, 4)]
    sums, costs = B._centre_sums(x, weight, centres)
    at = 0
    for c, cost in zip(centres, costs):
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        label = np.round(far, 9).argmin(axis=1)
        held = np.eye(len(c))[label] * weight[:, None]
        assert np.isclose(cost, weight @ far.min(axis=1))
        alone = (np.round(far, 9) == np.round(far, 9).min(axis=1)[:, None]).sum(axis=1) == 1
        if alone.all():
            np.testing.assert_allclose(sums[at:at + len(c)], held.T @ np.column_stack([x, np.ones(len(x))]), atol=1e-9)
        np.testing.assert_allclose(sums[at:at + len(c)].sum(axis=0), weight @ np.column_stack([x, np.ones(len(x))]), atol=1e-9)
        at += len(c)
    assert np.abs(sums[-39:]).sum() == 0 and sums[-40, -1] == weight.sum()


def test_a_pass_is_one_wave_of_tasks(spark):
    """One task a core, however many partitions a shuffle has and however little a task reads."""
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.files.maxPartitionBytes": "8m"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(0, 5000, 1, 3).select(F.col("id").alias("USER_ID"), F.rand(1).alias("a"), F.lit(0).alias("y"))
        rows = materialize(B.vector_rows(df, ["a"], "y"))
        assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.count() == 5000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
