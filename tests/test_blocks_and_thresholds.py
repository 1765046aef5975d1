"""Block comparisons, forests and thresholds against plain formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry import config as C
from cohortry.operators import blocks as BL, deep_forest as DF, thresholds as TH
from cohortry.operators.forest import grow, importances, probability
from cohortry.session import materialize


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in (1, 2, None):
        for i in range(120):
            a, b, c = rng.normal(size=3) * (1, 3, 1) + (0, 5, 0)
            level = rng.choice(["x", "y", "z"] if g != 2 else ["x", "y"])
            y = int(a + 0.3 * (b - 5) + 0.8 * (level == "y") + rng.normal() > 0.2)
            rows.append((g, i, float(a), float(b), float(c) if i % 9 else None, 1.0, level, y, "train" if i % 3 else "test"))
    frame = pd.DataFrame(rows, columns=["g", "USER_ID", "a", "b", "c", "one", "level", "y", "split"])
    schema = "g int, USER_ID long, a double, b double, c double, one double, level string, y int, split string"
    return spark.createDataFrame(rows, schema).repartition(5), frame


BLOCKS = {"small": (["a", "one"], []), "full": (["a", "b", "c"], ["level"])}


def matrix(frame, block):
    continuous, categorical = BLOCKS[block]
    out = [frame[c].fillna(0.0) for c in continuous]
    if categorical:
        out += [(frame["level"] == v).astype(float) for v in ("y", "z")]
    return np.column_stack(out)


def group_of(frame, g):
    return frame[frame["g"].isna()] if g is None else frame[frame["g"] == g]


def test_lines_equal_direct_fits(spark, samples):
    df, frame = samples
    data = BL.block_rows(df, ["g"], BLOCKS)
    assert sorted(data.groups, key=str) == [(1,), (2,), (None,)]
    moments = BL.group_moments(data)
    lines, gradients = BL.logistics(data, moments)
    assert max(gradients.values()) < 1e-5
    for line in lines + BL.discriminants(data, moments):
        part = group_of(frame, data.groups[line.group][0])
        train = part[part["split"] == "train"]
        raw, y = matrix(train, line.block), train["y"].to_numpy()
        spread = raw.std(axis=0)
        scaled = (raw - raw.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
        at = data.blocks[line.block]
        score = raw @ line.slope[at] + line.intercept
        if line.model == "LogReg":
            weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
            p = 1 / (1 + np.exp(-score))
            beta = line.slope[at] * np.where(spread > 0, spread, 1.0)
            assert np.allclose(scaled.T @ (weight * (p - y)) + beta, 0, atol=1e-4)  # the gradient
            assert abs((weight * (p - y)).sum()) < 1e-4
        else:
            means = [scaled[y == c].mean(axis=0) for c in (0, 1)]
            within = sum((scaled[y == c] - means[c]).T @ (scaled[y == c] - means[c]) for c in (0, 1)) / (len(y) - 2)
            w = np.linalg.pinv(within) @ (means[1] - means[0])
            want = (scaled - (means[0] + means[1]) / 2) @ w + np.log(y.sum() / (1 - y).sum())
            assert np.allclose(score, want, atol=1e-6)


def test_comparison_has_every_cell(spark, samples):
    df, frame = samples
    metrics, importance = BL.compare_subsamples(df, ["g"], BLOCKS, trees=30)
    rows = metrics.collect()
    assert len(rows) == 3 * 2 * 3 and {r.n for r in rows} == {40}
    for r in rows:
        assert 0.4 < r.auc <= 1 and (r.largest_gradient is not None) == (r.model == "LogReg")
    best = {(r.g, r.model): r.auc for r in rows if r.block == "full"}
    small = {(r.g, r.model): r.auc for r in rows if r.block == "small"}
    assert sum(best[k] > small[k] for k in best) >= 7
    shares = importance.filter("model = 'RF'").groupBy("g", "block").agg(F.sum("importance").alias("s")).collect()
    assert len(shares) == 6 and all(r.s == pytest.approx(1.0) for r in shares)
    table = BL.summarise(metrics, ["block", "model"]).collect()
    assert len(table) == 6 and {r.subsamples for r in table} == {3}


def test_forest_votes_do_not_depend_on_partitions(spark, samples):
    df, _ = samples
    tables = [BL.forests(BL.block_rows(d, ["g"], BLOCKS), trees=26).filter("key is not null").groupBy("_group", "block", "key")
              .agg(F.round(F.sum("votes"), 9).alias("v")) for d in (df, df.repartition(2))]
    assert tables[0].exceptAll(tables[1]).count() == 0 and tables[0].count() == 240


def test_trees_grow_to_pure_leaves():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 5)), 1)
    y = rng.random(300) < 0.4
    tree = grow(x, y, np.ones(300), np.random.default_rng(1), features=5, balanced=False)
    same = pd.DataFrame(x).assign(y=y).groupby(list(range(5)))["y"].transform("mean").to_numpy()
    assert np.allclose(probability(tree, x), same)  # only rows equal in every column share a leaf
    assert importances(tree, 5).sum() == pytest.approx(1.0)

    def gini(rows):
        p = y[rows].mean() if rows.any() else 0.0
        return rows.sum() * 2 * p * (1 - p)

    cuts = [(gini(np.ones(300, bool)) - gini(x[:, j] <= c) - gini(x[:, j] > c)) for j in range(5) for c in np.unique(x[:, j])[:-1]]
    assert tree.gain[0] == pytest.approx(max(cuts))
    assert grow(x, np.ones(300, bool), np.ones(300), rng).feature.tolist() == [-1]
    assert probability(grow(x[:0], y[:0], np.ones(0), rng), x[:2]).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("small", [10_000, 60])
def test_deep_forest_fits_its_training_rows(spark, small):
    """Trees of unlimited depth know every drawn row; tops from histograms or not."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + 0.3 * rng.normal(size=400) > 0).astype(int)
    table = spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), "train" if i % 4 else "test") for i in range(400)],
                                  "USER_ID long, a double, b double, c double, d double, e double, f double, y int, split string")
    rows = DF.forest_rows(table.repartition(3), list("abcdef"), "y")
    scored, shares = DF.deep_forest(rows, 6, trees=40, small=small, bins=16, score_training=True)
    got = scored.toPandas().set_index("key")
    assert len(got) == 400 and got.p.between(0, 1).all() and shares.sum() == pytest.approx(1.0)
    train, test = got[got.index % 4 > 0], got[got.index % 4 == 0]
    assert ((train.p > 0.5) == (train.y == 1)).mean() > 0.99 and ((test.p > 0.5) == (test.y == 1)).mean() > 0.7
    assert set(np.argsort(shares)[-3:]) == {0, 1, 2}
    one, _ = DF.deep_forest(rows, 6, trees=1, small=small, bins=16, score_training=True)
    digest = {r.key: r.h for r in rows.select("key", F.col("w")[0].alias("h")).collect()}
    drawn = [i for i in range(400) if i % 4 and DF.draws(np.array([digest[i]]), 0, C.BASE_SEED)[0]]
    p = {r.key: r.p for r in one.collect()}
    assert 180 < len(drawn) < 200 and all(p[i] == y[i] for i in drawn)  # an unlimited tree is right on all rows it drew
    tops = DF.tops(rows, 6, (1.0, 1.0), 3, C.BASE_SEED, small, 16)
    assert all(s != "open" for t in tops for s in t.state) and (max(len(t.state) for t in tops) > 3) == (small == 60)


def test_tops_choose_the_best_histogram_cut(spark):
    """With a bin for every value, the first cut is the best one of the columns looked at."""
    rows = [(i, float(i % 20), float(i * 7 % 13), int(i % 20 > 11), "train") for i in range(300)]
    data = DF.forest_rows(spark.createDataFrame(rows, "USER_ID long, a double, b double, y int, split string"), ["a", "b"], "y")
    for t, top in enumerate(DF.tops(data, 2, (1.0, 1.0), 6, 1, small=50, bins=64)):
        if DF._columns(t, 0, 0, 2, 1, 1)[0] == 0:
            assert (top.feature[0], top.cut[0], top.state) == (0, 11.0, ["cut", "leaf", "leaf"])


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g, (low, high) in {"a": (0.0, 6.0), "b": (-3.0, 0.5)}.items():
        x = np.r_[rng.normal(low, 1.0, 150), rng.normal(high, 0.5, 100)]
        rows += [(g, i, float(v), int(v + rng.normal() > (low + high) / 2)) for i, v in enumerate(x)]
    rows += [(None, i, 2.0, i % 2) for i in range(5)] + [("a", 999, None, 1)]
    return materialize(spark.createDataFrame(rows, "g string, USER_ID int, x double, y int").repartition(3))


def test_group_mixtures_are_fixed_points(scores):
    fits = {r.g: r for r in TH.group_mixtures(scores, ["g"], "x", 500, 1e-10).collect()}
    frame = scores.toPandas()
    for g in ("a", "b"):
        x, f = frame[(frame.g == g) & frame.x.notna()].x.to_numpy(), fits[g]
        assert f.settled and f.n == len(x) == 250 and f.share_low == pytest.approx(0.6, abs=0.03)
        dens = np.stack([s / np.sqrt(2 * np.pi * v) * np.exp(-(x - m) ** 2 / (2 * v)) for s, m, v in (
            (f.share_low, f.mean_low, f.var_low), (f.share_high, f.mean_high, f.var_high))], axis=1)
        r = dens / dens.sum(1, keepdims=True)
        assert np.log(dens.sum(1)).mean() == pytest.approx(f.mean_log_likelihood, abs=1e-8)
        assert r[:, 0].mean() == pytest.approx(f.share_low, abs=1e-5)
        assert (r[:, 1] @ x) / r[:, 1].sum() == pytest.approx(f.mean_high, abs=1e-4)
        assert f.share_low * f.mean_low + f.share_high * f.mean_high == pytest.approx(x.mean(), abs=1e-9)
    assert fits[None].mean_low == fits[None].mean_high == 2.0
    whole = TH.group_mixtures(scores.filter("g = 'a'"), [], "x", 500, 1e-10).head()
    assert whole.mean_low == pytest.approx(fits["a"].mean_low)


def test_threshold_methods(scores):
    placed, cuts = TH.threshold_labels(scores.filter("x is not null"), ["g"], "x", "y")
    placed = materialize(placed)
    frame, rules = placed.toPandas(), {r.g: r for r in cuts.collect()}
    for g, part in frame[frame.g.notna()].groupby("g"):
        assert rules[g].median == pytest.approx(part.x.median())
        gain = {c: ((part.x >= c) & (part.y == 1)).sum() / (part.y == 1).sum() + ((part.x < c) & (part.y == 0)).sum() / (part.y == 0).sum()
                for c in part.x}
        assert gain[rules[g].roc] == pytest.approx(max(gain.values()))
        ordered = part.sort_values("x").by_mixture.to_numpy()
        assert (np.diff(ordered) >= 0).all() and 0 < ordered.sum() < len(ordered)  # one cut
    same = {r.g: r for r in TH.pairwise_agreement(placed, ["g"]).collect()}
    part = frame[frame.g == "a"]
    assert same["a"].agree_median_roc == pytest.approx((part.by_median == part.by_roc).mean())
    steady = {r.method: r for r in TH.stability(placed, "USER_ID").collect()}
    pairs = [(p, q) for _, part in frame.groupby("USER_ID") for i, p in enumerate(part.to_dict("records"))
             for q in part.to_dict("records")[i + 1:]]
    for m in TH.METHODS:
        assert steady[m].pairs == len(pairs)
        assert steady[m].agreement == pytest.approx(np.mean([p[f"by_{m}"] == q[f"by_{m}"] for p, q in pairs]))
    assert sum(r.adopted for r in steady.values()) == 1


def test_small_groups_settle_in_tasks_as_large_ones_do_in_passes(scores, monkeypatch):
    def fitted():
        return {r.g: r.asDict() for r in TH.group_mixtures(scores, ["g"], "x").collect()}

    monkeypatch.setattr(TH, "SMALL", 0, raising=False)
    passes = fitted()
    monkeypatch.setattr(TH, "SMALL", 5_000, raising=False)

    def no_pass(*args):
        raise AssertionError("a group of few rows needs no pass a step")

    monkeypatch.setattr(TH, "_sums", no_pass)
    for group, row in fitted().items():
        assert row["steps"] == passes[group]["steps"] and row["settled"] == passes[group]["settled"]
        for name in ("share_low", "mean_low", "var_low", "share_high", "mean_high", "var_high", "mean_log_likelihood"):
            assert np.isclose(row[name], passes[group][name], rtol=1e-9, atol=1e-12)
