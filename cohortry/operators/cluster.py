"""Clustering of users: fits, assignment, and ordered labels."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortry import config as C
from cohortry.operators.mlprep import assemble
from cohortry.operators.ranks import hash_key, hash_uniform, join_groups
from cohortry.session import materialize


def order_labels(df: DataFrame, centres: DataFrame, label: str, name: str = "tier") -> DataFrame:
    """Replace group labels by 0, 1, ... in order of a one-dimensional ``centre``.

    ``centres`` has one row per group, so its single-partition window stays tiny.
    """
    order = centres.withColumn(name, F.dense_rank().over(W.orderBy("centre")) - 1)
    return join_groups(df, materialize(order.select(label, name)), [label])


def _restarts(run, seeds: list[int]) -> list:
    """Independent fits side by side: small jobs leave cores idle when run in turn."""
    with ThreadPool(min(4, len(seeds))) as pool:
        return pool.map(run, seeds)


def fit_kmeans(vectors: DataFrame, k: int, weight: str | None = None, seed: int = C.BASE_SEED,
               restarts: int = 10):
    """k-means with the lowest cost of several seeds; ``vectors`` should be written."""
    def run(s: int):
        estimator = KMeans(k=k, seed=s, featuresCol="features", predictionCol="cluster", maxIter=100)
        return (estimator.setWeightCol(weight) if weight else estimator).fit(vectors)

    models = _restarts(run, [seed + i for i in range(restarts)])
    return min(models, key=lambda m: m.summary.trainingCost)


def fit_mixture(vectors: DataFrame, k: int, seed: int = C.BASE_SEED, restarts: int = 5,
                rounds: int = 300):
    """Full-covariance Gaussian mixture with the best likelihood of several seeds."""
    def run(s: int):
        return GaussianMixture(k=k, seed=s, maxIter=rounds, featuresCol="features",
                               predictionCol="cluster").fit(vectors)

    models = _restarts(run, [seed + i for i in range(restarts)])
    return max(models, key=lambda m: m.summary.logLikelihood)


def information_criteria(model, k: int, dimensions: int, rows: int) -> tuple[float, float]:
    """BIC and AIC of a full-covariance mixture."""
    free = k * dimensions + k * dimensions * (dimensions + 1) // 2 + k - 1
    fit = model.summary.logLikelihood
    return free * math.log(rows) - 2 * fit, 2 * free - 2 * fit


def ward_levels(centres: np.ndarray, sizes: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
    """Group weighted centres by Ward's rule; labels at every wanted number of groups.

    The inputs are a few hundred micro-clusters. Costs of all pairs are kept and only those
    of the group just merged are worked out again.
    """
    centres, sizes = centres.astype(float).copy(), sizes.astype(float).copy()
    owner, alive, out = np.arange(len(centres)), np.ones(len(centres), bool), {}

    def cost_of(i: int) -> np.ndarray:
        line = ((centres - centres[i]) ** 2).sum(axis=1) * sizes * sizes[i] / (sizes + sizes[i])
        line[~alive] = np.inf
        line[i] = np.inf
        return line

    cost = np.stack([cost_of(i) for i in range(len(centres))]) if len(centres) else np.zeros((0, 0))
    for left in range(len(centres), 0, -1):
        if left in ks:
            out[left] = np.searchsorted(np.flatnonzero(alive), owner)
        if left <= min(ks):
            break
        i, j = sorted(np.unravel_index(cost.argmin(), cost.shape))
        centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        alive[j] = False
        owner[owner == j] = i
        cost[j, :] = cost[:, j] = np.inf
        cost[i, :] = cost[:, i] = cost_of(i)
    return out


def micro_clusters(vectors: DataFrame, micro: int = 200, seed: int = C.BASE_SEED):
    """First stage: rows placed in micro-clusters, with the centres and sizes of those."""
    model = fit_kmeans(vectors, micro, seed=seed, restarts=1)
    placed = model.transform(vectors).withColumnRenamed("cluster", "micro")
    centres = np.asarray(model.clusterCenters())
    sizes = np.zeros(len(centres))
    for row in placed.groupBy("micro").agg(F.count("*").alias("n")).collect():
        sizes[row.micro] = row.n
    return placed, centres, sizes


def ward_from(stage, k: int) -> DataFrame:
    """Second stage: Ward on the micro-centres; one first stage serves every k."""
    placed, centres, sizes = stage
    used = np.flatnonzero(sizes)
    k = min(k, len(used))
    labels = ward_levels(centres[used], sizes[used], [k])[k]
    lookup = F.create_map(*[F.lit(int(v)) for pair in zip(used, labels) for v in pair])
    return placed.withColumn("cluster", lookup[F.col("micro")]).drop("micro")


def ward_clusters(vectors: DataFrame, k: int, micro: int = 200, seed: int = C.BASE_SEED) -> DataFrame:
    """Ward's hierarchy in two stages: k-means to micro-clusters, then Ward on those.

    Rows stay distributed; only the fixed number of micro-centres is merged.
    """
    return ward_from(micro_clusters(vectors, micro, seed), k)


def assign(vectors: DataFrame, method: str, k: int, restarts: int = 10) -> DataFrame:
    """Cluster label of every row by a named method."""
    if method == "kmeans":
        return fit_kmeans(vectors, k, restarts=restarts).transform(vectors)
    if method == "gmm":
        return fit_mixture(vectors, k, restarts=min(restarts, 5)).transform(vectors)
    if method == "agglomerative":
        return ward_clusters(vectors, k)
    if method == "bisecting":
        model = BisectingKMeans(k=k, seed=C.BASE_SEED, featuresCol="features",
                                predictionCol="cluster").fit(vectors)
        return model.transform(vectors)
    raise ValueError(f"unknown clustering method {method!r}")


def ordered_tiers(scores: DataFrame, score: str, k: int, name: str = "tier",
                  restarts: int = 10, key: str = "USER_ID") -> DataFrame:
    """One-dimensional k-means on a score, tiers numbered from the lowest centre.

    All starts are fitted together. On a line the nearest centre is told by the middles
    between centres, so tiers are one expression over the scores. Null scores count as 0.
    """
    from cohortry.operators import batched as B

    rows = materialize(B.vector_rows(scores.withColumn("_y", F.lit(0)), [score], "_y", key))
    best = B.best_of(B.kmeans(rows, [np.eye(1)], [B.KMeansFit(0, k, start=i) for i in range(restarts)]))[(0, k, None)]
    centres = np.sort(best.centres[:, 0])
    x = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    above = [(x > float(m)).cast("int") for m in (centres[1:] + centres[:-1]) / 2]
    return scores.withColumn(name, sum(above, F.lit(0)))


def inertia(vectors: DataFrame, k: int, restarts: int = 1) -> float:
    return float(fit_kmeans(vectors, k, restarts=restarts).summary.trainingCost)


def gap_statistic(df: DataFrame, features: list[str], ks: list[int], references: int = 5,
                  key: str = "USER_ID") -> DataFrame:
    """log(inertia) against uniform boxes of the same extent; box points hash from the key."""
    ends = df.agg(F.struct(*[F.min(f).alias(f"a{i}") for i, f in enumerate(features)],
                           *[F.max(f).alias(f"b{i}") for i, f in enumerate(features)]))
    boxed = df.select(key, *features).withColumn("_e", ends.scalar())
    observed = materialize(assemble(df, features, [key]))
    boxes = []
    for b in range(references):
        points = {f: F.col(f"_e.a{i}") + (F.col(f"_e.b{i}") - F.col(f"_e.a{i}"))
                  * hash_uniform(hash_key(key, 1000 * b + i)) for i, f in enumerate(features)}
        boxes.append(materialize(assemble(boxed.withColumns(points), features, [key])))
    rows = []
    for k in ks:
        logs = [math.log(max(inertia(box, k), 1e-12)) for box in boxes]
        mine = math.log(max(inertia(observed, k), 1e-12))
        spread = float(np.std(logs) * math.sqrt(1 + 1 / references))
        rows.append((k, mine, float(np.mean(logs)), float(np.mean(logs)) - mine, spread))
    return df.sparkSession.createDataFrame(
        rows, "k int, log_inertia double, log_reference double, gap double, s_k double")
