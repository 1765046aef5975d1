"""Quality of one labelling, contextual tiers and scores; grids are in ``grid``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from cohortry import config as C
from cohortry.operators import batched as B, cluster as K, rotate as R
from cohortry.operators.mlprep import assemble, mean_of_z, standardize
from cohortry.session import materialize

KEEP = ["USER_ID", "persist_median"]


def evaluate_solution(found: DataFrame, label: str = "cluster",
                      y: str = "persist_median") -> tuple:
    """Quality of one labelling of written ``features`` vectors, in two passes.

    The first pass gives size, centre and variance per cluster, the second the squared
    silhouette and the spread around those centres. The composite is silhouette x V.
    """
    rows = found.groupBy(label).agg(
        F.count("*").alias("n"), F.sum(F.col(y)).alias("persistent"),
        Summarizer.metrics("mean", "variance").summary(F.col("features")).alias("s")).collect()
    noise = sum(row.n for row in rows if row[label] < 0)
    rows = sorted((row for row in rows if row[label] >= 0), key=lambda row: row[label])
    k = len(rows)
    if k < 2:
        return k, -1.0, 0.0, 99.0, 0.0, -1.0, noise
    sizes = np.array([row.n for row in rows], float)
    centres = np.array([row.s.mean.toArray() for row in rows])
    # sample variance to population variance
    scatter = np.array([row.s.variance.toArray().sum() for row in rows]) * (sizes - 1) / sizes
    total = sizes.sum()
    middle = sizes @ centres / total
    between = sizes @ ((centres - middle) ** 2).sum(axis=1)
    ch = (between / (k - 1)) / max(sizes @ scatter / (total - k), 1e-12)
    hits = np.array([float(row.persistent or 0) for row in rows])
    v = _cramers_v(np.column_stack([hits, sizes - hits]))
    silhouette, spread = _silhouette_and_spread(
        found.filter(F.col(label) >= 0), label, [row[label] for row in rows], centres, scatter, sizes)
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    db = ((spread[:, None] + spread[None]) / np.maximum(apart, 1e-12)).max(axis=1).mean()
    return (k, round(silhouette, 4), round(float(ch), 2), round(float(db), 4), round(v, 4),
            round(silhouette * v, 4), noise)


def _cramers_v(table: np.ndarray) -> float:
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    if np.any(expected == 0):
        return 0.0
    gap = np.abs(table - expected)
    if table.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    chi2 = float((gap ** 2 / expected).sum())
    return float(np.sqrt(chi2 / (table.sum() * (min(table.shape) - 1))))


def _silhouette_and_spread(found: DataFrame, label: str, labels: list[int], centres: np.ndarray,
                           scatter: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean squared-Euclidean silhouette and mean distance to the own centre per cluster."""
    order = np.asarray(labels)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            points = np.stack(batch["x"].to_numpy())
            own, at = np.searchsorted(order, batch[label].to_numpy()), np.arange(len(batch))
            square = np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)
            mean = square + scatter
            inside = mean[at, own] * sizes[own] / np.maximum(sizes[own] - 1, 1)
            mean[at, own] = np.inf
            nearest = mean.min(axis=1)
            score = np.where(sizes[own] > 1, (nearest - inside)
                             / np.maximum(np.maximum(nearest, inside), 1e-300), 0.0)
            yield pd.DataFrame({"c": own, "s": score, "d": np.sqrt(square[at, own])}).groupby(
                "c", as_index=False).sum()

    parts = found.select(label, vector_to_array("features").alias("x")).mapInPandas(
        partial, "c int, s double, d double")
    sums = parts.groupBy("c").agg(F.sum("s").alias("s"), F.sum("d").alias("d")).collect()
    spread = np.zeros(len(sizes))
    for row in sums:
        spread[row.c] = row.d / sizes[row.c]
    return float(sum(row.s for row in sums) / sizes.sum()), spread


# --- contextual tiers -------------------------------------------------------------------


def development_space(df: DataFrame, features: list[str] = C.PCA_FEATURES) -> tuple[DataFrame, R.Projection]:
    """First components with PC2 pointing towards development (higher income and index)."""
    scaled = materialize(standardize(df.select("ACCOUNT_TYPE", "persistence_c", *KEEP, *features), features))
    fitted = R.fit_pca(scaled, features, 3)
    rising = [features.index(f) for f in ("gdp_per_capita_ppp", "hdi", "gepi") if f in features]
    if fitted.weights[rising, 1].sum() < 0:
        fitted.weights[:, 1] *= -1
    placed = fitted.apply(scaled).select(
        "ACCOUNT_TYPE", "persistence_c", *KEEP, *fitted.names)
    return placed, fitted


def contextual_tiers(df: DataFrame, k: int = C.TIER_K, restarts: int = 10) -> tuple[DataFrame, R.Projection]:
    """Tiers 0..k-1 from low to high development on PC2."""
    placed, fitted = development_space(df)
    return K.ordered_tiers(placed, "PC2", k, restarts=restarts), fitted


def enrichment_axis(fitted: R.Projection) -> np.ndarray:
    """Unit direction of the country features in the PC1-PC2 plane, by magnitude."""
    rows = [i for i, f in enumerate(fitted.features) if f in C.ENRICHMENT_FEATURES + ["gepi"]]
    loadings = fitted.weights[rows, :2]
    size = np.linalg.norm(loadings, axis=1, keepdims=True)
    mean = (loadings * size).sum(axis=0)
    return mean / max(np.linalg.norm(mean), 1e-12)


def refined_scores(df: DataFrame) -> DataFrame:
    """Development score along the enrichment axis and the behavioural rest across it."""
    placed, fitted = development_space(df)
    a, b = (float(v) for v in enrichment_axis(fitted))
    return placed.withColumns({
        "development_score": F.col("PC1") * a + F.col("PC2") * b,
        "behavioral_residual": F.col("PC1") * b - F.col("PC2") * a})


def tier_selection(scores: DataFrame, score: str, ks: list[int], restarts: int = 10,
                   mixture_starts: int = 5) -> DataFrame:
    """Silhouette, BIC and Davies-Bouldin of one-dimensional tiers, all k and starts fitted together."""
    rows = materialize(B.vector_rows(scores.withColumn("_y", F.lit(0)), [score], "_y"))
    space = [np.eye(1)]
    fits = B.kmeans(rows, space, [B.KMeansFit(0, k, start=i) for k in ks for i in range(restarts)])
    best = B.best_of(fits)
    quality = B.evaluate(rows, space, [B.Solution.of(best[0, k, None]) for k in ks])
    mixed = B.mixtures(rows, space, [B.MixtureFit(0, f.k, None, f.start, f.centres) for f in fits if f.start < mixture_starts])
    found = []
    for k, q in zip(ks, quality):
        likely = max((f for f in mixed if f.k == k), key=lambda f: f.likelihood)
        bic, _ = B.information_criteria(likely, float(q.sizes.sum()))
        found.append((k, round(q.silhouette, 4), round(float(bic), 2), round(q.davies_bouldin, 4)))
    return scores.sparkSession.createDataFrame(
        found, "k int, silhouette_squared double, bic double, davies_bouldin double")


def with_velocity_score(df: DataFrame) -> DataFrame:
    return mean_of_z(df, C.TRANSITIONS, "velocity_score")
