"""Linear projections of standardised features: PCA, varimax, factors, ICA, discriminant.

Every method ends in a p x k matrix on the driver (p is a feature count, at most a few
dozen). Data is touched by distributed passes for the moments and by one projection.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators.mlprep import assemble
from cohortry.operators.stats import correlation_matrix


@dataclass
class Projection:
    """Weights from features to components, with loadings and variance shares."""

    features: list[str]
    names: list[str]
    weights: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Add one column per component: plain expressions, no Python per row."""
        return df.withColumns({
            name: X.total(F.col(f) * float(w) for f, w in zip(self.features, self.weights[:, j]))
            for j, name in enumerate(self.names)})

    def table(self, spark) -> DataFrame:
        rows = [(f, n, float(self.loadings[i, j]))
                for i, f in enumerate(self.features) for j, n in enumerate(self.names)]
        return spark.createDataFrame(rows, "feature string, component string, loading double")


def _oriented(matrix: np.ndarray) -> np.ndarray:
    """Fix each column's sign: its largest loading is positive."""
    top = matrix[np.abs(matrix).argmax(axis=0), range(matrix.shape[1])]
    return matrix * np.where(top < 0, -1.0, 1.0)


def _names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i + 1}" for i in range(k)]


def fit_pca(df: DataFrame, features: list[str], k: int) -> Projection:
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(assemble(df, features, []))
    matrix = _oriented(model.pc.toArray())
    return Projection(features, _names("PC", k), matrix, matrix, model.explainedVariance.toArray())


def varimax(loadings: np.ndarray, sweeps: int = 100, smallest: float = 1e-7) -> np.ndarray:
    """Orthogonal rotation that makes the variance of squared loadings within factors largest.

    Planar rotations, one pair of factors at a time: in a plane the criterion is a cosine
    of four times the angle, so its best angle is known in closed form. Sweeps over all
    pairs end when no pair turns by more than ``smallest``; they stop early only then.
    """
    out = np.array(loadings, float)
    p, k = out.shape
    for _ in range(sweeps):
        largest = 0.0
        for i in range(k):
            for j in range(i + 1, k):
                x, y = out[:, i], out[:, j]
                real, imaginary = x * x - y * y, 2 * x * y
                up = 2 * (real @ imaginary) - 2 * real.sum() * imaginary.sum() / p
                across = real @ real - imaginary @ imaginary - (real.sum() ** 2 - imaginary.sum() ** 2) / p
                angle = np.arctan2(up, across) / 4
                out[:, i], out[:, j] = np.cos(angle) * x + np.sin(angle) * y, np.cos(angle) * y - np.sin(angle) * x
                largest = max(largest, abs(angle))
        if largest <= smallest:
            return out
    raise ArithmeticError(f"varimax still turns by {largest} after {sweeps} sweeps")


def fit_varimax(df: DataFrame, features: list[str], k: int) -> Projection:
    matrix = _oriented(varimax(fit_pca(df, features, k).loadings))
    return Projection(features, _names("VM", k), matrix, matrix)


def factors(r: np.ndarray, k: int, rounds: int = 1000, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and score weights of maximum-likelihood factors by EM on a covariance matrix."""
    size = np.diag(r)
    values, vectors = np.linalg.eigh(r)
    lead = np.argsort(values)[::-1][:k]
    load = vectors[:, lead] * np.sqrt(np.maximum(values[lead], 1e-6))
    noise = np.maximum(0.5 * size, 1e-9)
    previous = -np.inf
    for _ in range(rounds):
        model = load @ load.T + np.diag(noise)
        score = np.linalg.solve(model, load).T
        second = np.eye(k) - score @ load + score @ r @ score.T
        load = np.linalg.solve(second, score @ r).T
        noise = np.maximum(np.diag(r - load @ score @ r), np.maximum(1e-3 * size, 1e-9))
        fit = -np.linalg.slogdet(model)[1] - np.trace(np.linalg.solve(model, r))
        if abs(fit - previous) < tolerance:
            break
        previous = fit
    load = _oriented(load)
    return load, np.linalg.solve(load @ load.T + np.diag(noise), load)


def fit_factors(df: DataFrame, features: list[str], k: int, rounds: int = 1000,
                tolerance: float = 1e-8) -> Projection:
    """Maximum-likelihood factors of standardised features, one pass over the data."""
    k = min(k, len(features) - 1)
    load, weights = factors(correlation_matrix(df, features), k, rounds, tolerance)
    return Projection(features, _names("FA", k), weights, load, (load ** 2).sum(axis=0) / len(features))


def fit_ica(df: DataFrame, features: list[str], k: int, rounds: int = 500,
            tolerance: float = 1e-4) -> Projection:
    """Independent components: PCA whitening, then fixed-point steps (log cosh).

    Each step is one pass: every batch returns a k x k sum, Spark adds them up. ``df``
    is read once per step, so pass a written table.
    """
    pca = fit_pca(df, features, k)
    r = correlation_matrix(df, features)
    spread = np.sqrt(np.maximum(np.diag(pca.weights.T @ r @ pca.weights), 1e-12))
    white = pca.weights / spread
    names = _names("W", k)
    data = Projection(features, names, white, white).apply(df).select(*names)
    rows = data.count()
    unmix = np.linalg.qr(np.random.default_rng(C.BASE_SEED).normal(size=(k, k)))[0]
    for _ in range(rounds):
        sums = _contrast_sums(data, names, unmix)
        step = sums[:, :k] / rows - (sums[:, k] / rows)[:, None] * unmix
        u, _, vt = np.linalg.svd(step)
        turned = u @ vt
        change = np.max(np.abs(np.abs((turned * unmix).sum(axis=1)) - 1.0))
        unmix = turned
        if change < tolerance:
            break
    else:
        warnings.warn(f"components still move by {change} after {rounds} steps", RuntimeWarning, stacklevel=2)
    weights = _oriented(white @ unmix.T)
    return Projection(features, _names("IC", k), weights, r @ weights)


def _contrast_sums(data: DataFrame, names: list[str], unmix: np.ndarray) -> np.ndarray:
    """Sums over rows of g(w z) z' and g'(w z), one line per component."""
    k = len(names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            z = batch[names].to_numpy(float)
            g = np.tanh(z @ unmix.T)
            total[:, :k] += g.T @ z
            total[:, k] += (1.0 - g ** 2).sum(axis=0)
        yield pd.DataFrame({"i": range(k), "v": list(total)})

    parts = data.mapInPandas(partial, "i int, v array<double>")
    summed = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(k + 1)])
    frame = summed.orderBy("i").toPandas()
    return frame[[f"s{j}" for j in range(k + 1)]].to_numpy(float)


@dataclass
class Discriminant:
    """Two-class linear discriminant: score, probability and axis."""

    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def apply(self, df: DataFrame, score: str = "lda", probability: str | None = None) -> DataFrame:
        raw = X.total(F.col(f) * float(c) for f, c in zip(self.features, self.coefficients))
        out = df.withColumn(score, raw + self.intercept)
        if probability is None:
            return out
        return out.withColumn(probability, 1 / (1 + F.exp(-F.col(score))))


def discriminant_direction(total: np.ndarray, sizes: dict[int, float],
                           means: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients that part two classes, and the pooled covariance within them.

    ``total`` is the covariance of all rows and ``means`` are taken from their mean. A
    feature without variance is left out; so is everything when there is one class.
    """
    size = sum(sizes.values())
    between = sum(sizes[c] / size * np.outer(m, m) for c, m in means.items())
    constant = [i for i in range(len(total)) if not np.any(np.delete(total[i], i)) and all(m[i] == 0 for m in means.values())]
    within = (total - between) * size / max(size - 2, 1)
    within[constant, constant] = 0.0
    if len(means) < 2:
        return np.zeros(len(total)), within
    return np.linalg.pinv(within, rcond=1e-8, hermitian=True) @ (means[1] - means[0]), within


def fit_discriminant(df: DataFrame, features: list[str], y: str) -> Discriminant:
    """Pooled within-class covariance = total minus between, from two small aggregates.

    ``features`` must be standardised on ``df``, so the total is the correlation matrix.
    """
    total = correlation_matrix(df, features)
    rows = df.groupBy(y).agg(
        F.count("*").alias("n"), F.array(*[F.avg(f) for f in features]).alias("m")).collect()
    size = sum(row.n for row in rows)
    means = {row[y]: np.asarray(row.m) for row in rows}
    share = {row[y]: row.n / size for row in rows}
    if len(means) < 2:
        return Discriminant(features, np.zeros(len(features)), 0.0)
    coefficients, _ = discriminant_direction(total, {c: share[c] * size for c in means}, means)
    middle = float((means[1] + means[0]) @ coefficients) / 2
    return Discriminant(features, coefficients, np.log(share[1] / share[0]) - middle)


def scree(spark, projection: Projection) -> DataFrame:
    """Variance share, running total and dominant construct per component."""
    shares = projection.variance
    rows = [(i + 1, n, float(shares[i]), float(shares[:i + 1].sum()))
            for i, n in enumerate(projection.names)]
    table = spark.createDataFrame(
        rows, "position int, component string, variance double, cumulative double")
    from cohortry.operators.classify import construct_column

    strength = projection.table(spark).groupBy("component", construct_column().alias("construct")).agg(
        F.sum(F.col("loading") * F.col("loading")).alias("s"))
    top = strength.groupBy("component").agg(
        F.max_by("construct", F.struct("s", "construct")).alias("dominant_construct"))
    return table.join(top, "component")


def top_loadings(spark, projection: Projection, count: int = 10) -> DataFrame:
    """Features with the largest squared loading on the first two components."""
    table = projection.table(spark).filter(F.col("component").isin(projection.names[:2]))
    size = F.sqrt(F.sum(F.col("loading") * F.col("loading")))
    return table.groupBy("feature").agg(F.round(size, 6).alias("magnitude")).orderBy(
        F.desc("magnitude"), "feature").limit(count)
