"""Experiment grids over feature sets, weightings, rotations and methods, fitted side by side.

All spaces of an experiment are matrices on one written vector per user, so that a grid of
hundreds of cells takes as many passes over the users as its slowest fit takes steps. What
only needs moments (components, factors, discriminants) comes from one covariance matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cohortry import config as C
from cohortry.operators import batched as B
from cohortry.operators.cluster import ward_levels
from cohortry.operators.mlprep import compress_volume, filled, standardize, weights
from cohortry.operators.ranks import percent_rank_average
from cohortry.operators.rotate import _oriented, discriminant_direction, factors, varimax

QUALITY = ("n_clusters long, silhouette_squared double, calinski_harabasz double, "
           "davies_bouldin double, cramers_v double, composite_score double, n_noise long")
TOTALS = "n_users double, n_persistent double, within_ss double, between_ss double, total_ss double"
RESTARTS, MIXTURE_STARTS, MICRO = 10, 5, 200
COMPRESSIONS = ["none", "log", "sqrt", "rank", "winsor"]


@dataclass
class Vectors:
    """Written vectors of standardised features with their moments."""

    rows: DataFrame
    names: list[str]
    moments: B.Moments

    def pick(self, features: list[str], weight: dict[str, float] | None = None) -> np.ndarray:
        """The space of some features, each times its weight."""
        out = np.zeros((len(self.names), len(features)))
        for j, f in enumerate(features):
            out[self.names.index(f), j] = 1.0 if weight is None else weight[f]
        return out


def standard_rows(df: DataFrame, features: list[str], y: str = "persist_median", key: str = "USER_ID",
                  row_weights: list[Column] | None = None) -> DataFrame:
    """Vectors of ``features``, nulls as zero, zero mean and unit deviation over all rows; to be written."""
    return B.vector_rows(standardize(df, features), features, y, key, row_weights)


def vectors_of(rows: DataFrame, features: list[str]) -> Vectors:
    return Vectors(rows, list(features), B.moments(rows)[0])


def with_compressions(df: DataFrame, features: list[str], key: str = "USER_ID") -> DataFrame:
    """``df`` with each volume feature also compressed, as ``feature~method``."""
    volume = [f for f in features if C.construct_of(f) == "Volume"]
    out = df.withColumns({f: filled(f) for f in features})
    for method in ("log", "sqrt", "winsor"):
        squeezed = compress_volume(out.select(key, *volume), volume, method)
        out = out.join(squeezed.select(key, *[F.col(f).alias(f"{f}~{method}") for f in volume]), key)
    ranks = percent_rank_average(out.select(key, *volume), key, volume)
    return out.join(ranks.select(key, *[F.col(f).alias(f"{f}~rank") for f in volume]), key)


# --- spaces -------------------------------------------------------------------------------


def leading(cov: np.ndarray, count: int) -> np.ndarray:
    """Directions of the largest variance."""
    values, vectors = np.linalg.eigh(cov)
    return _oriented(vectors[:, np.argsort(values)[::-1][:count]])


def independent(vectors: Vectors, spaces: list[np.ndarray], counts: list[int], rounds: int = 500,
                tolerance: float = 1e-4, seed: int = C.BASE_SEED) -> list[tuple[np.ndarray, bool]]:
    """Independent components of each space and whether they settled; one pass a step for all."""
    white, unmix = [], []
    for space, count in zip(spaces, counts):
        cov = space.T @ vectors.moments.cov @ space
        lead = leading(cov, count)
        white.append(space @ (lead / np.sqrt(np.maximum(np.diag(lead.T @ cov @ lead), 1e-12))))
        unmix.append(np.linalg.qr(np.random.default_rng(seed).normal(size=(count, count)))[0])
    settled, tasks = [False] * len(spaces), vectors.rows.rdd.getNumPartitions()
    for _ in range(rounds):
        moving = [i for i, done in enumerate(settled) if not done]
        if not moving:
            break
        now = [unmix[i] for i in moving]

        def step(z, y, w, moving=moving, now=now):
            for i, u in zip(moving, now):
                x = z @ white[i]
                g = np.tanh(x @ u.T)
                yield i, np.concatenate([(g.T @ x).ravel(), (1.0 - g * g).sum(axis=0)])

        found = B.summed(vectors.rows, step, most=tasks * sum(len(u) * (len(u) + 1) for u in now))
        for i in moving:
            k, u = len(unmix[i]), unmix[i]
            sums, slopes = found[i][:k * k].reshape(k, k), found[i][k * k:]
            left, _, right = np.linalg.svd(sums / vectors.moments.n - (slopes / vectors.moments.n)[:, None] * u)
            turned = left @ right
            settled[i] = bool(np.max(np.abs(np.abs((turned * u).sum(axis=1)) - 1.0)) < tolerance)
            unmix[i] = turned
    return [(_oriented(w @ u.T), done) for w, u, done in zip(white, unmix, settled)]


def rotation(cov: np.ndarray, method: str, count: int) -> np.ndarray:
    """Matrix of a rotation that the covariance determines."""
    if method == "pca":
        return leading(cov, count)
    if method == "pca_varimax":
        return _oriented(varimax(leading(cov, count)))
    if method == "factor_analysis":
        return factors(cov, min(count, len(cov) - 1))[1]
    if method == "none":
        return np.eye(len(cov))
    raise ValueError(f"unknown rotation {method!r}")


def guided(moments: B.Moments, space: np.ndarray, components: int) -> np.ndarray:
    """Leading components next to the discriminant of the outcome, at unit variance within classes."""
    cov = space.T @ moments.cov @ space
    sizes = {c: n for c, (n, _) in moments.classes.items() if n > 0}
    means = {c: (moments.classes[c][1] - moments.mean) @ space for c in sizes}
    axis, within = discriminant_direction(cov, sizes, means)
    spread = np.sqrt(max(float(axis @ within @ axis), 0.0))
    return space @ np.column_stack([leading(cov, components), axis / spread if spread > 0 else axis])


# --- cells --------------------------------------------------------------------------------


@dataclass
class Cell:
    """One row of an experiment: its describing values, space, method and cluster count."""

    keys: tuple
    space: int
    method: str
    k: int
    weight: int | None = None


def fit_cells(rows: DataFrame, spaces: list[np.ndarray], cells: list[Cell], restarts: int = RESTARTS,
              mixture_starts: int = MIXTURE_STARTS, micro: int = MICRO) -> list[B.Solution]:
    """The solution of every cell; cells with equal space, method, k and weight share one."""
    wanted = {(c.space, c.k, c.weight): 0 for c in cells if c.method != "agglomerative"}
    for c in cells:
        if c.method != "agglomerative":
            at = c.space, c.k, c.weight
            wanted[at] = max(wanted[at], restarts if c.method == "kmeans" else min(restarts, mixture_starts))
    starts = [B.KMeansFit(s, k, w, i) for (s, k, w), n in wanted.items() for i in range(n)]
    stages = {(c.space, c.weight): B.KMeansFit(c.space, micro, c.weight) for c in cells if c.method == "agglomerative"}
    B.kmeans(rows, spaces, starts + list(stages.values()))
    solved: dict[tuple, B.Solution] = {}
    for at, fit in B.best_of(starts).items():
        solved[("kmeans", *at)] = B.Solution.of(fit)
    for (space, weight), stage in stages.items():
        used = np.flatnonzero(stage.sizes > 0)
        ks = sorted({c.k for c in cells if (c.method, c.space, c.weight) == ("agglomerative", space, weight)})
        levels = ward_levels(stage.centres[used], stage.sizes[used], [min(k, len(used)) for k in ks])
        for k in ks:
            solved[("agglomerative", space, k, weight)] = B.Solution(
                space, k, weight, stage.centres[used], levels[min(k, len(used))])
    mixed = {(c.space, c.k, c.weight) for c in cells if c.method == "gmm"}
    fits = B.mixtures(rows, spaces, [B.MixtureFit(f.space, f.k, f.weight, f.start, f.centres) for f in starts
                                     if (f.space, f.k, f.weight) in mixed and f.start < mixture_starts])
    for fit in sorted(fits, key=lambda f: (f.likelihood, -f.start)):  # the last, most likely one stays
        solved[("gmm", fit.space, fit.k, fit.weight)] = B.Solution.of(fit)
    return [solved[(c.method, c.space, c.k, c.weight)] for c in cells]


def run_cells(vectors: Vectors, spaces: list[np.ndarray], cells: list[Cell], schema: str, **starts) -> DataFrame:
    """A result row for every cell: its keys, method, k, quality and sums of squares."""
    solutions = fit_cells(vectors.rows, spaces, cells, **starts)
    unique = {id(s): s for s in solutions}
    found = dict(zip(unique, B.evaluate(vectors.rows, spaces, list(unique.values()))))
    rows = []
    for cell, solution in zip(cells, solutions):
        q = found[id(solution)]
        rows.append((*cell.keys, cell.method, cell.k, *q.row, float(q.sizes.sum()), float(q.hits.sum()), q.within, q.between, q.total))
    return vectors.rows.sparkSession.createDataFrame(rows, f"{schema}, method string, k int, {QUALITY}, {TOTALS}")


def clustering_grid(vectors: Vectors, sets: dict[str, list[str]], weightings: list[str] = C.WEIGHTINGS,
                    methods: tuple[str, ...] = ("kmeans", "gmm", "agglomerative"),
                    ks: tuple[int, ...] = tuple(C.CLUSTER_K), **starts) -> DataFrame:
    """Every feature set, weighting, method and k."""
    spaces, cells = [], []
    for name, features in sets.items():
        for weighting in weightings:
            spaces.append(vectors.pick(features, weights(features, weighting)))
            cells += [Cell((name, weighting), len(spaces) - 1, m, k) for m in methods for k in ks]
    return run_cells(vectors, spaces, cells, "feature_set string, weighting string", **starts)


def rotation_experiment(vectors: Vectors, chosen: dict[str, tuple[list[str], str]],
                        rotations: tuple[str, ...] = ("pca", "ica", "factor_analysis", "pca_varimax", "none"),
                        components: tuple[int, ...] = (5, 7, 10), methods: tuple[str, ...] = ("kmeans", "gmm"),
                        ks: tuple[int, ...] = (4, 5, 6), **starts) -> DataFrame:
    """Every rotation and number of components of each chosen (features, weighting).

    Without a rotation the number of components changes nothing; its cells share one fit.
    """
    spaces, cells, waiting = [], [], []
    for name, (features, weighting) in chosen.items():
        base = vectors.pick(features, weights(features, weighting))
        cov = base.T @ vectors.moments.cov @ base
        for method in rotations:
            for count in (c for c in components if c <= len(features)):
                if method == "ica":
                    waiting.append((len(spaces), base, count))
                    spaces.append(base)
                elif method != "none" or count == min(components):
                    spaces.append(base @ rotation(cov, method, count))
                cells += [Cell((name, weighting, method, count), len(spaces) - 1, m, k) for m in methods for k in ks]
    for (at, _, _), (space, _) in zip(waiting, independent(vectors, [b for _, b, _ in waiting], [c for *_, c in waiting])):
        spaces[at] = space
    return run_cells(vectors, spaces, cells, "feature_set string, weighting string, rotation string, n_components int", **starts)


def guided_experiment(vectors: Vectors, sets: dict[str, list[str]], components: tuple[int, ...] = (3, 4, 5, 6),
                      methods: tuple[str, ...] = ("kmeans", "gmm"), ks: tuple[int, ...] = (4, 5, 6), **starts) -> DataFrame:
    """Components and the discriminant of the outcome, for each feature set."""
    spaces, cells = [], []
    for name, features in sets.items():
        for count in components:
            spaces.append(guided(vectors.moments, vectors.pick(features), count))
            cells += [Cell((name, count), len(spaces) - 1, m, k) for m in methods for k in ks]
    return run_cells(vectors, spaces, cells, "feature_set string, n_components int", **starts)


def compression_experiment(vectors: Vectors, features: list[str], compressions: list[str] = COMPRESSIONS,
                           weightings: tuple[str, ...] = ("uniform", "equal_construct", "downweight_volume"),
                           methods: tuple[str, ...] = ("kmeans", "gmm"), ks: tuple[int, ...] = (4, 5, 6), **starts) -> DataFrame:
    """Each compression of the volume features under each weighting.

    ``vectors`` holds the compressed features as ``with_compressions`` names them.
    """
    spaces, cells = [], []
    for compression in compressions:
        named = {f: f if compression == "none" or C.construct_of(f) != "Volume" else f"{f}~{compression}" for f in features}
        for weighting in weightings:
            weight = weights(features, weighting)
            spaces.append(vectors.pick(list(named.values()), {named[f]: weight[f] for f in features}))
            cells += [Cell((compression, weighting), len(spaces) - 1, m, k) for m in methods for k in ks]
    return run_cells(vectors, spaces, cells, "compression string, weighting string", **starts)


# --- named solutions ----------------------------------------------------------------------


def _shrunk(moments: B.Moments, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``space`` scaled to unit deviation under ``moments``, and its covariance."""
    spread = np.sqrt(np.maximum(np.diag(space.T @ moments.cov @ space), 0.0))
    own = space / np.where(spread > 1e-12, spread, 1.0)
    return own, own.T @ moments.cov @ own


def solution_a(vectors: Vectors, moments: B.Moments) -> np.ndarray:
    """Five factors of the reduced-volume set."""
    own, cov = _shrunk(moments, vectors.pick(C.FEATURE_SETS["volume_reduced"]))
    return own @ rotation(cov, "factor_analysis", 5)


def solution_b(vectors: Vectors, moments: B.Moments) -> np.ndarray:
    """Three components and the discriminant of the reduced-volume set."""
    return guided(moments, _shrunk(moments, vectors.pick(C.FEATURE_SETS["volume_reduced"]))[0], 3)


def solution_c(vectors: Vectors, moments: B.Moments) -> np.ndarray:
    """Seven components of the behavioural set."""
    own, cov = _shrunk(moments, vectors.pick(C.FEATURE_SETS["behavioral_only"]))
    return own @ leading(cov, 7)


def tier_reference(vectors: Vectors, moments: B.Moments) -> np.ndarray:
    """The second component of the biplot features, on which tiers are cut."""
    own, cov = _shrunk(moments, vectors.pick(C.PCA_FEATURES))
    return own @ leading(cov, 2)[:, 1:]


#: name -> (space of a population's moments, method)
SOLUTIONS: dict[str, tuple[Callable, str]] = {
    "A_FA5_KM": (solution_a, "kmeans"), "B_PCA3_LDA1_KM": (solution_b, "kmeans"),
    "C_PCA7_GMM": (solution_c, "gmm"), "T_PC2_tiers": (tier_reference, "kmeans")}
SOLUTION_FEATURES = list(dict.fromkeys(
    C.FEATURE_SETS["volume_reduced"] + C.FEATURE_SETS["behavioral_only"] + C.PCA_FEATURES))


def named_cells(vectors: Vectors, ks: tuple[int, ...] = (5, 6), moments: B.Moments | None = None,
                weight: int | None = None) -> tuple[list[np.ndarray], list[Cell]]:
    """Spaces and cells of all named solutions under the moments of some rows."""
    spaces, cells = [], []
    for name, (space, method) in SOLUTIONS.items():
        spaces.append(space(vectors, moments or vectors.moments))
        cells += [Cell((name,), len(spaces) - 1, method, k, weight) for k in ks]
    return spaces, cells


def named_solutions(vectors: Vectors, ks: tuple[int, ...] = (5, 6), **starts) -> tuple[DataFrame, DataFrame, list[str]]:
    """Quality of every named solution, and (key, y, one label column each).

    Tiers are numbered along their axis; other clusters from the largest down.
    """
    spaces, cells = named_cells(vectors, ks)
    solutions = fit_cells(vectors.rows, spaces, cells, **starts)
    quality = B.evaluate(vectors.rows, spaces, solutions)
    rows, placed = [], {}
    for cell, solution, q in zip(cells, solutions, quality):
        order = np.argsort(q.centres[:, 0]) if cell.keys[0].startswith("T_") else np.argsort(-q.sizes, kind="stable")
        number = np.empty(len(order), int)
        number[order] = np.arange(len(order))
        if solution.mixture:
            share, means, white, det = solution.mixture
            named = B.Solution(solution.space, solution.k, mixture=(share[order], means[order], white[order], det[order]))
        else:
            named = B.Solution(solution.space, solution.k, centres=solution.centres[order])
        placed[f"{cell.keys[0]}_k{cell.k}"] = named
        rows.append((*cell.keys, cell.method, cell.k, *q.row, int(((q.sizes > 0) & (q.sizes < 20)).sum()),
                     float(q.sizes.sum()), float(q.hits.sum()), q.within, q.between, q.total))
    table = vectors.rows.sparkSession.createDataFrame(
        rows, f"solution string, method string, k int, {QUALITY}, n_degenerate int, {TOTALS}")
    return table, B.place(vectors.rows, spaces, placed), list(placed)


def bootstrap_stability(vectors: Vectors, rounds: int, ks: tuple[int, ...] = (5, 6), **starts) -> DataFrame:
    """Every named solution refitted on each resample, space and clusters alike.

    ``vectors`` has one weight column a resample. Silhouette and V are those of the
    resample; agreement between resamples is measured on the same users, all of them.
    """
    spaces, cells = [], []
    for b, moments in enumerate(B.moments(vectors.rows, list(range(rounds)))):
        own, found = named_cells(vectors, ks, moments, b)
        for c in found:
            c.space += len(spaces)
        spaces += own
        cells += found
    solutions = fit_cells(vectors.rows, spaces, cells, **starts)
    quality = B.evaluate(vectors.rows, spaces, solutions)
    rows = []
    for name, (_, method) in SOLUTIONS.items():
        for k in ks:
            at = [i for i, c in enumerate(cells) if c.keys == (name,) and c.k == k]
            same = B.agreement(vectors.rows, spaces, [solutions[i] for i in at])
            measures = [same[np.triu_indices(len(at), 1)], np.array([quality[i].silhouette for i in at]),
                        np.array([quality[i].cramers_v for i in at])]
            rows.append((name, method, k, len(at), *(float(f(m)) for m in measures for f in (np.mean, np.std))))
    return vectors.rows.sparkSession.createDataFrame(
        rows, "solution string, method string, k int, bootstraps int, mean_ari double, std_ari double, "
              "mean_silhouette double, std_silhouette double, mean_cramers_v double, std_cramers_v double")
