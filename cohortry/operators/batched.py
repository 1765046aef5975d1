"""Many clustering fits at once: one pass over the rows advances every fit by one step.

A fit lives in a space, and every space is a matrix on one written vector of standardised
features: weightings are its diagonal, rotations its columns. A task multiplies a batch of
rows by each space's matrix once, measures all centres of that space with one product, and
folds the batch into sums per centre. What leaves a task is those sums, whatever its rows;
they are added up by part over the shuffle, one arriving row at a time, and only the sums of
centres (fits x k x dimensions) reach the driver. Fits that have settled leave the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cohortry import config as C
from cohortry.operators.ranks import hash_key
from cohortry.operators.sampling import simple_sample
from cohortry.session import materialize

#: Rows that starting centres are drawn from; every later step sees all rows.
SEED_ROWS = 2000
#: Rows a task multiplies at once.
STEP_ROWS = 8192
#: Rows whose distances or densities are worked out at once, and the rounding that a row's log density may show.
CACHED_ROWS, ROUNDING = 1024, 1e-6
#: Centres from which on a set's rows are summed by label; fewer are summed by one product.
MANY_CENTRES = 33
#: Bytes of all tasks' sums up to which they are added on the driver, without a shuffle.
DIRECT_BYTES = 16 << 20


def vector_rows(df: DataFrame, features: list[str], y: str = "persist_median", key: str = "USER_ID",
                weights: list[Column] | None = None) -> DataFrame:
    """Rows (key, z, y, w): the vector, the outcome, and optional columns of weights. Write them before fitting.

    Vectors are few bytes for much work, so they are dealt to as many partitions as the
    cluster has cores, not to as many as their bytes would fill: of more files some would be
    read together, one task more than there are cores, and each pass would wait for it.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    z = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    w = F.array(*[c.cast("double") for c in weights or []]).cast("array<double>")
    return df.select(F.col(key).alias("key"), z.alias("z"), F.col(y).cast("double").alias("y"), w.alias("w")).repartition(tasks)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1) if len(values) else np.zeros((rows, 0))


def summed(rows: DataFrame, step: Callable, add: Callable = np.add, most: int | None = None) -> dict[int, np.ndarray]:
    """Sum over all rows of the arrays that ``step(z, y, w)`` yields as (part, array).

    ``most`` is the number of values that all tasks yield together. If it is given and they
    take few bytes, they are added on the driver: half the time of a pass over few rows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                b = batch.slice(at, STEP_ROWS)
                z, w = _matrix(b.column("z"), b.num_rows), _matrix(b.column("w"), b.num_rows)
                y = b.column("y").to_numpy(zero_copy_only=False)
                for part, value in step(z, y, w):
                    if part in totals:
                        add(totals[part], value, out=totals[part])
                    else:
                        totals[part] = np.array(value, float)
        yield from _packed(totals)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, value in zip(batch.column("part").to_pylist(), batch.column("payload")):
                value = np.frombuffer(value.as_buffer(), np.float64)
                if part in totals:
                    add(totals[part], value, out=totals[part])
                else:
                    totals[part] = value.copy()
        yield from _packed(totals)

    schema = "part int, payload binary"
    parts = rows.select("z", "y", "w").mapInArrow(partial, schema)
    if most is not None and 8 * most <= DIRECT_BYTES:
        sums: dict[int, np.ndarray] = {}
        for r in parts.collect():
            value = np.frombuffer(r.payload, np.float64)
            sums[r.part] = add(sums[r.part], value) if r.part in sums else value
        return sums
    return {r.part: np.frombuffer(r.payload, np.float64) for r in
            parts.repartition("part").mapInArrow(merge, schema).collect()}


def _packed(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for part, value in totals.items():
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([np.ascontiguousarray(value).tobytes()], pa.binary())],
                              names=["part", "payload"])


def _weight(w: np.ndarray, column: int | None, n: int) -> np.ndarray:
    return np.ones(n) if column is None else w[:, column]


@dataclass
class Moments:
    """Size, mean and covariance (n) of the vectors, and the same for each class of y."""

    n: float
    mean: np.ndarray
    cov: np.ndarray
    classes: dict[int, tuple[float, np.ndarray]]


def moments(rows: DataFrame, weights: list[int | None] | None = None) -> list[Moments]:
    """Moments under each column of weights, in one pass."""
    weights = weights or [None]

    def step(z, y, w):
        for part, column in enumerate(weights):
            v = _weight(w, column, len(z))
            full = np.column_stack([np.ones(len(z)), z])
            one = full * (v * (y == 1))[:, None]
            yield part, np.concatenate([(full.T @ (full * v[:, None])).ravel(), one.sum(axis=0)])

    found, out = summed(rows, step), []
    for part in range(len(weights)):
        p = int((np.sqrt(1 + 4 * len(found[part])) - 1) / 2)
        total, one = found[part][:p * p].reshape(p, p), found[part][p * p:]
        n, n1 = total[0, 0], one[0]
        mean = total[0, 1:] / n
        classes = {1: (n1, one[1:] / max(n1, 1e-300)), 0: (n - n1, (total[0, 1:] - one[1:]) / max(n - n1, 1e-300))}
        out.append(Moments(n, mean, total[1:, 1:] / n - np.outer(mean, mean), classes))
    return out


# --- k-means ------------------------------------------------------------------------------


@dataclass
class KMeansFit:
    """One fit: its space, cluster count and weight column; centres are found later."""

    space: int
    k: int
    weight: int | None = None
    start: int = 0
    centres: np.ndarray | None = None
    cost: float = np.inf
    sizes: np.ndarray | None = None
    rounds: int = 0
    settled: bool = False


def _seeded(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centres, each drawn in proportion to its squared distance from those before."""
    p = weights / weights.sum()
    chosen = [points[rng.choice(len(points), p=p)]]
    nearest = ((points - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        mass = nearest * weights
        total = mass.sum()
        chosen.append(points[rng.choice(len(points), p=mass / total if total > 0 else p)])
        nearest = np.minimum(nearest, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def seed_centres(rows: DataFrame, spaces: list[np.ndarray], fits: list[KMeansFit], seed: int = C.BASE_SEED) -> None:
    """Starting centres of all fits, from the rows with the smallest hashed keys."""
    sample = simple_sample(rows, SEED_ROWS, key="key").select("key", "z", "w").toPandas().sort_values("key")
    z = np.stack(sample["z"].to_numpy())
    w = np.stack(sample["w"].to_numpy()) if len(sample["w"].iloc[0]) else np.zeros((len(z), 0))
    placed: dict[int, np.ndarray] = {}
    for fit in fits:
        if fit.space not in placed:
            placed[fit.space] = z @ spaces[fit.space]
        weight = _weight(w, fit.weight, len(z))
        weight = weight if weight.sum() > 0 else np.ones(len(z))
        fit.centres = _seeded(placed[fit.space], weight, fit.k, np.random.default_rng([seed, fit.k, fit.start]))


def _nearest(x: np.ndarray, members: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(id, label, squared distance up to |x|^2) for each set of centres, by one product."""
    stacked = np.vstack([c for _, c in members])
    far = x @ (-2.0 * stacked.T)
    far += (stacked ** 2).sum(axis=1)
    at = 0
    for i, c in members:
        part = far[:, at:at + len(c)]
        label = part.argmin(axis=1)
        yield i, label, part[np.arange(len(x)), label]
        at += len(c)


def _runs(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(first, end, size) of each run of equal sizes."""
    starts = [i for i, n in enumerate(sizes) if not i or n != sizes[i - 1]]
    return [(a, b, sizes[a]) for a, b in zip(starts, starts[1:] + [len(sizes)])]


def _centre_sums(x: np.ndarray, weight: np.ndarray, centres: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values and weights of the rows nearest to each centre, and the cost of each set of centres.

    Few rows at a time, one line a centre, so that distances stay in the cache. Sets of equal
    size are compared together; a row as near to several centres belongs to the first.
    """
    ends = np.cumsum([0] + [len(c) for c in centres])
    full = np.column_stack([x, np.ones(len(x))])
    weighted, width = full * weight[:, None], x.shape[1] + 1
    sums, costs = np.zeros((ends[-1], width)), np.full(len(centres), float(weight @ (x * x).sum(axis=1)))
    few = [j for j in sorted(range(len(centres)), key=lambda j: len(centres[j])) if len(centres[j]) < MANY_CENTRES]
    if few:
        lines = np.vstack([np.column_stack([-2.0 * centres[j], (centres[j] ** 2).sum(axis=1)]) for j in few])
        at, runs = 0, []
        for a, b, k in _runs([len(centres[j]) for j in few]):
            runs.append((few[a:b], slice(at, at + (b - a) * k), k))
            at += (b - a) * k
        total = np.zeros((len(lines), width))
        for start in range(0, len(x), CACHED_ROWS):
            part, own = full[start:start + CACHED_ROWS], weight[start:start + CACHED_ROWS]
            far = lines @ part.T
            near = np.empty(far.shape, bool)
            for sets, span, k in runs:
                mine, own_near = far[span].reshape(len(sets), k, -1), near[span].reshape(len(sets), k, -1)
                best = mine.min(axis=1)
                np.equal(mine, best[:, None], out=own_near)
                if np.count_nonzero(own_near) != best.size:
                    np.equal(own_near.argmax(axis=1)[:, None], np.arange(k)[:, None], out=own_near)
                costs[sets] += best @ own
            total += near.astype(float) @ weighted[start:start + CACHED_ROWS]
        for sets, span, k in runs:
            for j, held in zip(sets, total[span].reshape(len(sets), k, width)):
                sums[ends[j]:ends[j + 1]] = held
    for j in (j for j, c in enumerate(centres) if len(c) >= MANY_CENTRES):
        lines = np.column_stack([-2.0 * centres[j], (centres[j] ** 2).sum(axis=1)]).T
        for start in range(0, len(x), CACHED_ROWS):
            part = slice(start, start + CACHED_ROWS)
            far = full[part] @ lines
            label = far.argmin(axis=1)
            costs[j] += float(weight[part] @ far[np.arange(len(far)), label])
            place = (label[:, None] * width + np.arange(width)).ravel()
            sums[ends[j]:ends[j + 1]] += np.bincount(place, weighted[part].ravel(), lines.shape[1] * width).reshape(-1, width)
    return sums, costs


def kmeans(rows: DataFrame, spaces: list[np.ndarray], fits: list[KMeansFit], rounds: int = 100,
           tolerance: float = 1e-4, seed: int = C.BASE_SEED) -> list[KMeansFit]:
    """Lloyd's steps for all fits side by side until each moves less than ``tolerance``.

    The move is the summed squared shift of the centres over the mean variance of the
    space; a centre that loses all rows stays where it is.
    """
    for fit in fits:
        if fit.centres is None:
            seed_centres(rows, spaces, [f for f in fits if f.centres is None], seed)
            break
    cov = moments(rows)[0].cov
    scale = [float(np.trace(s.T @ cov @ s)) / s.shape[1] for s in spaces]
    tasks = rows.rdd.getNumPartitions()
    for _ in range(rounds):
        moving = [i for i, f in enumerate(fits) if not f.settled]
        if not moving:
            break
        groups: dict[tuple[int, int | None], list[tuple[int, np.ndarray]]] = {}
        for i in moving:
            groups.setdefault((fits[i].space, fits[i].weight), []).append((i, fits[i].centres))
        listed = list(groups.items())

        def step(z, y, w, listed=listed):
            for part, ((space, column), members) in enumerate(listed):
                sums, costs = _centre_sums(z @ spaces[space], _weight(w, column, len(z)), [c for _, c in members])
                yield part, np.concatenate([sums[:, :-1].ravel(), sums[:, -1], costs])

        found = summed(rows, step, most=tasks * sum(fits[i].k * (spaces[fits[i].space].shape[1] + 1) + 1 for i in moving))
        for part, ((space, _), members) in enumerate(listed):
            d, many = spaces[space].shape[1], sum(len(c) for _, c in members)
            sums, sizes = found[part][:many * d].reshape(many, d), found[part][many * d:many * (d + 1)]
            at = 0
            for j, (i, c) in enumerate(members):
                n = sizes[at:at + len(c)]
                new = np.where(n[:, None] > 0, sums[at:at + len(c)] / np.maximum(n, 1e-300)[:, None], c)
                fit = fits[i]
                fit.sizes = n
                fit.cost, fit.rounds = max(float(found[part][many * (d + 1) + j]), 0.0), fit.rounds + 1
                fit.settled = float(((new - c) ** 2).sum()) <= tolerance * max(scale[space], 1e-300)
                if not fit.settled:
                    fit.centres = new  # settled centres are those the cost belongs to
                at += len(c)
    return fits


def best_of(fits: list[KMeansFit]) -> dict[tuple, KMeansFit]:
    """The cheapest start of each (space, k, weight)."""
    out: dict[tuple, KMeansFit] = {}
    for fit in sorted(fits, key=lambda f: (f.cost, f.start)):
        out.setdefault((fit.space, fit.k, fit.weight), fit)
    return out


# --- Gaussian mixtures --------------------------------------------------------------------


@dataclass
class MixtureFit:
    """Full-covariance mixture, started from the centres of a k-means fit."""

    space: int
    k: int
    weight: int | None
    start: int
    centres: np.ndarray
    log_share: np.ndarray | None = None
    means: np.ndarray | None = None
    covariances: np.ndarray | None = None
    likelihood: float = -np.inf
    rounds: int = 0
    settled: bool = False
    history: list[float] = field(default_factory=list)


def _whiteners(covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that whiten each component, and the log of their determinants."""
    roots = np.linalg.cholesky(covariances)
    inverse = np.stack([np.linalg.solve(r, np.eye(len(r))).T for r in roots])
    return inverse, -np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1)


def log_density(x: np.ndarray, log_share: np.ndarray, means: np.ndarray, white: np.ndarray, log_det: np.ndarray) -> np.ndarray:
    """log of share times density of each row under each component."""
    k, d = means.shape
    apart = x @ np.concatenate(list(white), axis=1) - np.concatenate([m @ v for m, v in zip(means, white)])
    square = (apart * apart).reshape(len(x), k, d).sum(axis=2)
    return log_share + log_det - 0.5 * (square + d * np.log(2 * np.pi))


def _quadratic(log_share: np.ndarray, means: np.ndarray, white: np.ndarray, log_det: np.ndarray) -> np.ndarray:
    """Each component's log of share times density as a line in products, values and one."""
    k, d = means.shape
    inverse = white @ white.transpose(0, 2, 1)
    slope = (inverse @ means[:, :, None])[..., 0]
    level = log_share + log_det - 0.5 * ((means * slope).sum(axis=1) + d * np.log(2 * np.pi))
    a, b = np.triu_indices(d)
    return np.concatenate([-0.5 * (inverse * (2.0 - np.eye(d)))[:, a, b], slope, level[:, None]], axis=1)


def _mixture_sums(x: np.ndarray, weight: np.ndarray, members: list[tuple]) -> list[tuple[float, np.ndarray]]:
    """(log-likelihood, held rows' sums of products, values and ones) of all mixtures of a space.

    Densities of all components are one product with the rows' products and values, and so
    are the sums. Where rounding could reach ``ROUNDING`` in a row's log density, the row is
    measured from the means instead.
    """
    d = x.shape[1]
    a, b = np.triu_indices(d)
    ends = np.cumsum([0] + [len(c) for _, c, _ in members])
    lines = np.zeros((ends[-1], len(a) + d + 1))
    limits = np.full(len(members), np.inf)
    for j, ((_, _, model), at, to) in enumerate(zip(members, ends, ends[1:])):
        if model is not None:
            lines[at:to] = _quadratic(*model)
            limits[j] = ROUNDING / np.finfo(float).eps / max(np.abs(lines[at:to]).max(), 1.0)
    runs = _runs([len(c) if model is not None else 0 for _, c, model in members])
    fits, sums = np.zeros(len(members)), np.zeros_like(lines)
    for start in range(0, len(x), CACHED_ROWS):
        part, own = x[start:start + CACHED_ROWS], weight[start:start + CACHED_ROWS]
        turned = np.ascontiguousarray(part.T)
        full = np.vstack([turned[a] * turned[b], turned, np.ones((1, len(part)))])
        reach = 1.0 + (part * part).sum(axis=1)
        held = lines @ full
        for j in np.flatnonzero(limits < reach.max()):
            far = np.flatnonzero(reach > limits[j])
            held[ends[j]:ends[j + 1], far] = log_density(part[far], *members[j][2]).T
        for first, end, k in runs:
            if not k:
                for j in range(first, end):
                    (_, label, _), = _nearest(part, [members[j][:2]])
                    held[ends[j] + label, np.arange(len(part))] = own
                continue
            mine = held[ends[first]:ends[end]].reshape(end - first, k, -1)
            top = mine.max(axis=1)
            mine -= top[:, None]
            np.exp(mine, out=mine)
            total = mine.sum(axis=1)
            fits[first:end] += (top + np.log(total)) @ own
            mine *= (own / total)[:, None]
        sums += held @ full.T
    return [(float(f), sums[at:to]) for f, at, to in zip(fits, ends, ends[1:])]


def mixtures(rows: DataFrame, spaces: list[np.ndarray], fits: list[MixtureFit], rounds: int = 300,
             tolerance: float = 1e-3, ridge: float = 1e-6) -> list[MixtureFit]:
    """EM steps for all fits side by side until the mean log-likelihood gains less than ``tolerance``.

    The first step takes the nearest centres as the components.
    """
    tasks = rows.rdd.getNumPartitions() if fits else 0
    for _ in range(rounds + 1):
        moving = [i for i, f in enumerate(fits) if not f.settled]
        if not moving:
            break
        state = {}
        for i in moving:
            f = fits[i]
            state.setdefault((f.space, f.weight), []).append(
                (i, f.centres, None) if f.means is None else (i, f.centres, (f.log_share, f.means, *_whiteners(f.covariances))))

        def step(z, y, w, state=state):
            for (space, column), members in state.items():
                x, weight = z @ spaces[space], _weight(w, column, len(z))
                for (i, centres, _), (fit, held) in zip(members, _mixture_sums(x, weight, members)):
                    k, d = centres.shape
                    upper = np.triu_indices(d)
                    second = np.empty((k, d, d))
                    second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = held[:, :len(upper[0])]
                    yield i, np.concatenate([[fit, weight.sum()], held[:, -1], held[:, -1 - d:-1].ravel(), second.ravel()])

        sizes = [fits[i].centres.shape for i in moving]
        for i, found in summed(rows, step, most=tasks * sum(2 + k * (1 + d + d * d) for k, d in sizes)).items():
            f = fits[i]
            k, d = f.centres.shape
            n, sums = found[2:2 + k], found[2 + k:2 + k + k * d].reshape(k, d)
            second = found[2 + k + k * d:].reshape(k, d, d)
            mean_fit = found[0] / max(found[1], 1e-300)
            if f.means is not None:
                f.rounds += 1
                f.history.append(mean_fit)
                f.settled = abs(mean_fit - f.likelihood) < tolerance
                f.likelihood = mean_fit
                if f.settled:
                    continue  # keep the model that the likelihood belongs to
            n = np.maximum(n, 10 * np.finfo(float).eps)
            f.log_share = np.log(n / n.sum())
            f.means = sums / n[:, None]
            spread = second / n[:, None, None] - f.means[:, :, None] * f.means[:, None, :]
            f.covariances = (spread + spread.transpose(0, 2, 1)) / 2 + ridge * np.eye(d)
            lost = np.linalg.eigvalsh(f.covariances)[:, 0] < ridge / 2  # rounding, or a component without rows
            for c in np.flatnonzero(lost):
                values, vectors = np.linalg.eigh(f.covariances[c])
                f.covariances[c] = (vectors * np.maximum(values, ridge)) @ vectors.T
    return fits


def information_criteria(fit: MixtureFit, rows: float) -> tuple[float, float]:
    """BIC and AIC."""
    k, d = fit.centres.shape
    free = k * d + k * d * (d + 1) // 2 + k - 1
    return free * np.log(rows) - 2 * fit.likelihood * rows, 2 * free - 2 * fit.likelihood * rows


# --- labels and their quality -------------------------------------------------------------


@dataclass
class Solution:
    """How rows get their label: by the nearest centre (and its group), or by a mixture."""

    space: int
    k: int
    weight: int | None = None
    centres: np.ndarray | None = None
    groups: np.ndarray | None = None
    mixture: tuple | None = None

    @classmethod
    def of(cls, fit: KMeansFit | MixtureFit) -> Solution:
        if isinstance(fit, KMeansFit):
            return cls(fit.space, fit.k, fit.weight, fit.centres)
        return cls(fit.space, fit.k, fit.weight, mixture=(fit.log_share, fit.means, *_whiteners(fit.covariances)))

    def label(self, x: np.ndarray) -> np.ndarray:
        if self.mixture:
            return log_density(x, *self.mixture).argmax(axis=1)
        (_, label, _), = _nearest(x, [(0, self.centres)])
        return label if self.groups is None else self.groups[label]


@dataclass
class Quality:
    """Measures of one solution; ``sizes``, ``hits`` and ``centres`` are per cluster."""

    sizes: np.ndarray
    hits: np.ndarray
    centres: np.ndarray
    within: float
    total: float
    between: float
    silhouette: float
    calinski_harabasz: float
    davies_bouldin: float
    cramers_v: float

    @property
    def row(self) -> tuple:
        """Values in the order of the experiments' result columns."""
        used = int((self.sizes > 0).sum())
        if used < 2:
            return used, -1.0, 0.0, 99.0, 0.0, -1.0, 0
        s, v = self.silhouette, self.cramers_v
        return (used, round(s, 4), round(self.calinski_harabasz, 2), round(self.davies_bouldin, 4), round(v, 4), round(s * v, 4), 0)


def _cramers_v(table: np.ndarray) -> float:
    table = table[table.sum(axis=1) > 0]
    if min(table.shape) < 2 or not table.sum():
        return 0.0
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    if np.any(expected == 0):
        return 0.0
    gap = np.abs(table - expected)
    if table.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    return float(np.sqrt((gap ** 2 / expected).sum() / (table.sum() * (min(table.shape) - 1))))


def evaluate(rows: DataFrame, spaces: list[np.ndarray], solutions: list[Solution]) -> list[Quality]:
    """Quality of all solutions in two passes: sums per cluster, then distances to their centres.

    Silhouettes are on squared distances and exact over all rows. Rows weigh as the
    solution's weight column says.
    """
    by_space: dict[int, list[int]] = {}
    for i, s in enumerate(solutions):
        by_space.setdefault(s.space, []).append(i)

    def first(z, y, w):
        for space, members in by_space.items():
            x = z @ spaces[space]
            square = (x * x).sum(axis=1)
            full = np.column_stack([np.ones(len(x)), y == 1, square, x])
            for i in members:
                held = np.zeros((len(x), solutions[i].k))
                held[np.arange(len(x)), solutions[i].label(x)] = _weight(w, solutions[i].weight, len(x))
                yield i, (held.T @ full).ravel()

    sums = summed(rows, first)
    out = []
    for i, s in enumerate(solutions):
        table = sums[i].reshape(s.k, -1)
        n = table[:, 0]
        centres = table[:, 3:] / np.maximum(n, 1e-300)[:, None]
        middle = table[:, 3:].sum(axis=0) / n.sum()
        between = float(n @ ((centres - middle) ** 2).sum(axis=1))
        scatter = np.maximum(table[:, 2] / np.maximum(n, 1e-300) - (centres ** 2).sum(axis=1), 0.0)
        out.append((n, table[:, 1], centres, scatter, between, float(table[:, 2].sum() - n.sum() * middle @ middle)))

    def second(z, y, w):
        for space, members in by_space.items():
            x = z @ spaces[space]
            own_square = (x * x).sum(axis=1)[:, None]
            for i in members:
                n, _, centres, scatter, _, _ = out[i]
                label, line = solutions[i].label(x), np.arange(len(x))
                weight = _weight(w, solutions[i].weight, len(x))
                square = np.maximum(own_square - 2 * x @ centres.T + (centres ** 2).sum(axis=1), 0.0)
                mean = np.where(n > 0, square + scatter, np.inf)
                inside = mean[line, label] * n[label] / np.maximum(n[label] - 1, 1e-12)
                mean[line, label] = np.inf
                nearest = mean.min(axis=1)
                with np.errstate(invalid="ignore"):
                    score = np.where((n[label] > 1) & np.isfinite(nearest),
                                     (nearest - inside) / np.maximum(np.maximum(nearest, inside), 1e-300), 0.0)
                spread = np.bincount(label, weights=weight * np.sqrt(square[line, label]), minlength=len(n))
                yield i, np.concatenate([[float(weight @ score)], spread])

    scores, found = summed(rows, second), []
    for i, (n, hits, centres, scatter, between, total) in enumerate(out):
        used = np.flatnonzero(n > 0)
        k, size = len(used), n.sum()
        within = float(n @ scatter)
        spread = scores[i][1:][used] / n[used]
        apart = np.sqrt(((centres[used][:, None] - centres[used][None]) ** 2).sum(axis=2))
        np.fill_diagonal(apart, np.inf)
        db = float(((spread[:, None] + spread[None]) / np.maximum(apart, 1e-12)).max(axis=1).mean()) if k > 1 else 99.0
        ch = (between / (k - 1)) / max(within / max(size - k, 1e-12), 1e-12) if k > 1 else 0.0
        found.append(Quality(n, hits, centres, within, total, between, float(scores[i][0] / size), float(ch), db,
                             _cramers_v(np.column_stack([hits, n - hits]))))
    return found


def place(rows: DataFrame, spaces: list[np.ndarray], solutions: dict[str, Solution]) -> DataFrame:
    """``rows`` (key, y) with one label column per solution."""
    names = list(solutions)
    schema = StructType([rows.schema["key"], StructField("y", DoubleType())])
    for name in names:
        schema = schema.add(name, IntegerType())

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column("z"), batch.num_rows)
            found = [pa.array(solutions[n].label(z @ spaces[solutions[n].space]).astype(np.int32)) if len(z) else pa.array([], pa.int32())
                     for n in names]
            yield pa.record_batch([batch.column("key"), batch.column("y"), *found], names=["key", "y", *names])

    return rows.select("key", "y", "z").mapInArrow(label, schema)


def agreement(rows: DataFrame, spaces: list[np.ndarray], solutions: list[Solution]) -> np.ndarray:
    """Adjusted Rand index of every pair of solutions on all rows, from one pass of pair counts."""
    count = len(solutions)

    def step(z, y, w):
        placed: dict[int, np.ndarray] = {}
        labels = []
        for s in solutions:
            if s.space not in placed:
                placed[s.space] = z @ spaces[s.space]
            labels.append(s.label(placed[s.space]))
        for i in range(count):
            for j in range(i + 1, count):
                k = solutions[j].k
                yield i * count + j, np.bincount(labels[i] * k + labels[j], minlength=solutions[i].k * k).astype(float)

    tables, out = summed(rows, step), np.eye(count)
    pairs = lambda n: (n * (n - 1) / 2).sum()
    for i in range(count):
        for j in range(i + 1, count):
            t = tables[i * count + j].reshape(solutions[i].k, solutions[j].k)
            a, b, both, every = pairs(t.sum(1)), pairs(t.sum(0)), pairs(t), pairs(t.sum())
            expected, most = a * b / every, (a + b) / 2
            out[i, j] = out[j, i] = 1.0 if most == expected else (both - expected) / (most - expected)
    return out


# --- mini-batches -------------------------------------------------------------------------


def mini_batch_kmeans(rows: DataFrame, space: np.ndarray, centres: np.ndarray, batches: int, rounds: int,
                      seed: int = C.BASE_SEED) -> tuple[np.ndarray, np.ndarray]:
    """Centres and row counts after ``rounds`` passes over keyed batches.

    A row's batch is the hash of its key. A step assigns one batch to the nearest centres
    and moves each by its share of the rows it has seen so far, so steps grow smaller. Rows
    are written once by batch: a step reads its own batch and nothing else.
    """
    number = F.conv(F.substring(hash_key("key", seed), 1, 8), 16, 10).cast("long") % batches
    dealt = materialize(rows.select("key", "z", "y", "w", number.cast("int").alias("batch")).repartition(
        batches, "batch").sortWithinPartitions("batch"))
    centres, seen = np.array(centres, float), np.zeros(len(centres))
    for turn in range(rounds * batches):
        now = centres

        def step(z, y, w, now=now):
            x = z @ space
            (_, label, _), = _nearest(x, [(0, now)])
            held = np.eye(len(now))[label]
            yield 0, np.concatenate([held.sum(axis=0), (held.T @ x).ravel()])

        found = summed(dealt.filter(F.col("batch") == turn % batches), step).get(0)
        if found is None:
            continue
        n, sums = found[:len(centres)], found[len(centres):].reshape(centres.shape)
        seen = seen + n
        move = np.where(n > 0, n / np.maximum(seen, 1.0), 0.0)[:, None]
        centres = centres + move * (sums / np.maximum(n, 1.0)[:, None] - centres)
    return centres, seen
