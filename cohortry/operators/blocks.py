"""Feature blocks compared over many subsamples: all fits of a kind advance together.

Rows are vectors with the number of their subsample and whether they train. Discriminants
need one pass of moments; logistic fits take one pass a Newton step, for every block and
subsample at once (``summed`` adds gradients and curvatures over the shuffle). Forests are
grown inside tasks, one group per subsample and bunch of trees: a subsample is a drawn
sample of stated size, which bounds a group whatever the population.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType

from cohortry import config as C
from cohortry.operators.batched import _matrix, summed, vector_rows
from cohortry.operators.forest import grow, importances, probability
from cohortry.operators.mlprep import categories, dummy_name, feature_matrix
from cohortry.operators.rotate import discriminant_direction
from cohortry.operators.stats import auc, confusion_metrics, nagelkerke
from cohortry.session import materialize

#: Trees that one group grows.
BUNCH = 25


@dataclass
class BlockRows:
    """Written rows (key, z, y, w = [subsample number, trains]) and the columns of each block."""

    rows: DataFrame
    names: list[str]
    groups: list[tuple]
    keys: list[str]
    blocks: dict[str, list[int]]


def block_rows(df: DataFrame, keys: list[str], blocks: dict[str, tuple[list[str], list[str]]], y: str = "y",
               key: str = "USER_ID") -> BlockRows:
    """Vectors of all blocks' features; ``df`` has ``split``, the subsample ``keys`` and ``y``.

    Dummies leave out the first level; levels are those of the training rows of all
    subsamples, so a level that one subsample lacks is a constant there.
    """
    continuous = list(dict.fromkeys(f for c, _ in blocks.values() for f in c))
    categorical = list(dict.fromkeys(f for _, c in blocks.values() for f in c))
    levels = categories(df.filter(F.col("split") == "train"), categorical) if categorical else {}
    matrix, names = feature_matrix(df, continuous, levels, [*keys, key, y, "split"])
    groups = [tuple(r) for r in df.select(*keys).distinct().orderBy(*keys).collect()]
    number = materialize(df.sparkSession.createDataFrame(
        [(*g, i) for i, g in enumerate(groups)], df.select(*keys).schema.add("_number", IntegerType())))
    same = [matrix[k].eqNullSafe(number[k]) for k in keys]
    numbered = matrix.join(number, same).select(*[matrix[c] for c in matrix.columns], "_number")
    rows = materialize(vector_rows(numbered, names, y, key, [F.col("_number"), (F.col("split") == "train").cast("int")]))
    dummies = {c: [names.index(dummy_name(c, v)) for v in levels[c][1:]] for c in categorical}
    return BlockRows(rows, names, groups, keys, {
        b: [names.index(f) for f in cont] + [i for c in cat for i in dummies[c]] for b, (cont, cat) in blocks.items()})


@dataclass
class GroupMoments:
    n: float
    mean: np.ndarray
    cov: np.ndarray
    sizes: dict[int, float]
    means: dict[int, np.ndarray]

    @property
    def spread(self) -> np.ndarray:
        wide = np.sqrt(np.maximum(np.diag(self.cov), 0.0))
        return np.where(wide > 1e-12 * np.maximum(1.0, np.abs(self.mean)), wide, 1.0)


def _training(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(subsample, rows of it that train) of a batch."""
    for g in np.unique(w[:, 0]):
        yield int(g), np.flatnonzero((w[:, 0] == g) & (w[:, 1] == 1))


def group_moments(data: BlockRows) -> list[GroupMoments]:
    """Moments of each subsample's training rows by class."""

    def step(z, y, w):
        for g, at in _training(w):
            full = np.column_stack([np.ones(len(at)), z[at]])
            yield g, np.concatenate([(full.T @ full).ravel(), (full * (y[at] == 1)[:, None]).sum(axis=0)])

    found, p, out = summed(data.rows, step), len(data.names) + 1, []
    for g in range(len(data.groups)):
        total, one = found[g][:p * p].reshape(p, p), found[g][p * p:]
        n, n1 = total[0, 0], one[0]
        mean = total[0, 1:] / n
        sums = {1: (n1, one[1:]), 0: (n - n1, total[0, 1:] - one[1:])}
        held = {c: s for c, s in sums.items() if s[0] > 0}
        out.append(GroupMoments(n, mean, total[1:, 1:] / n - np.outer(mean, mean), {c: s[0] for c, s in held.items()},
                                {c: s[1] / s[0] for c, s in held.items()}))
    return out


@dataclass
class Line:
    """A linear score on the raw vector, and whether its logistic is a probability."""

    group: int
    block: str
    model: str
    slope: np.ndarray
    intercept: float
    sizes: np.ndarray


def discriminants(data: BlockRows, moments: list[GroupMoments]) -> list[Line]:
    """Two-class discriminants of every block and subsample, from their moments."""
    out = []
    for g, m in enumerate(moments):
        for block, at in data.blocks.items():
            scale = m.spread[at]
            means = {c: (v[at] - m.mean[at]) / scale for c, v in m.means.items()}
            coefficients, _ = discriminant_direction(m.cov[np.ix_(at, at)] / np.outer(scale, scale), m.sizes, means)
            middle = np.log(m.sizes[1] / m.sizes[0]) - (means[1] + means[0]) @ coefficients / 2 if len(means) == 2 else 0.0
            slope = np.zeros(len(data.names))
            slope[at] = coefficients / scale
            out.append(Line(g, block, "LDA", slope, float(middle - slope @ m.mean), np.abs(coefficients)))
    return out


def logistics(data: BlockRows, moments: list[GroupMoments], penalty: float = 1.0, rounds: int = 50,
              tolerance: float = 1e-8) -> tuple[list[Line], dict[tuple[int, str], float]]:
    """Class-balanced logistic fits with a squared penalty, and the largest gradient of each.

    One pass a step gives loss, gradient and curvature of all fits; a step that does not
    lower the loss is halved. The intercept is free. Features are scaled on training rows.
    """
    blocks = data.blocks
    fits = [(g, block) for g in range(len(data.groups)) for block in blocks]
    beta = {f: np.zeros(len(blocks[f[1]]) + 1) for f in fits}
    last: dict[tuple[int, str], tuple[float, np.ndarray, np.ndarray]] = {}
    gradients = dict.fromkeys(fits, np.inf)
    halved = dict.fromkeys(fits, 0)
    weight = {g: {c: m.n / (len(m.sizes) * n) for c, n in m.sizes.items()} for g, m in enumerate(moments)}
    moving, tasks = set(fits), data.rows.rdd.getNumPartitions()
    for _ in range(rounds):
        if not moving:
            break
        now = {f: beta[f] for f in fits if f in moving}

        def step(z, y, w, now=now):
            for g, at in _training(w):
                if not len(at):
                    continue
                x_all = (z[at] - moments[g].mean) / moments[g].spread
                hit = y[at] == 1
                own = np.where(hit, weight[g].get(1, 0.0), weight[g].get(0, 0.0))
                for i, f in enumerate(fits):
                    if f[0] != g or f not in now:
                        continue
                    x = np.column_stack([np.ones(len(at)), x_all[:, blocks[f[1]]]])
                    score = x @ now[f]
                    p = 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))
                    loss = float(own @ (np.logaddexp(0.0, score) - score * hit))
                    yield i, np.concatenate([[loss], x.T @ (own * (p - hit)), ((x * (own * p * (1 - p))[:, None]).T @ x).ravel()])

        found = summed(data.rows, step, most=tasks * sum(1 + len(b) * (len(b) + 1) for b in now.values()))
        for i, f in enumerate(fits):
            if f not in moving:
                continue
            d = len(beta[f])
            ridge = np.r_[0.0, np.full(d - 1, penalty)]
            loss = found[i][0] + 0.5 * float(ridge @ beta[f] ** 2)
            gradient = found[i][1:1 + d] + ridge * beta[f]
            if f in last and loss > last[f][0] + 1e-12 * abs(loss) and halved[f] < 30:
                halved[f] += 1
                beta[f] = last[f][1] + last[f][2] * 0.5 ** halved[f]
                continue
            halved[f] = 0
            gradients[f] = float(np.abs(gradient).max())
            if gradients[f] < tolerance * moments[f[0]].n:
                moving.discard(f)
                continue
            move = -np.linalg.lstsq(found[i][1 + d:].reshape(d, d) + np.diag(ridge), gradient, rcond=None)[0]
            last[f] = loss, beta[f], move
            beta[f] = beta[f] + move
    out = []
    for g, block in fits:
        at, m = data.blocks[block], moments[g]
        slope = np.zeros(len(data.names))
        slope[at] = beta[g, block][1:] / m.spread[at]
        out.append(Line(g, block, "LogReg", slope, float(beta[g, block][0] - slope @ m.mean), np.abs(beta[g, block][1:])))
    return out, gradients


def score_lines(data: BlockRows, lines: list[Line]) -> DataFrame:
    """(_group, block, model, key, y, p) of the test rows under every line of their subsample."""
    by_group: dict[int, list[Line]] = {}
    for line in lines:
        by_group.setdefault(line.group, []).append(line)
    kind = data.rows.schema["key"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, w = _matrix(batch.column("z"), batch.num_rows), _matrix(batch.column("w"), batch.num_rows)
            for g in np.unique(w[:, 0]).astype(int) if len(w) else []:
                at = np.flatnonzero((w[:, 0] == g) & (w[:, 1] == 0))
                picked = pa.array(at)
                for line in by_group.get(g, []):
                    # equal rows must tie, so drop the last bits of the sum
                    score = np.round(z[at] @ line.slope + line.intercept, 9)
                    p = 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))
                    yield pa.record_batch([pa.array(np.full(len(at), g), pa.int32()), pa.array([line.block] * len(at), pa.string()),
                                           pa.array([line.model] * len(at), pa.string()), batch.column("key").take(picked),
                                           batch.column("y").take(picked), pa.array(p)],
                                          names=["_group", "block", "model", "key", "y", "p"])

    return data.rows.mapInArrow(score, f"_group int, block string, model string, key {kind}, y double, p double")


def forests(data: BlockRows, trees: int = C.FOREST_TREES, seed: int = C.BASE_SEED) -> DataFrame:
    """(_group, block, key, y, trees, votes, importance): class-1 votes on test rows by bunch of trees.

    Trees are grown to pure leaves on bootstraps of the subsample's training rows with
    balanced classes. A null ``key`` marks the line that carries a bunch's importances.
    """
    kind, blocks = data.rows.schema["key"].dataType.simpleString(), data.blocks
    bunches = (trees + BUNCH - 1) // BUNCH
    schema = f"_group int, block string, key {kind}, y double, trees int, votes double, importance array<double>"

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        group, bunch = int(frame["_group"].iloc[0]), int(frame["bunch"].iloc[0])
        z, y, trains = np.stack(frame["z"].to_numpy()), frame["y"].to_numpy(float), frame["trains"].to_numpy() == 1
        test_keys, test_y, out = frame["key"].to_numpy()[~trains], y[~trains], []
        for number, (block, at) in enumerate(blocks.items()):
            x, target, test = z[trains][:, at], y[trains] == 1, z[~trains][:, at]
            votes, shares, here = np.zeros(len(test)), np.zeros(len(at)), range(bunch * BUNCH, min(trees, (bunch + 1) * BUNCH))
            for t in here:
                rng = np.random.default_rng([seed, group, number, t])
                drawn = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)).astype(float)
                tree = grow(x, target, drawn, rng)
                votes += probability(tree, test)
                shares += importances(tree, len(at))
            out.append(pd.DataFrame({"_group": group, "block": block, "key": test_keys, "y": test_y, "trees": len(here),
                                     "votes": votes, "importance": [None] * len(test)}))
            out.append(pd.DataFrame({"_group": [group], "block": [block], "key": [None], "y": [np.nan], "trees": [len(here)],
                                     "votes": [0.0], "importance": [shares.tolist()]}))
        return pd.concat(out, ignore_index=True)

    spread = data.rows.select("key", "z", "y", F.col("w")[0].cast("int").alias("_group"), F.col("w")[1].cast("int").alias("trains"),
                              F.explode(F.sequence(F.lit(0), F.lit(bunches - 1))).alias("bunch"))
    # few bytes but much work: a stated number keeps the partitions from being merged by size
    tasks = min(len(data.groups) * bunches, 4 * data.rows.sparkSession.sparkContext.defaultParallelism)
    return spread.repartition(tasks, "_group", "bunch").groupBy("_group", "bunch").applyInPandas(train, schema)


def compare_subsamples(df: DataFrame, keys: list[str], blocks: dict, models: tuple[str, ...] = ("LDA", "LogReg", "RF"),
                       y: str = "y", trees: int = C.FOREST_TREES) -> tuple[DataFrame, DataFrame]:
    """(metrics, importances) of every block, model and subsample.

    Metrics are accuracy, precision, recall, F1, AUC and pseudo R2 on the test rows.
    """
    spark = df.sparkSession
    data = block_rows(df, keys, blocks, y)
    moments = group_moments(data)
    lines, gradients = discriminants(data, moments) if "LDA" in models else [], {}
    if "LogReg" in models:
        found, gradients = logistics(data, moments)
        lines = lines + found
    label = {b: [data.names[i] for i in at] for b, at in data.blocks.items()}
    weights = [(l.group, l.block, l.model, f, float(v)) for l in lines for f, v in zip(label[l.block], l.sizes)]
    scored = score_lines(data, lines).select("_group", "block", "model", "y", "p") if lines else None
    if "RF" in models:
        grown = materialize(forests(data, trees))
        sums = grown.filter("key is not null").groupBy("_group", "block", "key").agg(
            F.max("y").alias("y"), (F.sum("votes") / F.sum("trees")).alias("p"))
        rf = sums.select("_group", "block", F.lit("RF").alias("model"), "y", F.round("p", 9).alias("p"))
        scored = rf if scored is None else scored.unionByName(rf)
        shares = grown.filter("key is null").select("_group", "block", F.posexplode("importance").alias("i", "v")).groupBy(
            "_group", "block", "i").agg(F.sum("v").alias("v"))
        weights += [(r._group, r.block, "RF", label[r.block][r.i], r.v / trees) for r in shares.collect()]
    scored = materialize(scored)
    at = ["_group", "block", "model"]
    named = spark.createDataFrame([(i, *g) for i, g in enumerate(data.groups)], "_group int, " + ", ".join(
        f"{k} {df.schema[k].dataType.simpleString()}" for k in keys))
    slack = spark.createDataFrame([(g, b, "LogReg", v) for (g, b), v in gradients.items()],
                                  "_group int, block string, model string, largest_gradient double")
    metrics = (confusion_metrics(scored.withColumn("predicted", (F.col("p") >= 0.5).cast("int")), at, "y", "predicted")
               .join(auc(scored, at, "y", "p"), at).join(nagelkerke(scored, at, "y", "p").drop("n"), at)
               .join(slack, at, "left"))
    importance = spark.createDataFrame(weights, "_group int, block string, model string, feature string, importance double")
    return metrics.join(named, "_group").drop("_group"), importance.join(named, "_group").drop("_group")


def summarise(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and deviation of AUC, F1 and accuracy over the subsamples."""
    return metrics.groupBy(*keys).agg(F.count("*").alias("subsamples"), *[
        f(m).alias(f"{n}_{m}") for m in ("auc", "f1", "accuracy", "nagelkerke_r2") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
