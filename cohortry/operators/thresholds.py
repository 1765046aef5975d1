"""Three ways to cut a score into two classes, worked out for every group at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from cohortry.operators.ranks import join_groups, quantiles
from cohortry.operators.stats import roc_threshold
from cohortry.session import materialize

#: Starting distances of the two means from the middle, in deviations.
STARTS = (0.3, 0.7, 1.0, 1.5, 2.5)
METHODS = ("median", "roc", "mixture")
#: Rows of a group up to which one task takes all of its steps.
SMALL = 5_000


def _sums(rows: DataFrame, width: int, step) -> dict[int, np.ndarray]:
    """Sums per group of what ``step(group, x)`` returns, folded in tasks and added by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            number = batch.column("group").to_numpy()
            x = batch.column("x").to_numpy(zero_copy_only=False)
            for g in np.unique(number):
                totals[int(g)] = totals.get(int(g), 0.0) + step(int(g), x[number == g])
        if totals:
            yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array([list(v) for v in totals.values()], pa.list_(pa.float64()))],
                                  names=["group", "sums"])

    parts = rows.mapInArrow(partial, "group int, sums array<double>")
    total = parts.groupBy("group").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    return {r.group: np.array(r.sums) for r in total.collect()}


class _Fit:
    """Two normal components of one group from every start, advanced by sums over its rows."""

    def __init__(self, n: float, total: float, squares: float, ridge: float):
        middle, wide = total / n, np.sqrt(max(squares / n - (total / n) ** 2, 0.0))
        self.n, count = n, len(STARTS)
        self.share, self.var = np.full((count, 2), 0.5), np.full((count, 2), wide * wide / 2 + ridge)
        self.mean = np.array([[middle - c * wide, middle + c * wide] for c in STARTS])
        self.likelihood, self.steps, self.settled = np.full(count, -np.inf), np.zeros(count, int), np.zeros(count, bool)

    @property
    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.log(self.share), self.mean, self.var

    def advance(self, sums: np.ndarray, tolerance: float, ridge: float) -> None:
        count = len(STARTS)
        likelihood = sums[:count] / self.n
        n, s, ss = (q.reshape(count, 2) for q in np.split(sums[count:], 3))
        moving = ~self.settled
        done = moving & (np.abs(likelihood - self.likelihood) < tolerance)
        self.likelihood[moving] = likelihood[moving]
        self.steps[moving] += 1
        n = np.maximum(n, 1e-12)
        for i in np.flatnonzero(moving):  # the last step too, so that moments of the fit are those of the data
            self.share[i], self.mean[i] = n[i] / n[i].sum(), s[i] / n[i]
            self.var[i] = np.maximum(ss[i] / n[i] - self.mean[i] ** 2, 0.0) + ridge
        self.settled |= done


def _held(x: np.ndarray, log_share: np.ndarray, m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Log-likelihood of each start and the moments that its components hold."""
    logs = log_share - 0.5 * (np.log(2 * np.pi * v) + (x[:, None, None] - m) ** 2 / v)
    top = logs.max(axis=2, keepdims=True)
    total = top[..., 0] + np.log(np.exp(logs - top).sum(axis=2))
    held = np.exp(logs - total[..., None])
    moments = [(held * (x ** p)[:, None, None]).sum(axis=0) for p in (0, 1, 2)]
    return np.concatenate([total.sum(axis=0), *[q.ravel() for q in moments]])


def _fits_in_tasks(rows: DataFrame, rounds: int, tolerance: float, ridge: float) -> dict[int, _Fit]:
    """Fits of groups whose few rows meet in one task, which takes all of their steps."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(frame["x"].to_numpy(float))
        fit = _Fit(len(x), x.sum(), (x * x).sum(), ridge)
        for _ in range(rounds):
            if fit.settled.all():
                break
            fit.advance(_held(x, *fit.state), tolerance, ridge)
        names = ("share", "mean", "var", "likelihood", "steps", "settled")
        return pd.DataFrame({"group": frame["group"].iloc[:1], "n": len(x), **{c: [np.ravel(getattr(fit, c)).astype(float)] for c in names}})

    schema = "group int, n long, " + ", ".join(f"{c} array<double>" for c in ("share", "mean", "var", "likelihood", "steps", "settled"))
    out = {}
    for r in rows.groupBy("group").applyInPandas(settle, schema).collect():
        fit = out[r.group] = _Fit(r.n, 0.0, 0.0, ridge)
        fit.share, fit.mean, fit.var = (np.reshape(v, (-1, 2)) for v in (r.share, r.mean, r["var"]))
        fit.likelihood, fit.steps, fit.settled = np.array(r.likelihood), np.array(r.steps, int), np.array(r.settled, bool)
    return out


def group_mixtures(df: DataFrame, keys: list[str], score: str, rounds: int = 300, tolerance: float = 1e-6,
                   ridge: float = 1e-9) -> DataFrame:
    """Two normal components of ``score`` in every group: shares, means and variances, low mean first.

    Groups of at most ``SMALL`` rows are settled inside a task. All others, and all their
    starts, take an EM step in the same pass, from sums of their moments. The most likely
    start stays. ``settled`` says whether its mean log-likelihood stopped
    gaining ``tolerance``. Null scores take no part; a group of equal scores is one
    component twice, with the variance ``ridge``.
    """
    spark = df.sparkSession
    groups = materialize(df.filter(F.col(score).isNotNull()).select(*keys).distinct()) if keys else None
    found = [tuple(r) for r in groups.orderBy(*keys).collect()] if keys else [()]
    schema = groups.schema if keys else None
    if keys:
        numbers = materialize(spark.createDataFrame([(*g, i) for i, g in enumerate(found)], schema.add("group", IntegerType())))
        rows = join_groups(df.filter(F.col(score).isNotNull()).select(*keys, F.col(score).cast("double").alias("x")), numbers, keys)
    else:
        rows = df.filter(F.col(score).isNotNull()).select(F.lit(0).alias("group"), F.col(score).cast("double").alias("x"))
    rows = materialize(rows.select("group", "x"))
    sizes = {r.group: r["count"] for r in rows.groupBy("group").count().collect()}
    large = [g for g, n in sizes.items() if n > SMALL]
    fits = {}
    if len(large) < len(sizes):
        fits = _fits_in_tasks(rows.filter(~F.col("group").isin(large)) if large else rows, rounds, tolerance, ridge)
    if large:
        rows = materialize(rows.filter(F.col("group").isin(large))) if fits else rows
        fits |= {g: _Fit(*sums, ridge) for g, sums in _sums(rows, 3, lambda g, x: np.array([len(x), x.sum(), (x * x).sum()])).items()}
    for _ in range(rounds):
        now = {g: fits[g].state for g in large if not fits[g].settled.all()}
        if not now:
            break
        for g, sums in _sums(rows, len(STARTS) * 7, lambda g, x, now=now: _held(x, *now[g]) if g in now else np.zeros(len(STARTS) * 7)).items():
            if g in now:
                fits[g].advance(sums, tolerance, ridge)
    lines = []
    for g, key in enumerate(found):
        if g not in fits:
            continue
        fit = fits[g]
        i = int(fit.likelihood.argmax())
        order = np.argsort(fit.mean[i])
        values = [float(v[i][j]) for j in order for v in (fit.share, fit.mean, fit.var)]
        lines.append((*key, int(fit.n), *values, float(fit.likelihood[i]), int(fit.steps[i]), bool(fit.settled[i])))
    fields = "n long, share_low double, mean_low double, var_low double, share_high double, mean_high double, " \
             "var_high double, mean_log_likelihood double, steps int, settled boolean"
    shown = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema) if keys else ""
    return spark.createDataFrame(lines, shown + fields)


def in_upper(score: str) -> Column:
    """Whether the upper component of joined ``group_mixtures`` is the likelier one.

    Scores outside the two means belong to the component on their side, so that the rule
    is a cut even where the variances differ much.
    """
    x = F.col(score)
    side = {s: F.log(F.col(f"share_{s}")) - 0.5 * (F.log(F.col(f"var_{s}")) + (x - F.col(f"mean_{s}")) ** 2 / F.col(f"var_{s}"))
            for s in ("low", "high")}
    return F.when(x <= F.col("mean_low"), False).when(x >= F.col("mean_high"), True).otherwise(side["high"] > side["low"])


def threshold_labels(df: DataFrame, keys: list[str], score: str, outcome: str) -> tuple[DataFrame, DataFrame]:
    """Every row with its class under each method, and the cut of each method by group.

    ``median``: at or above the group's median. ``roc``: at or above the score whose rule
    has the largest sensitivity and specificity for ``outcome`` (0/1); a logistic line in one
    score is monotone, so its best cut is a cut of the score. ``mixture``: the upper of two
    normal components. ``df`` should be written.
    """
    medians = quantiles(df, keys, score, {"median": 0.5})
    cuts = roc_threshold(df, keys, outcome, score).withColumnRenamed("threshold", "roc")
    fits = materialize(group_mixtures(df, keys, score))
    rules = materialize(join_groups(join_groups(medians, materialize(cuts), keys), fits.drop("n"), keys))
    placed = join_groups(df, rules, keys).withColumns({
        "by_median": (F.col(score) >= F.col("median")).cast("int"), "by_roc": (F.col(score) >= F.col("roc")).cast("int"),
        "by_mixture": in_upper(score).cast("int")})
    return placed, rules


def pairwise_agreement(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows in class 1 by each method, and of rows that two methods class alike."""
    same = {f"{a}_{b}": F.avg((F.col(f"by_{a}") == F.col(f"by_{b}")).cast("double"))
            for i, a in enumerate(METHODS) for b in METHODS[i + 1:]}
    return placed.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(f"by_{m}").alias(f"share_{m}") for m in METHODS],
                                     *[e.alias(f"agree_{n}") for n, e in same.items()])


def stability(placed: DataFrame, key: str) -> DataFrame:
    """How often two subsamples class a user alike, by method; the steadiest one is adopted.

    A user in s subsamples counts s (s - 1) / 2 pairs, from counts alone. Ties go to the
    method listed first.
    """
    counts = placed.groupBy(key).agg(F.count("*").alias("s"), *[F.sum(f"by_{m}").alias(m) for m in METHODS])
    pairs = lambda n: n * (n - 1) / 2
    sums = counts.agg(F.sum(pairs(F.col("s"))).alias("pairs"), *[
        F.sum(pairs(F.col(m)) + pairs(F.col("s") - F.col(m))).alias(m) for m in METHODS])
    table = sums.select("pairs", F.explode(F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(m).alias("method"), (F.col(m) / F.nullif(F.col("pairs"), F.lit(0.0))).alias("agreement"))
        for i, m in enumerate(METHODS)])).alias("x")).select("x.place", "x.method", F.col("pairs").cast("long").alias("pairs"), "x.agreement")
    best = table.agg(F.max_by("place", F.struct("agreement", -F.col("place")))).scalar()
    return table.withColumn("adopted", F.col("place") == best).drop("place")
