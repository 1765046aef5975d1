"""Closed-form statistics: every one is an aggregate plus arithmetic on small tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry.functions import columns as X
from cohortry.functions.special import f_test_p
from cohortry.operators.ranks import join_groups, running_counts
from cohortry.session import materialize

# --- association of two labels --------------------------------------------------------


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table (a, b, n)."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square and Cramer's V; continuity correction for 2 x 2 tables only.

    Empty cells add nothing to sum(n_ij^2 / (r_i c_j)), so the long table is enough.
    """
    return _association(contingency(df, a, b), a, b)


def _association(cells: DataFrame, a: str, b: str) -> DataFrame:
    """The same from a table of cells; counts are doubles, whose products do not overflow."""
    cells = cells.withColumn("n", F.col("n").cast("double")).select(
        "*", F.sum("n").over(W.partitionBy(a)).alias("r"),
        F.sum("n").over(W.partitionBy(b)).alias("c"))
    fit = cells.agg(
        F.sum("n").alias("n"), F.count_distinct(a).alias("n_rows"),
        F.count_distinct(b).alias("n_cols"),
        F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("fit"),
        # 2 x 2: all four |observed - expected| are equal, as is the sum of 1 / expected
        F.max(F.struct("n", "r", "c")).alias("cell"))
    n, cell = F.col("n"), F.col("cell")
    expected = cell["r"] * cell["c"] / n
    gap = F.abs(cell["n"] - expected)
    corrected = gap - F.least(F.lit(0.5), gap)
    inverse = n * n * n / (cell["r"] * (n - cell["r"]) * cell["c"] * (n - cell["c"]))
    two_by_two = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    plain = n * (F.col("fit") - 1)
    chi2 = F.when(two_by_two, corrected * corrected * inverse).otherwise(plain)
    smaller = F.least("n_rows", "n_cols") - 1
    return fit.select(
        F.col("n").cast("long").alias("n"), "n_rows", "n_cols", two_by_two.alias("corrected"), chi2.alias("chi2"),
        F.when(smaller > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (n * F.nullif(smaller, F.lit(0)))))
        .otherwise(0.0).alias("cramers_v"))


def _pairs(n: Column) -> Column:
    """Pairs of n rows as a double: the product of two counts overflows 64 bits."""
    n = n.cast("double")
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labels of the same rows."""
    cells = contingency(df, a, b)
    sums = cells.agg(F.sum(_pairs(F.col("n"))).alias("both"), F.sum("n").alias("n"))

    def one_side(label: str) -> Column:
        sizes = cells.groupBy(label).agg(F.sum("n").alias("m"))
        return sizes.agg(F.sum(_pairs(F.col("m")))).scalar()

    sided = sums.withColumns({"left_pairs": one_side(a), "right_pairs": one_side(b)})
    expected = F.col("left_pairs") * F.col("right_pairs") / F.nullif(_pairs(F.col("n")), F.lit(0.0))
    best = (F.col("left_pairs") + F.col("right_pairs")) / 2
    return sided.select("n", F.when(best == expected, 1.0).otherwise(
        (F.col("both") - expected) / F.nullif(best - expected, F.lit(0.0))).alias("ari"))


def adjusted_rand_all(df: DataFrame, labels: list[str]) -> DataFrame:
    """Adjusted Rand index of every two label columns, from one pass over the rows.

    Rows fold map-side to counts per (columns, labels), so what shuffles depends on the
    number of labels only.
    """
    each = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("la"), F.col(b).alias("lb"))
        for a, b in combinations(labels, 2)])
    cells = materialize(df.select(F.explode(each).alias("p")).groupBy(
        "p.a", "p.b", "p.la", "p.lb").agg(F.count("*").alias("n")))
    keys = ["a", "b"]

    def one_side(label: str, name: str) -> DataFrame:
        sizes = cells.groupBy(*keys, label).agg(F.sum("n").alias("m"))
        return sizes.groupBy(*keys).agg(F.sum(_pairs(F.col("m"))).alias(name))

    sums = cells.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    joined = sums.join(one_side("la", "left_pairs"), keys).join(one_side("lb", "right_pairs"), keys)
    expected = F.col("left_pairs") * F.col("right_pairs") / F.nullif(_pairs(F.col("n")), F.lit(0.0))
    best = (F.col("left_pairs") + F.col("right_pairs")) / 2
    return joined.select(*keys, "n", F.when(best == expected, 1.0).otherwise(
        (F.col("both") - expected) / F.nullif(best - expected, F.lit(0.0))).alias("ari"))


def best_jaccard(df: DataFrame, a: str, b: str, stable: float = 0.75,
                 borderline: float = 0.60) -> DataFrame:
    """For each label of ``a`` the best overlap with a label of ``b``, and a verdict."""
    cells = contingency(df, a, b).select(
        "*", F.sum("n").over(W.partitionBy(a)).alias("r"),
        F.sum("n").over(W.partitionBy(b)).alias("c"))
    overlap = F.col("n") / (F.col("r") + F.col("c") - F.col("n"))
    best = cells.groupBy(a).agg(F.max(overlap).alias("jaccard"))
    return best.withColumn(
        "stability", F.when(F.col("jaccard") >= stable, "stable")
        .when(F.col("jaccard") >= borderline, "borderline").otherwise("unstable"))


# --- regression -----------------------------------------------------------------------


def _merge(a: list | None, n: float, mean: np.ndarray, spread: np.ndarray) -> list:
    """Add a block's size, means and centred cross-products to a running triple."""
    if a is None:
        return [n, mean, spread]
    total, shift = a[0] + n, mean - a[1]
    return [total, a[1] + shift * (n / total),
            a[2] + spread + np.outer(shift, shift) * (a[0] * n / total)]


#: Most partial results that one merge sees, up to the square of it in tasks.
FAN = 1024


def regressions(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Least squares per group: ``coefficients``, ``intercept``, ``r2`` and ``n``.

    Each task folds its rows to one (n, means, cross-products) row per group. These are
    merged in two levels, by task number modulo ``FAN`` and then by group, and the small
    solve runs on the last merge. Cost per row is one outer product, which Catalyst would
    spread over p^2 aggregate columns. Groups must be few.
    """
    names = [*xs, y]
    slim = df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keys]
    values = [f"_v{i}" for i in range(len(names))]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list] = {}
        for batch in batches:
            groups = batch.groupby(keys, sort=False, dropna=False) if keys else [((), batch)]
            for key, part in groups:
                key = tuple(None if pd.isna(k) else k for k in key)  # a null group is one group
                block = part[values].dropna().to_numpy(float)
                if len(block):
                    mean = block.mean(axis=0)
                    centred = block - mean
                    found[key] = _merge(found.get(key), len(block), mean, centred.T @ centred)
        branch = TaskContext.get().partitionId() % FAN
        rows = [[*key, branch, n, mean, spread.ravel()] for key, (n, mean, spread) in found.items()]
        out = pd.DataFrame(rows, columns=[*keys, "_branch", "n", "mean", "spread"])
        yield out.assign(**{k: pd.Series([r[i] for r in rows], dtype=object) for i, k in enumerate(keys)})

    def merged(pdf: pd.DataFrame) -> list:
        state = None
        for n, mean, spread in zip(pdf["n"], pdf["mean"], pdf["spread"]):
            state = _merge(state, n, np.asarray(mean), np.asarray(spread).reshape(len(names), len(names)))
        return state

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, spread = merged(pdf)
        return pdf.iloc[:1].assign(n=int(n), mean=[mean], spread=[spread.ravel()])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, spread = merged(pdf)
        beta = np.linalg.lstsq(spread[:-1, :-1], spread[:-1, -1], rcond=None)[0]
        fit = float(beta @ spread[:-1, -1] / spread[-1, -1]) if spread[-1, -1] > 0 else 0.0
        first = [None if pd.isna(pdf[k].iloc[0]) else pdf[k].iloc[0] for k in keys]
        head = pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in zip(keys, first)}, index=[0])
        return head.assign(n=int(n), coefficients=[beta.tolist()],
                           intercept=float(mean[-1] - beta @ mean[:-1]), r2=fit)

    parts = ", ".join([*fields, "_branch int", "n long", "mean array<double>", "spread array<double>"])
    folded = slim.mapInPandas(fold, parts).groupBy(*keys, "_branch").applyInPandas(merge, parts)
    return folded.groupBy(*keys).applyInPandas(solve, ", ".join(
        [*fields, "n long", "coefficients array<double>", "intercept double", "r2 double"]))


def partial_correlations(df: DataFrame, keys: list[str], y: str, controls: list[str],
                         targets: list[str]) -> DataFrame:
    """Raw r with ``y`` and r with what the controls leave of ``y``, per group and target."""
    fits = materialize(regressions(df, keys, y, controls))
    joined = join_groups(df, fits, keys) if keys else df.withColumns(
        {c: fits.select(c).scalar() for c in ("coefficients", "intercept", "r2")})
    fitted = X.total(F.col("coefficients")[i] * F.col(c) for i, c in enumerate(controls))
    residual = joined.withColumn("_rest", F.col(y) - fitted - F.col("intercept"))
    found = residual.groupBy(*keys).agg(
        F.max("r2").alias("controls_r2"),
        *[F.struct(F.corr(t, y).alias("r_raw"), F.corr(t, "_rest").alias("r_partial")).alias(t)
          for t in targets])
    return found.unpivot([*keys, "controls_r2"], targets, "feature", "r").select(
        *keys, "feature", "controls_r2", "r.r_raw", "r.r_partial")


def curve_fits(df: DataFrame, tier: str, x: str, y: str, minimum: int = 30) -> DataFrame:
    """Linear, quadratic and logarithmic fit per tier; which curve gains most.

    Tiers under ``minimum`` rows are returned too, with ``enough_rows`` false and null fits.
    """
    shifted = join_groups(df, materialize(df.groupBy(tier).agg(F.min(x).alias("_low"))), [tier])
    ready = shifted.withColumns({
        "_x2": F.col(x) * F.col(x),
        "_lx": F.log(F.col(x) - F.col("_low") + 0.1 + 1.0)})
    linear = ready.groupBy(tier).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("lin_slope"),
        F.regr_r2(y, x).alias("r2_lin"), F.regr_r2(y, "_lx").alias("r2_log"))
    quad = regressions(ready, [tier], y, [x, "_x2"]).select(
        tier, F.col("r2").alias("r2_quad"), F.col("coefficients")[1].alias("quad_a"))
    gain = F.greatest("r2_quad", "r2_log") - F.col("r2_lin")
    out = join_groups(linear, quad, [tier], "left").withColumns({
        "delta_r2": gain,
        "best_model": F.when(F.col("r2_log") > F.col("r2_quad"), "Log").otherwise("Quad")})
    enough = F.col("n") >= minimum
    return out.select(tier, "n", enough.alias("enough_rows"), *[
        F.when(enough, F.col(c)).alias(c) for c in out.columns if c not in (tier, "n")])


def interaction_model(df: DataFrame, x: str, tier: str, y: str) -> DataFrame:
    """R2 without and with the x * tier term, its gain, F and p."""
    ready = df.withColumn("_xt", F.col(x) * F.col(tier))
    plain = regressions(ready, [], y, [x, tier]).select(F.col("r2").alias("r2_additive"))
    full = regressions(ready, [], y, [x, tier, "_xt"])
    rest = F.col("n") - 4
    gain = F.col("r2") - F.col("r2_additive")
    return full.withColumn("r2_additive", plain.scalar()).select(
        "n", "r2_additive", F.col("r2").alias("r2_interaction"), gain.alias("r2_gain"),
        (gain / ((1 - F.col("r2")) / rest)).alias("f_statistic"),
        F.col("coefficients")[2].alias("interaction")
    ).withColumn("p_value", f_test_p("f_statistic", F.lit(1.0), (F.col("n") - 4).cast("double")))


def gradients(df: DataFrame, tier: str, x: str, y: str) -> DataFrame:
    """Profile of the persistence gradient per tier: spread, slope, R2 and p."""
    out = df.groupBy(tier).agg(
        F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"),
        F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    rest = (F.col("n") - 2).cast("double")
    f = F.col("r2") / F.nullif(1 - F.col("r2"), F.lit(0.0)) * rest
    return out.withColumns({"y_range": F.col("y_max") - F.col("y_min"),
                            "p_value": f_test_p(F.coalesce(f, F.lit(0.0)), F.lit(1.0), rest)})


# --- correlation matrices -------------------------------------------------------------


def correlation_matrix(df: DataFrame, features: list[str]) -> np.ndarray:
    """p x p Pearson matrix (p is a feature count); constant columns give 0."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                         for c in features])
    vectors = VectorAssembler(inputCols=features, outputCol="v").transform(filled)
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    matrix = np.nan_to_num(matrix)
    np.fill_diagonal(matrix, 1.0)
    return matrix


def correlation_pairs(df: DataFrame, features: list[str], threshold: float = 0.5) -> DataFrame:
    """Pairs of features with r and whether |r| exceeds the threshold."""
    matrix = correlation_matrix(df, features)
    rows = [(a, b, float(matrix[features.index(a), features.index(b)]))
            for a, b in combinations(features, 2)]
    table = df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")
    return table.withColumn("collinear", F.abs("r") > threshold)


def variance_inflation(df: DataFrame, features: list[str]) -> DataFrame:
    """VIF per feature; null where the matrix is singular in that direction."""
    matrix = correlation_matrix(df, features)
    singular = np.linalg.matrix_rank(matrix) < len(features)
    inverse = np.linalg.pinv(matrix) if singular else np.linalg.inv(matrix)
    rows = []
    for i, name in enumerate(features):
        # with a pseudo-inverse a feature explained by the others shows 1 - R2 = 0
        others = [j for j in range(len(features)) if j != i]
        sub = matrix[np.ix_(others, others)]
        explained = float(matrix[i, others] @ np.linalg.pinv(sub) @ matrix[others, i])
        exact = singular and 1.0 - explained < 1e-9
        rows.append((name, None if exact else float(
            1.0 / (1.0 - explained) if singular else inverse[i, i])))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def zero_inflation(df: DataFrame, features: list[str]) -> DataFrame:
    """Share of zeros and of values up to one, among non-null values."""
    parts = df.agg(*[F.struct(
        F.avg((F.col(c) == 0).cast("double")).alias("share_zero"),
        F.avg((F.col(c) <= 1).cast("double")).alias("share_upto_one")).alias(c) for c in features])
    return parts.unpivot([], features, "feature", "s").select("feature", "s.*")


# --- classification metrics -----------------------------------------------------------


def confusion_metrics(df: DataFrame, keys: list[str], y: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall and F1 per group; 0 where undefined."""
    t, p = F.col(y) == 1, F.col(predicted) == 1

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(t & p).alias("_tp"), F.count_if(p).alias("_p"),
        F.count_if(t).alias("_t"), F.count_if(t == p).alias("_ok"))
    return counts.select(
        *keys, "n", (F.col("_ok") / F.col("n")).alias("accuracy"),
        ratio(F.col("_tp"), F.col("_p")).alias("precision"),
        ratio(F.col("_tp"), F.col("_t")).alias("recall"),
        ratio(2 * F.col("_tp"), F.col("_p") + F.col("_t")).alias("f1"))


def roc_runs(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score with running totals."""
    return running_counts(df, keys, score, {
        "pos": F.count_if(F.col(y) == 1), "neg": F.count_if(F.col(y) == 0)})


def auc(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; 0.5 with a single class."""
    runs = roc_runs(df, keys, y, score)
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    cases = F.max(F.col("pos_all") * F.col("neg_all").cast("double"))
    return runs.groupBy(*keys).agg(
        F.coalesce(won / F.nullif(cases, F.lit(0.0)), F.lit(0.5)).alias("auc"))


def roc_threshold(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Score whose ``>=`` rule has the largest sensitivity + specificity."""
    runs = roc_runs(df, keys, y, score)
    quality = (1 - F.col("pos_before") / F.col("pos_all")
               + F.col("neg_before") / F.col("neg_all"))
    best = F.max(F.struct(F.round(quality, 9).alias("sens_plus_spec"),
                          (-F.col(score)).alias("_minus")))
    return runs.groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b._minus")).alias("threshold"), "b.sens_plus_spec")


def nagelkerke(df: DataFrame, keys: list[str], y: str, probability: str) -> DataFrame:
    """Nagelkerke pseudo R2 of predicted probabilities."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1 - p))
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit).alias("ll"),
                                 F.avg(F.col(y).cast("double")).alias("base"))
    base = F.col("base")
    null_ll = base * F.log(base) + (1 - base) * F.log(1 - base)
    r2 = (1 - F.exp(2 * (null_ll - F.col("ll")))) / (1 - F.exp(2 * null_ll))
    return sums.select(*keys, "n", r2.alias("nagelkerke_r2"))


# --- ranks and survival ---------------------------------------------------------------


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction and eta squared; rows fold to (group, value) first."""
    runs = running_counts(df, [], value)
    mean_rank = F.col("n_before") + (F.col("n") + 1) / 2
    ranked = runs.select(value, mean_rank.alias("_rank"), F.col("n").alias("_ties"), "n_all")
    cells = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(
        F.count("*").alias("m")).join(ranked, value)
    groups = cells.groupBy(group).agg(
        F.sum(F.col("m") * F.col("_rank")).alias("_r"), F.sum("m").alias("_m"),
        F.max("n_all").alias("n"))
    ties = runs.agg(F.sum(F.col("n").cast("double") * (F.col("n").cast("double") * F.col("n") - 1))).scalar()
    n = F.col("n").cast("double")
    h = ((F.col("_s") * 12 / (n * (n + 1)) - 3 * (n + 1))
         / F.nullif(1 - F.col("_ties") / (n * n * n - n), F.lit(0.0)))
    return groups.agg(
        F.max("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("_r") * F.col("_r") / F.col("_m")).alias("_s"),
    ).withColumn("_ties", ties).withColumn("h", h).select(
        "n", "k", "h", ((F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k"))).alias("eta_squared"))


def kaplan_meier(df: DataFrame, keys: list[str], days: str, event: str) -> DataFrame:
    """Share not yet at the event by day; ``days`` are whole days, so the table is short."""
    by_day = df.groupBy(*keys, days).agg(
        F.count_if(F.col(event)).alias("n_events"), F.count("*").alias("_leaving"))
    later = W.partitionBy(*keys).orderBy(days)
    onward = later.rowsBetween(W.currentRow, W.unboundedFollowing)
    upto = later.rowsBetween(W.unboundedPreceding, W.currentRow)
    hazard = F.col("n_events") / F.col("n_at_risk")
    risk = by_day.withColumn("n_at_risk", F.sum("_leaving").over(onward))
    ended = F.max(F.when(hazard == 1, 1).otherwise(0)).over(upto)
    log_sum = F.sum(F.when(hazard < 1, F.log(1 - hazard)).otherwise(0.0)).over(upto)
    return risk.select(
        *keys, days, "n_at_risk", "n_events", hazard.alias("hazard"),
        F.when(ended == 1, 0.0).otherwise(F.exp(log_sum)).alias("survival"))
