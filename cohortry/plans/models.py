"""Queries that fit models. They are seeded; results are metric tables without a SQL twin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators import (blocks as BL, classify as CL, cluster as K, evaluate as E, experiments as EX,
                                labels, mlprep as MP, rotate as R, sampling as M, stats as ST, thresholds as TH)
from cohortry.plans import inputs as I
from cohortry.plans.registry import query
from cohortry.plans.samples import _CTES, drawn
from cohortry.plans.sql_base import sql, tier_d
from cohortry.session import materialize


# rows of one draw of an account type, and draws; small enough to leave rows out at every scale
ACCOUNT_ROWS, ACCOUNT_DRAWS = 100, 5


def population(spark, sf):
    """Enriched tier D users with the composite velocity and their own median label."""
    return I.layer(spark, sf, "tier_d_enriched", lambda: EX.with_velocity_score(
        I.tier_d(I.users_enriched(spark, sf))))


def contributors(spark, sf):
    return population(spark, sf).filter(X.tier_d(2))


def labelled(spark, sf):
    """Tier D with ``y`` and a 70/30 split stratified by tertile."""
    return I.layer(spark, sf, "tier_d_split", lambda: M.split_train_test(
        materialize(labels.group_median_label(population(spark, sf), [])), ["persist_tertile"]))


def scaled(spark, sf, features):
    return materialize(MP.standardize(
        population(spark, sf).select(*EX.KEEP, *features), features))


# --- projections --------------------------------------------------------------------------


@query("m13_pca_loadings")
def pca_loadings(spark, sf):
    features = C.PCA_FEATURES
    return R.fit_pca(scaled(spark, sf, features), features, 3).table(spark)


_PAIRS = [(a, b) for i, a in enumerate(C.PCA_FEATURES) for b in C.PCA_FEATURES[i:]]


@query("m13_pca_rebuilds_correlations", sql("all", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(coalesce(corr(coalesce({a}, 0)::DOUBLE, coalesce({b}, 0)::DOUBLE), 0), 5) AS r FROM d"
    for a, b in _PAIRS), f"""d AS (SELECT u.*, e.* EXCLUDE (iso3_code) FROM users_labelled u
  LEFT JOIN enrichment e USING (iso3_code) WHERE {tier_d()})"""))
def rebuilt_correlations(spark, sf):
    """All components together, each with its variance, give the correlations back."""
    data = scaled(spark, sf, C.PCA_FEATURES)
    fitted = R.fit_pca(data, C.PCA_FEATURES, len(C.PCA_FEATURES))
    spread = data.agg(*[F.var_pop(f).alias(f) for f in C.PCA_FEATURES]).head()
    whole = sum(v for v in spread if v)  # shares are of the whole variance
    r = fitted.weights @ np.diag(fitted.variance * whole) @ fitted.weights.T
    rows = [(a, b, round(float(r[C.PCA_FEATURES.index(a), C.PCA_FEATURES.index(b)]), 5) + 0.0) for a, b in _PAIRS]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, r double")


@query("m13_pca_scores")
def pca_scores(spark, sf):
    data = scaled(spark, sf, C.PCA_FEATURES)
    fitted = R.fit_pca(data, C.PCA_FEATURES, 3)
    return fitted.apply(data).select("USER_ID", *fitted.names)


@query("m14_varimax_loadings")
def varimax_loadings(spark, sf):
    features = C.FEATURE_SETS["volume_reduced"]
    return R.fit_varimax(scaled(spark, sf, features), features, 5).table(spark)


@query("m15_factor_loadings")
def factor_loadings(spark, sf):
    features = C.FEATURE_SETS["volume_reduced"]
    return R.fit_factors(scaled(spark, sf, features), features, 5).table(spark)


@query("m16_ica_loadings")
def ica_loadings(spark, sf):
    features = C.FEATURE_SETS["volume_reduced"]
    return R.fit_ica(scaled(spark, sf, features), features, 4).table(spark)


@query("m17_discriminant_axis")
def discriminant(spark, sf):
    data = scaled(spark, sf, C.FEATURE_SETS["behavioral_only"])
    fitted = R.fit_discriminant(data, C.FEATURE_SETS["behavioral_only"], "persist_median")
    return ST.auc(fitted.apply(data, "score"), [], "persist_median", "score").withColumn(
        "n_features", F.lit(len(fitted.features)))


@query("m49_scree")
def scree(spark, sf):
    features = C.PCA_FEATURES
    return R.scree(spark, R.fit_pca(scaled(spark, sf, features), features, 8))


@query("o4_top_loadings")
def top_loadings(spark, sf):
    features = C.PCA_FEATURES
    return R.top_loadings(spark, R.fit_pca(scaled(spark, sf, features), features, 3))


# --- classification -----------------------------------------------------------------------


@query("m18_logistic_blocks")
def logistic(spark, sf):
    return CL.compare_blocks(labelled(spark, sf), CL.BLOCKS, ["LogReg"])[0]


@query("m19_forest_importance")
def forest(spark, sf):
    full = {"B6_Full": CL.BLOCKS["B6_Full"]}
    return CL.compare_blocks(labelled(spark, sf), full, ["RF"])[1]


@query("m21_block_comparison")
def blocks(spark, sf):
    both = CL.BLOCKS | {"B4_without_components": CL.NO_COMPONENTS}
    return CL.compare_blocks(labelled(spark, sf), both, ["LDA"])[0]


@query("m21_three_blocks_forest")
def three_blocks(spark, sf):
    return CL.compare_blocks(labelled(spark, sf), CL.THREE_BLOCKS, ["RF"])[0]


@query("m21_block_deltas")
def deltas(spark, sf):
    metrics, _ = CL.compare_blocks(labelled(spark, sf), CL.THREE_BLOCKS, ["LDA", "LogReg"])
    return CL.block_deltas(metrics)


def subsample_rows(spark, sf):
    """Drawn users with their split, all block features and their label within the subsample."""
    picked = drawn(spark, sf).select("subsample_id", "USER_ID", "split")
    rows = materialize(picked.join(population(spark, sf), "USER_ID"))
    return labels.group_median_label(rows, ["subsample_id"])


def _compared(spark, sf, name, build):
    """Metrics and importances of one comparison, fitted once."""
    found = []

    def run():
        if not found:
            found.append(build())
        return found[0]

    return (I.layer(spark, sf, f"{name}_metrics", lambda: run()[0]),
            I.layer(spark, sf, f"{name}_importances", lambda: run()[1]))


def subsample_comparison(spark, sf):
    return _compared(spark, sf, "subsample_blocks", lambda: BL.compare_subsamples(
        materialize(subsample_rows(spark, sf)), ["subsample_id"], CL.BLOCKS))


@query("m21_subsample_results")
def subsample_results(spark, sf):
    """Six blocks, three models, every subsample; with the largest gradient of each logistic fit."""
    return subsample_comparison(spark, sf)[0]


@query("m21_subsample_blocks")
def subsample_blocks(spark, sf):
    """Mean and deviation over the subsamples of six blocks under three models."""
    return BL.summarise(subsample_comparison(spark, sf)[0], ["block", "model"])


@query("m21_subsample_deltas")
def subsample_deltas(spark, sf):
    """What each half adds to the full block in every subsample, averaged per model."""
    found = CL.block_deltas(subsample_comparison(spark, sf)[0], ["subsample_id", "model"])
    names = [c for c in found.columns if c not in ("subsample_id", "model")]
    return found.groupBy("model").agg(F.count("*").alias("subsamples"), *[
        f(n).alias(f"{p}_{n}") for n in names for p, f in (("mean", F.avg), ("std", F.stddev_samp))])


def account_type_comparison(spark, sf):
    """Three blocks, three models, five subsamples of all contributors and of each account type."""
    def build():
        users = M.by_account_type(contributors(spark, sf).drop("group"))
        draws = M.repeated_samples(users, ACCOUNT_ROWS, ACCOUNT_DRAWS, "group")
        rows = materialize(draws.join(users, ["group", "USER_ID"]))
        marked = materialize(labels.group_median_label(rows, ["group", "subsample_id"]))
        split = M.split_train_test(marked.withColumn("draw_key", F.concat_ws("|", "group", "subsample_id", "USER_ID")),
                                   ["group", "subsample_id", "persist_tertile"], key="draw_key")
        return BL.compare_subsamples(materialize(split), ["group", "subsample_id"], CL.THREE_BLOCKS)

    return _compared(spark, sf, "account_type_blocks", build)


@query("m21_account_type_blocks")
def account_type_blocks(spark, sf):
    return BL.summarise(account_type_comparison(spark, sf)[0], ["group", "block", "model"])


@query("m21_account_type_deltas")
def account_type_deltas(spark, sf):
    found = CL.block_deltas(account_type_comparison(spark, sf)[0], ["group", "subsample_id", "model"])
    return found.groupBy("group", "model").agg(F.avg("delta_H1").alias("mean_delta_H1"), F.avg("delta_H0").alias("mean_delta_H0"))


@query("m12_velocity_variants")
def velocity_variants(spark, sf):
    """Each form of the velocity features, alone and next to volume and sequencing."""
    rows = labelled(spark, sf)
    logs = {f"log_{t}": F.log1p(X.clip(t, lower=0)) for t in C.TRANSITIONS}
    slow = {f"slow_{t}": (F.coalesce(F.col(t), F.lit(0)) > 0).cast("int") for t in C.TRANSITIONS}
    ready = materialize(rows.withColumns(logs | slow))
    base = materialize(MP.standardize(ready.select("USER_ID", *C.TRANSITIONS), C.TRANSITIONS))
    pcs = R.fit_pca(base, C.TRANSITIONS, 3)
    ready = materialize(ready.join(pcs.apply(base).select("USER_ID", *pcs.names), "USER_ID"))
    variants = {
        "original": C.VELOCITY, "transitions": C.TRANSITIONS, "log_transitions": list(logs),
        "pca_3": pcs.names, "composite": ["velocity_score"],
        "log_transitions_speed": [*logs, "activation_speed"], "binary_flags": list(slow),
    }
    other = ["log_logins_pw", "tree_edits_90d", "names_90d", "activity_breadth", "funnel_stage"]
    both = {f"{name}|joint": features + other for name, features in variants.items()}
    found = CL.discriminant_auc(ready, [], "y", {**{f"{n}|alone": f for n, f in variants.items()}, **both})
    parts = F.split("block", r"\|")
    return found.groupBy(parts[0].alias("variant")).agg(
        F.max(F.when(parts[1] == "alone", F.col("auc"))).alias("auc_alone"),
        F.max(F.when(parts[1] == "joint", F.col("auc"))).alias("auc_joint"))


def population_importances(spark, sf):
    """Importances of the full block under three models, each fitted on all training rows of tier D."""
    full = {"B6_Full": CL.BLOCKS["B6_Full"]}
    return I.layer(spark, sf, "population_importances", lambda: CL.compare_blocks(
        labelled(spark, sf), full, ["LDA", "LogReg", "RF"])[1])


@query("m22_importance_shares")
def importance_shares(spark, sf):
    """Share of each construct in the mean importances of the full block, by model."""
    return CL.construct_shares(population_importances(spark, sf), ["model"])


def subsample_shares(spark, sf):
    """The same, of the fits on the subsamples."""
    found = subsample_comparison(spark, sf)[1].filter(F.col("block") == "B6_Full")
    return CL.construct_shares(found, ["model"])


@query("m22_evidence_verdicts")
def evidence_verdicts(spark, sf):
    """All four kinds of evidence: loadings, pseudo R2 gains, association and the spread of AUC."""
    shares = subsample_shares(spark, sf).filter("model = 'LDA'")
    loading = shares.agg(F.sum(F.when(F.col("construct") != "Contextual", F.col("share"))).alias("value")).select(
        F.lit("loading_share").alias("kind"), "value", F.lit(None).cast("double").alias("other"))
    gains = subsample_deltas(spark, sf).filter("model = 'LogReg'").select(
        F.lit("incremental_r2").alias("kind"), F.col("mean_r2_engagement_beyond_context").alias("value"),
        F.col("mean_r2_context_beyond_engagement").alias("other"))
    users = materialize(labelled(spark, sf))
    related = ST.association(users, "funnel_stage", "y").select(
        F.lit("cramers_v").alias("kind"), F.col("cramers_v").alias("value"), F.lit(None).cast("double").alias("other"))
    by_cluster = ST.auc(users, ["country_cluster"], "y", "logins_90d").agg(
        (F.max("auc") - F.min("auc")).alias("value")).select(
        F.lit("auc_range").alias("kind"), "value", F.lit(None).cast("double").alias("other"))
    return E.verdict(loading.unionByName(gains).unionByName(related).unionByName(by_cluster))


@query("m23_mixture_threshold")
def mixture_threshold(spark, sf):
    """Two normal components on the score, five starts; the upper one against the median label."""
    rows = labelled(spark, sf).select("persistence_c", "y")
    fit = TH.group_mixtures(rows, [], "persistence_c")
    placed = rows.withColumns(
        {c: fit.select(c).scalar() for c in ("share_low", "mean_low", "var_low", "share_high", "mean_high", "var_high")})
    upper = TH.in_upper("persistence_c").cast("int")
    return placed.withColumn("upper", upper).agg(
        F.min(F.when(F.col("upper") == 1, F.col("persistence_c"))).alias("threshold"),
        F.avg("upper").alias("share_upper"),
        F.avg((F.col("upper") == F.col("y")).cast("double")).alias("agreement_with_median"))


# --- thresholds over subsamples -----------------------------------------------------------


def threshold_rows(spark, sf):
    """Drawn users with their score and whether their activity is broad for their subsample."""
    rows = materialize(drawn(spark, sf).select("subsample_id", "USER_ID", "persistence_c", "activity_breadth"))
    return materialize(labels.group_median_label(rows, ["subsample_id"], "activity_breadth", "broad"))


def thresholds(spark, sf):
    rows, found = threshold_rows(spark, sf), []

    def run():
        if not found:
            found.append(TH.threshold_labels(rows, ["subsample_id"], "persistence_c", "broad"))
        return found[0]

    return (I.layer(spark, sf, "threshold_labels", lambda: run()[0]), I.layer(spark, sf, "threshold_cuts", lambda: run()[1]))


@query("m42_threshold_methods")
def threshold_methods(spark, sf):
    """Cuts of three methods in every subsample, and how often each two class a user alike."""
    placed, cuts = thresholds(spark, sf)
    return TH.pairwise_agreement(placed, ["subsample_id"]).join(cuts, "subsample_id")


@query("m42_method_stability")
def method_stability(spark, sf):
    """Agreement of each method between subsamples on the users they share; the steadiest is adopted."""
    return TH.stability(thresholds(spark, sf)[0], "USER_ID")


_RULES = f"""
, rows_of AS (SELECT subsample_id, USER_ID, persistence_c AS x, median(persistence_c) OVER g AS med,
    CAST(activity_breadth >= median(activity_breadth) OVER g AS INTEGER) AS broad
  FROM drawn WINDOW g AS (PARTITION BY subsample_id)),
runs AS (SELECT subsample_id, x, count(*) FILTER (WHERE broad = 1) AS pos, count(*) FILTER (WHERE broad = 0) AS neg
  FROM rows_of GROUP BY ALL),
quality AS (SELECT subsample_id, x, round(1.0::DOUBLE - coalesce(sum(pos) OVER w, 0) / sum(pos) OVER g
    + coalesce(sum(neg) OVER w, 0) / sum(neg) OVER g, 9) AS q FROM runs
  WINDOW g AS (PARTITION BY subsample_id),
    w AS (PARTITION BY subsample_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
roc_cuts AS (SELECT subsample_id, x AS roc FROM quality QUALIFY row_number() OVER (PARTITION BY subsample_id ORDER BY q DESC, x) = 1)"""


@query("m42_rule_thresholds", sql("label", f"""{_RULES}
SELECT subsample_id, count(*) AS n, round(any_value(med), 6) AS median, round(any_value(roc), 6) AS roc,
  round(avg(CAST(x >= med AS INTEGER)), 6) AS share_median, round(avg(CAST(x >= roc AS INTEGER)), 6) AS share_roc,
  round(avg(CAST((x >= med) = (x >= roc) AS INTEGER)), 6) AS agree_median_roc
FROM rows_of JOIN roc_cuts USING (subsample_id) GROUP BY subsample_id""", *_CTES))
def rule_thresholds(spark, sf):
    placed, cuts = thresholds(spark, sf)
    found = TH.pairwise_agreement(placed, ["subsample_id"]).join(cuts, "subsample_id")
    return found.select("subsample_id", "n", *[F.round(c, 6).alias(c) for c in (
        "median", "roc", "share_median", "share_roc", "agree_median_roc")])


@query("m42_mixture_moments", sql("label", """
SELECT subsample_id, count(*) AS n, round(avg(persistence_c), 5) AS mean, round(var_pop(persistence_c), 5) AS variance
FROM drawn GROUP BY subsample_id""", *_CTES))
def mixture_moments(spark, sf):
    """A settled mixture has the mean and variance of its rows."""
    _, cuts = thresholds(spark, sf)
    n = threshold_rows(spark, sf).groupBy("subsample_id").agg(F.count("persistence_c").alias("n"))
    mean = F.col("share_low") * F.col("mean_low") + F.col("share_high") * F.col("mean_high")
    second = sum(F.col(f"share_{s}") * (F.col(f"var_{s}") + F.col(f"mean_{s}") ** 2) for s in ("low", "high"))
    return cuts.join(n, "subsample_id").select("subsample_id", "n", F.round(mean, 5).alias("mean"),
                                               F.round(second - mean * mean, 5).alias("variance"))


# --- clustering ---------------------------------------------------------------------------


@query("m37_contextual_tiers")
def tiers(spark, sf):
    placed, _ = EX.contextual_tiers(contributors(spark, sf))
    return ST.gradients(placed, "tier", "PC1", "persistence_c")


@query("m37_tier_curves")
def tier_curves(spark, sf):
    placed, _ = EX.contextual_tiers(contributors(spark, sf))
    return ST.curve_fits(materialize(placed), "tier", "PC1", "persistence_c")


@query("m38_refined_tiers")
def refined(spark, sf):
    scores = materialize(EX.refined_scores(contributors(spark, sf)))
    return EX.tier_selection(scores, "development_score", list(range(2, 9)))


@query("m38_refined_profiles")
def refined_profiles(spark, sf):
    scores = materialize(EX.refined_scores(contributors(spark, sf)))
    placed = K.ordered_tiers(scores, "development_score", 2)
    return ST.gradients(placed, "tier", "behavioral_residual", "persistence_c")
