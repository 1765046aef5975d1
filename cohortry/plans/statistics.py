"""Queries on statistics, feature matrices and cluster quality with exact counterparts.

Cluster measures run on labels that are fixed by rules (funnel stage, segment), so SQL
can check them; fitted labels appear in the model queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators import evaluate as E, mlprep as MP, profile as P, stats as ST
from cohortry.plans import inputs as I
from cohortry.plans.registry import query
from cohortry.plans.samples import _CTES, drawn
from cohortry.plans.sql_base import sql, tier_d, z
from cohortry.session import materialize

_D = f"d AS (SELECT * FROM users_labelled WHERE {tier_d()})"
_TR = f"d AS (SELECT * FROM users_labelled WHERE NOT is_mnar)"
_X3 = ["logins_90d", "log_tree_edits_pw", "activity_breadth"]


def tier(spark, sf, columns=None):
    users = I.tier_d(I.users_labelled(spark, sf))
    return users.select(*columns) if columns else users


def r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def cols(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# --- feature matrices -----------------------------------------------------------------


@query("m1_feature_matrix", sql("label", f"""
, tr AS (SELECT * FROM split WHERE subsample_id = 1 AND split = 'train'),
ages AS (SELECT DISTINCT age_group AS g FROM tr WHERE age_group IS NOT NULL),
base AS (SELECT min(g) AS g0 FROM ages)
SELECT USER_ID, coalesce(days_to_first_login, 0)::DOUBLE AS days_to_first_login,
  round(coalesce(activation_speed, 0), 9) AS activation_speed, """ + ", ".join(
    f"CAST(coalesce(age_group = '{g}' AND g0 <> '{g}' AND '{g}' IN (SELECT g FROM ages), FALSE) AS INTEGER)::DOUBLE"
    f" AS \"age_group_{g}\"" for g in C.AGE_LABELS)
    + " FROM split, base WHERE subsample_id = 1", *_CTES))
def feature_matrix(spark, sf):
    rows = drawn(spark, sf).filter(F.col("subsample_id") == 1)
    levels = MP.categories(rows.filter(F.col("split") == "train"), ["age_group"])
    out, names = MP.feature_matrix(rows, ["days_to_first_login", "activation_speed"], levels, ["USER_ID"])
    # the first level and levels that training lacks have no column; show them as zero
    absent = {f"age_group_{g}": F.lit(0.0) for g in C.AGE_LABELS if f"age_group_{g}" not in names}
    return r(out.withColumns(absent) if absent else out, "activation_speed", digits=9)


_SCALED = ["logins_90d", "log_tree_edits_pw", "user_age"]


@query("m2_standard_scaler", sql("label", f"""
, s AS (SELECT {', '.join(f"avg(coalesce({c}, 0)) AS m{i}, stddev_pop(coalesce({c}, 0)) AS s{i}"
                          for i, c in enumerate(_SCALED))} FROM d)
SELECT USER_ID, {', '.join(f"round((coalesce({c}, 0) - m{i}) / s{i}, 6) AS {c}"
                           for i, c in enumerate(_SCALED))} FROM d, s""", _D))
def standard(spark, sf):
    return r(MP.standardize(tier(spark, sf, ["USER_ID", *_SCALED]), _SCALED), *_SCALED)


@query("m3_min_max_scaler", sql("label", f"""
, s AS (SELECT {', '.join(f"min(coalesce({c}, 0)) AS m{i}, max(coalesce({c}, 0)) - min(coalesce({c}, 0)) AS s{i}"
                          for i, c in enumerate(_SCALED))} FROM d)
SELECT USER_ID, {', '.join(f"round((coalesce({c}, 0) - m{i}) / s{i}, 6) AS {c}"
                           for i, c in enumerate(_SCALED))} FROM d, s""", _D))
def min_max(spark, sf):
    return r(MP.min_max(tier(spark, sf, ["USER_ID", *_SCALED]), _SCALED), *_SCALED)


@query("m3_robust_scaler", sql("label", f"""
, s AS (SELECT {', '.join(f"median(coalesce({c}, 0)) AS m{i}, quantile_cont(coalesce({c}, 0), 0.75) - "
                          f"quantile_cont(coalesce({c}, 0), 0.25) AS s{i}" for i, c in enumerate(_SCALED))} FROM d)
SELECT USER_ID, {', '.join(f"round((coalesce({c}, 0) - m{i}) / (CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END), 6) AS {c}"
                           for i, c in enumerate(_SCALED))} FROM d, s""", _D))
def robust(spark, sf):
    return r(MP.robust(tier(spark, sf, ["USER_ID", *_SCALED]), _SCALED), *_SCALED)


_WEIGHTED = ["days_to_first_login", "activation_speed", "logins_90d", "activity_breadth", "user_age"]


def _weight_sql():
    parts = []
    for strategy in C.WEIGHTINGS:
        for f in _WEIGHTED:
            kind = C.construct_of(f)
            if strategy == "equal_construct":
                w = 1.0 / sum(C.construct_of(g) == kind for g in _WEIGHTED)
            else:
                w = C.WEIGHT_BY_CONSTRUCT[strategy].get(kind, 1.0)
            parts.append(f"SELECT '{strategy}' AS strategy, '{f}' AS feature, "
                         f"round(sum(coalesce({f}, 0) * {w}::DOUBLE), 4) AS total FROM d")
    return " UNION ALL ".join(parts)


@query("m4_construct_weights", sql("label", _weight_sql(), _D))
def construct_weights(spark, sf):
    base = tier(spark, sf, _WEIGHTED).select(*[MP.filled(c).alias(c) for c in _WEIGHTED])
    out = None
    for strategy in C.WEIGHTINGS:
        sums = MP.apply_weights(base, _WEIGHTED, strategy).agg(
            *[F.round(F.sum(c), 4).alias(c) for c in _WEIGHTED])
        part = sums.unpivot([], _WEIGHTED, "feature", "total").withColumn("strategy", F.lit(strategy))
        out = part if out is None else out.unionByName(part)
    return out


_VOLUME = ["logins_90d", "tree_edits_90d", "log_names_pw"]


@query("m5_compress_log_sqrt", sql("label", """
SELECT USER_ID, round(ln(1 + logins_90d), 6) AS log_logins, round(ln(1 + tree_edits_90d), 6) AS log_edits,
  round(log_names_pw, 6) AS log_names, round(sqrt(logins_90d), 6) AS sqrt_logins,
  round(sqrt(log_names_pw), 6) AS sqrt_names FROM d""", _D))
def compress(spark, sf):
    base = tier(spark, sf, ["USER_ID", *_VOLUME])
    logs = MP.compress_volume(base, _VOLUME, "log").select(
        "USER_ID", F.round("logins_90d", 6).alias("log_logins"),
        F.round("tree_edits_90d", 6).alias("log_edits"), F.round("log_names_pw", 6).alias("log_names"))
    roots = MP.compress_volume(base, _VOLUME, "sqrt").select(
        "USER_ID", F.round("logins_90d", 6).alias("sqrt_logins"),
        F.round("log_names_pw", 6).alias("sqrt_names"))
    return logs.join(roots, "USER_ID")


@query("m5_compress_rank", sql("label", "SELECT USER_ID, " + ", ".join(
    f"round((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER (), 9) AS {c}"
    for c in _VOLUME) + " FROM d", _D))
def compress_rank(spark, sf):
    return r(MP.compress_volume(tier(spark, sf, ["USER_ID", *_VOLUME]), _VOLUME, "rank"), *_VOLUME, digits=9)


@query("m5_compress_winsor", sql("label", "SELECT USER_ID, " + ", ".join(
    f"round(least({c}, quantile_cont({c}, 0.95) OVER ()), 6) AS {c}" for c in _VOLUME) + " FROM d", _D))
def compress_winsor(spark, sf):
    return r(MP.compress_volume(tier(spark, sf, ["USER_ID", *_VOLUME]), _VOLUME, "winsor"), *_VOLUME)


@query("a14_velocity_composite", sql("label", f"""
, s AS (SELECT {', '.join(f"avg(coalesce({c}, 0)) AS m{i}, greatest(stddev_samp(coalesce({c}, 0)), 0.001) AS s{i}"
                          for i, c in enumerate(C.TRANSITIONS))} FROM d)
SELECT USER_ID, round(-({' + '.join(f"(coalesce({c}, 0) - m{i}) / s{i}" for i, c in enumerate(C.TRANSITIONS))})
  / 3, 6) AS velocity_score FROM d, s""", _D))
def velocity_composite(spark, sf):
    scored = MP.mean_of_z(tier(spark, sf, ["USER_ID", *C.TRANSITIONS]), C.TRANSITIONS, "velocity_score")
    return r(scored.select("USER_ID", "velocity_score"), "velocity_score")


@query("a15_mean_std_over_runs", sql("label", """
SELECT split, round(avg(m), 6) AS mean_score, round(stddev_samp(m), 6) AS std_score FROM (
  SELECT subsample_id, split, avg(persistence_c) AS m FROM split GROUP BY 1, 2) GROUP BY split""", *_CTES))
def over_runs(spark, sf):
    runs = drawn(spark, sf).groupBy("subsample_id", "split").agg(F.avg("persistence_c").alias("m"))
    return runs.groupBy("split").agg(F.round(F.avg("m"), 6).alias("mean_score"),
                                     F.round(F.stddev_samp("m"), 6).alias("std_score"))


_IMP = ["days_to_first_login", "activation_speed", "logins_90d", "tree_edits_90d", "activity_breadth", "user_age"]
_KIND = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{C.construct_of(f)}'" for f in _IMP) + " END"


@query("a16_importance_by_construct", sql("label", f"""
, imp AS ({' UNION ALL '.join(f"SELECT subsample_id, '{f}' AS feature, abs(corr(coalesce({f}, 0), persistence_c)) "
                              f"AS importance FROM split GROUP BY subsample_id" for f in _IMP)}),
m AS (SELECT feature, avg(importance) AS importance FROM imp GROUP BY feature)
SELECT {_KIND} AS construct, round(sum(importance) / sum(sum(importance)) OVER () * 100, 4) AS share
FROM m GROUP BY 1""", *_CTES))
def importance(spark, sf):
    """Importance here is |r| with persistence in each subsample; models feed the same step."""
    rows = drawn(spark, sf).groupBy("subsample_id").agg(
        *[F.abs(F.corr(MP.filled(f), "persistence_c")).alias(f) for f in _IMP])
    from cohortry.operators.classify import construct_shares

    return r(construct_shares(rows.unpivot("subsample_id", _IMP, "feature", "importance")).select(
        "construct", "share"), "share", digits=4)


# --- association, regression, correlation -----------------------------------------------


def _chi_sql(a, b, source="d"):
    return f"""
cells AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY 1, 2),
mar AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c, sum(n) OVER () AS t FROM cells),
fit AS (SELECT CAST(max(t) AS BIGINT) AS n, count(DISTINCT a) AS n_rows, count(DISTINCT b) AS n_cols,
  max(t) * (sum(n::DOUBLE * n / (r * c)) - 1) AS plain,
  max(greatest(abs(n - r * c / t) - 0.5, 0)) AS gap, sum(t / (r * c)) AS inv FROM mar)"""


@query("m6_cramers_v", sql("label", """
SELECT n, n_rows, n_cols, n_rows = 2 AND n_cols = 2 AS corrected, round(plain, 6) AS chi2,
  round(sqrt(plain / (n * (least(n_rows, n_cols) - 1))), 6) AS cramers_v FROM fit""",
    _D, _chi_sql("funnel_stage", "persist_tertile")))
def cramers(spark, sf):
    return r(ST.association(tier(spark, sf), "funnel_stage", "persist_tertile"), "chi2", "cramers_v")


@query("m6_cramers_v_2x2", sql("label", """
SELECT n, n_rows, n_cols, n_rows = 2 AND n_cols = 2 AS corrected, round(gap * gap * inv, 6) AS chi2,
  round(sqrt(gap * gap * inv / n), 6) AS cramers_v FROM fit""",
    _D, _chi_sql("has_sources", "persist_median")))
def cramers_2x2(spark, sf):
    return r(ST.association(tier(spark, sf), "has_sources", "persist_median"), "chi2", "cramers_v")


@query("m6_contingency", sql("label", """
SELECT activity_segment, persist_tertile, count(*) AS n FROM d GROUP BY 1, 2""", _D))
def contingency(spark, sf):
    return ST.contingency(tier(spark, sf), "activity_segment", "persist_tertile")


def _residual_chain(y, xs, source, name="gs"):
    """Orthogonalise predictors one after another; the last column is what is left of y."""
    ctes, previous = [f"{name}0 AS (SELECT *, {', '.join(f'{x}::DOUBLE AS x{i}' for i, x in enumerate(xs))}, "
                      f"{y}::DOUBLE AS yy FROM {source})"], f"{name}0"
    for i in range(len(xs)):
        targets = [f"x{j}" for j in range(i + 1, len(xs))] + ["yy"]
        stats = ", ".join(f"regr_slope({t}, x{i}) AS b_{t}, regr_intercept({t}, x{i}) AS a_{t}" for t in targets)
        step = f"{name}{i + 1}"
        ctes.append(f"{step}s AS (SELECT {stats} FROM {previous})")
        repl = ", ".join(f"{t} - b_{t} * x{i} - a_{t} AS {t}" for t in targets)
        ctes.append(f"{step} AS (SELECT p.* REPLACE ({repl}) FROM {previous} p, {step}s)")
        previous = step
    return ",\n".join(ctes), previous


_CHAIN, _LAST = _residual_chain("persistence_c", C.PARTIAL_CONTROLS, "d2")
_D2 = f"d2 AS (SELECT * FROM users_labelled WHERE {tier_d(2)})"
_TARGETS = C.TRANSITIONS + ["activation_speed"]


@query("m7_partial_correlations", sql("label", " UNION ALL ".join(
    f"SELECT '{t}' AS feature, round(1 - var_pop(yy) / var_pop(persistence_c), 6) AS controls_r2, "
    f"round(corr({t}, persistence_c), 6) AS r_raw, round(corr({t}, yy), 6) AS r_partial FROM {_LAST}"
    for t in _TARGETS), _D2, _CHAIN))
def partial(spark, sf):
    users = tier_2(spark, sf)
    out = ST.partial_correlations(users, [], "persistence_c", C.PARTIAL_CONTROLS, _TARGETS)
    return r(out, "controls_r2", "r_raw", "r_partial")


def tier_2(spark, sf):
    return I.tier_d(I.users_labelled(spark, sf), 2)


def _partial_of(group: str) -> str:
    """The statement of ``m7_partial_correlations`` over one account type, as a subquery."""
    rows = f"d2 AS (SELECT * FROM users_labelled WHERE {tier_d(2)} AND ('{group}' = 'Full' OR ACCOUNT_TYPE = '{group}'))"
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS feature, round(1 - var_pop(yy) / var_pop(persistence_c), 6) AS controls_r2, "
        f"round(corr({t}, persistence_c), 6) AS r_raw, round(corr({t}, yy), 6) AS r_partial FROM {_LAST}" for t in _TARGETS)
    return f"SELECT '{group}' AS \"group\", * FROM (WITH {rows}, {_CHAIN} {parts})"


@query("m7_partial_by_account_type", sql("label", " UNION ALL ".join(map(_partial_of, ("Full", "Member", "Public")))))
def partial_by_group(spark, sf):
    from cohortry.operators.sampling import by_account_type

    users = by_account_type(tier_2(spark, sf)).select(
        "group", "persistence_c", *C.PARTIAL_CONTROLS, *_TARGETS)
    out = ST.partial_correlations(users, ["group"], "persistence_c", C.PARTIAL_CONTROLS, _TARGETS)
    return r(out, "controls_r2", "r_raw", "r_partial")


@query("m8_curve_fits", sql("label", """
, low AS (SELECT funnel_stage, min(logins_90d) AS m FROM d GROUP BY 1),
f AS (SELECT d.funnel_stage, persistence_c AS y, logins_90d AS x, logins_90d * logins_90d AS x2,
  ln(logins_90d - m + 0.1::DOUBLE + 1) AS lx FROM d JOIN low USING (funnel_stage)),
g AS (SELECT funnel_stage, count(*) AS n, regr_slope(y, x) AS lin_slope, regr_r2(y, x) AS r2_lin,
  regr_r2(y, lx) AS r2_log, var_pop(x) AS sxx, var_pop(x2) AS szz, covar_pop(x, x2) AS sxz,
  covar_pop(x, y) AS sxy, covar_pop(x2, y) AS szy, var_pop(y) AS syy FROM f GROUP BY 1),
q AS (SELECT *, (szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS b1,
  (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS b2 FROM g),
o AS (SELECT *, (b1 * sxy + b2 * szy) / syy AS r2_quad FROM q)
SELECT funnel_stage, n, n >= 30 AS enough_rows, CASE WHEN n >= 30 THEN round(lin_slope, 6) END AS lin_slope,
  CASE WHEN n >= 30 THEN round(r2_lin, 6) END AS r2_lin, CASE WHEN n >= 30 THEN round(r2_log, 6) END AS r2_log,
  CASE WHEN n >= 30 THEN round(r2_quad, 6) END AS r2_quad, CASE WHEN n >= 30 THEN round(b2, 6) END AS quad_a,
  CASE WHEN n >= 30 THEN round(greatest(r2_quad, r2_log) - r2_lin, 6) END AS delta_r2,
  CASE WHEN n < 30 THEN NULL WHEN r2_log > r2_quad THEN 'Log' ELSE 'Quad' END AS best_model FROM o""", _D))
def curve_fits(spark, sf):
    users = tier(spark, sf, ["funnel_stage", "logins_90d", "persistence_c"])
    out = ST.curve_fits(users, "funnel_stage", "logins_90d", "persistence_c")
    return r(out, "lin_slope", "r2_lin", "r2_log", "r2_quad", "quad_a", "delta_r2")


_ADD, _ADD_LAST = _residual_chain("persistence_c", ["log_logins_pw", "funnel_stage"], "d", "ad")
_INT, _INT_LAST = _residual_chain(
    "persistence_c", ["log_logins_pw", "funnel_stage", "(log_logins_pw * funnel_stage)"], "d", "it")


@query("m9_interaction_model", sql("label", f"""
, a AS (SELECT 1 - var_pop(yy) / var_pop(persistence_c) AS r2a FROM {_ADD_LAST}),
i AS (SELECT count(*) AS n, 1 - var_pop(yy) / var_pop(persistence_c) AS r2i,
  regr_slope(yy_before, x2) AS coef FROM (SELECT l.*, b.yy AS yy_before FROM {_INT_LAST} l
  JOIN it2 b USING (USER_ID)))
SELECT n, round(r2a, 6) AS r2_additive, round(r2i, 6) AS r2_interaction, round(r2i - r2a, 6) AS r2_gain,
  round((r2i - r2a) / ((1 - r2i) / (n - 4)), 3) AS f_statistic, round(coef, 6) AS interaction FROM a, i""",
    _D, _ADD, _INT))
def interaction(spark, sf):
    users = tier(spark, sf, ["log_logins_pw", "funnel_stage", "persistence_c"])
    out = ST.interaction_model(users, "log_logins_pw", "funnel_stage", "persistence_c").drop("p_value")
    return r(r(out, "r2_additive", "r2_interaction", "r2_gain", "interaction"), "f_statistic", digits=3)


@query("m9_interaction_test")
def interaction_test(spark, sf):
    users = tier(spark, sf, ["log_logins_pw", "funnel_stage", "persistence_c"])
    return ST.interaction_model(users, "log_logins_pw", "funnel_stage", "persistence_c")


_T3 = C.TRANSITIONS


def _vif_sql():
    a, b, c = (f"coalesce({t}, 0)" for t in _T3)
    parts = []
    for name, (p, q, s) in zip(_T3, ((a, b, c), (b, a, c), (c, a, b))):
        parts.append(f"""SELECT '{name}' AS feature, round(1 / (1 - (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r3)
  / (1 - r3 * r3)), 6) AS vif FROM (SELECT corr({p}, {q}) AS r1, corr({p}, {s}) AS r2, corr({q}, {s}) AS r3 FROM d)""")
    return " UNION ALL ".join(parts)


@query("m10_vif_transitions", sql("label", _vif_sql(), _D))
def vif(spark, sf):
    return r(ST.variance_inflation(tier(spark, sf), _T3), "vif")


_VIFS = [(f, *_residual_chain(f"coalesce({f}, 0)", [f"coalesce({g}, 0)" for g in C.VELOCITY if g != f], "d", f"vif{i}_"))
         for i, f in enumerate(C.VELOCITY)]


@query("m10_vif_velocity", sql("label", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(var_pop(coalesce({f}, 0)) / var_pop(yy), 5) AS vif FROM {last}" for f, _, last in _VIFS),
    _D, *[chain for _, chain, _ in _VIFS]))
def vif_all(spark, sf):
    return r(ST.variance_inflation(tier(spark, sf), C.VELOCITY), "vif", digits=5)


@query("m11_zero_inflation", sql("label", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg(CASE WHEN {f} = 0 THEN 1.0::DOUBLE WHEN {f} IS NOT NULL THEN 0 END), 6) "
    f"AS share_zero, round(avg(CASE WHEN {f} <= 1 THEN 1.0::DOUBLE WHEN {f} IS NOT NULL THEN 0 END), 6) "
    f"AS share_upto_one FROM d" for f in _T3), _D))
def zero_inflation(spark, sf):
    return r(ST.zero_inflation(tier(spark, sf), _T3), "share_zero", "share_upto_one")


_CORR = ["days_to_first_login", "activation_speed", "logins_90d", "log_logins_pw", "tree_edits_90d",
         "activity_breadth", "tenure_days"]


@query("m40_correlation_blocks", sql("label", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(r, 6) AS r, abs(r) > 0.5 AS collinear FROM "
    f"(SELECT corr(coalesce({a}, 0), coalesce({b}, 0)) AS r FROM d)"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]), _D))
def correlation_blocks(spark, sf):
    return r(ST.correlation_pairs(tier(spark, sf), _CORR), "r")


# --- classification metrics and thresholds ------------------------------------------------

_PRED = "CASE WHEN activity_breadth >= 5 THEN 1 ELSE 0 END"


@query("m20_confusion_metrics", sql("label", f"""
, c AS (SELECT ACCOUNT_TYPE, count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
  count(*) FILTER (WHERE p = 1) AS pp, count(*) FILTER (WHERE y = 1) AS tt, count(*) FILTER (WHERE y = p) AS ok
  FROM (SELECT ACCOUNT_TYPE, persist_median AS y, {_PRED} AS p FROM d) GROUP BY 1)
SELECT ACCOUNT_TYPE, n, round(ok / n, 6) AS accuracy, round(coalesce(tp / nullif(pp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tt, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(pp + tt, 0), 0), 6) AS f1
FROM c""", _D))
def confusion(spark, sf):
    users = tier(spark, sf).withColumn("p", (F.col("activity_breadth") >= 5).cast("int"))
    out = ST.confusion_metrics(users, ["ACCOUNT_TYPE"], "persist_median", "p")
    return r(out, "accuracy", "precision", "recall", "f1")


def _auc_sql(key, score):
    part = f"PARTITION BY {key} " if key else ""
    cnt = f"count(*) OVER (PARTITION BY {key + ', ' if key else ''}{score})"
    pick = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""
SELECT {pick}round(CASE WHEN count(*) FILTER (WHERE y = 0) = 0 OR count(*) FILTER (WHERE y = 1) = 0 THEN 0.5
  ELSE (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2)
    / (count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 0))) END, 6) AS auc
FROM (SELECT *, persist_median AS y, rank() OVER ({part}ORDER BY {score}) + ({cnt} - 1) / 2 AS rk FROM d) {group}"""


@query("m20_auc", sql("label", _auc_sql("", "logins_90d"), _D))
def auc(spark, sf):
    return r(ST.auc(tier(spark, sf), [], "persist_median", "logins_90d"), "auc")


@query("m22_auc_by_cluster", sql("label", _auc_sql("country_cluster", "logins_90d"), _D))
def auc_by_cluster(spark, sf):
    return r(ST.auc(tier(spark, sf), ["country_cluster"], "persist_median", "logins_90d"), "auc")


_PROB = "1 / (1 + exp(-(activity_breadth - 4.5::DOUBLE)))"


@query("m22_nagelkerke", sql("label", f"""
SELECT ACCOUNT_TYPE, n, round((1 - exp(2 * (b * ln(b) + (1 - b) * ln(1 - b) - ll)))
  / (1 - exp(2 * (b * ln(b) + (1 - b) * ln(1 - b)))), 6) AS nagelkerke_r2 FROM (
  SELECT ACCOUNT_TYPE, count(*) AS n, avg(y::DOUBLE) AS b, avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll
  FROM (SELECT ACCOUNT_TYPE, persist_median AS y, {_PROB} AS p FROM d) GROUP BY 1)""", _D))
def nagelkerke(spark, sf):
    users = tier(spark, sf).withColumn("p", 1 / (1 + F.exp(-(F.col("activity_breadth") - 4.5))))
    return r(ST.nagelkerke(users, ["ACCOUNT_TYPE"], "persist_median", "p"), "nagelkerke_r2")


@query("m22_verdict", sql("label", """
SELECT kind, round(value, 6) AS value, CASE WHEN value > 0.3 THEN 'H1' WHEN value < 0.1 THEN 'H0' ELSE 'mixed' END
  AS verdict FROM (SELECT 'cramers_v' AS kind, sqrt(plain / (n * (least(n_rows, n_cols) - 1))) AS value FROM fit)""",
    _D, _chi_sql("funnel_stage", "persist_median")))
def verdict(spark, sf):
    found = ST.association(tier(spark, sf), "funnel_stage", "persist_median").select(
        F.lit("cramers_v").alias("kind"), F.col("cramers_v").alias("value"),
        F.lit(None).cast("double").alias("other"))
    return r(E.verdict(found).drop("other"), "value")


@query("m23_roc_threshold", sql("label", """
, s AS (SELECT logins_90d AS t, 1.0::DOUBLE - sum(count(*) FILTER (WHERE persist_median = 1)) OVER w
    / sum(count(*) FILTER (WHERE persist_median = 1)) OVER () + sum(count(*) FILTER (WHERE persist_median = 0)) OVER w
    / sum(count(*) FILTER (WHERE persist_median = 0)) OVER () AS q FROM d GROUP BY logins_90d
    WINDOW w AS (ORDER BY logins_90d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT round(t, 6) AS threshold, round(coalesce(q, 1), 9) AS sens_plus_spec FROM s
ORDER BY round(coalesce(q, 1), 9) DESC, t LIMIT 1""", _D))
def roc_threshold(spark, sf):
    return r(ST.roc_threshold(tier(spark, sf), [], "persist_median", "logins_90d"), "threshold")


@query("m42_threshold_agreement", sql("label", """
SELECT round(avg(agree), 6) AS mean_agreement, round(stddev_samp(agree), 6) AS std_agreement FROM (
  SELECT subsample_id, avg(CASE WHEN persist_median = CAST(persistence_c >= m AS INTEGER) THEN 1.0::DOUBLE ELSE 0 END)
    AS agree FROM (SELECT *, median(persistence_c) OVER (PARTITION BY subsample_id) AS m FROM drawn)
  GROUP BY subsample_id)""", *_CTES))
def threshold_agreement(spark, sf):
    from cohortry.operators.labels import group_median_label

    local = group_median_label(drawn(spark, sf), ["subsample_id"])
    rates = local.groupBy("subsample_id").agg(
        F.avg((F.col("y") == F.col("persist_median")).cast("double")).alias("agree"))
    return rates.agg(F.round(F.avg("agree"), 6).alias("mean_agreement"),
                     F.round(F.stddev_samp("agree"), 6).alias("std_agreement"))


@query("m39_gradients", sql("label", """
SELECT funnel_stage, count(*) AS n, round(avg(log_logins_pw), 6) AS x_mean, round(avg(persistence_c), 6) AS y_mean,
  round(min(persistence_c), 6) AS y_min, round(max(persistence_c), 6) AS y_max,
  round(max(persistence_c) - min(persistence_c), 6) AS y_range,
  round(regr_slope(persistence_c, log_logins_pw), 6) AS slope,
  round(regr_r2(persistence_c, log_logins_pw), 6) AS r2 FROM d GROUP BY 1""", _D))
def gradients(spark, sf):
    out = ST.gradients(tier(spark, sf), "funnel_stage", "log_logins_pw", "persistence_c").drop("p_value")
    return r(out, "x_mean", "y_mean", "y_min", "y_max", "y_range", "slope", "r2")


@query("m39_gradient_tests")
def gradient_tests(spark, sf):
    return ST.gradients(tier(spark, sf), "funnel_stage", "log_logins_pw", "persistence_c")


@query("m41_kruskal_wallis", sql("label", """
, rk AS (SELECT funnel_stage, persistence_c, rank() OVER (ORDER BY persistence_c)
    + (count(*) OVER (PARTITION BY persistence_c) - 1) / 2 AS rk FROM d),
g AS (SELECT sum(rk)::DOUBLE AS s, count(*) AS m FROM rk GROUP BY funnel_stage),
t AS (SELECT sum(c::DOUBLE * (c * c - 1)) AS ties FROM (SELECT count(*) AS c FROM d GROUP BY persistence_c)),
h AS (SELECT CAST(sum(m) AS BIGINT) AS n, count(*) AS k, (12 * sum(s * s / m) / (sum(m) * (sum(m) + 1.0::DOUBLE))
    - 3 * (sum(m) + 1)) / (1 - max(ties) / (sum(m)::DOUBLE * sum(m) * sum(m) - sum(m))) AS h FROM g, t)
SELECT n, k, round(h, 5) AS h, round((h - k + 1) / (n - k), 6) AS eta_squared FROM h""", _D))
def kruskal(spark, sf):
    out = ST.kruskal_wallis(tier(spark, sf), "funnel_stage", "persistence_c")
    return r(r(out, "eta_squared"), "h", digits=5)


@query("m46_kaplan_meier", sql("label", """
, e AS (SELECT ACCOUNT_TYPE, coalesce(days_to_first_tree_edit, tenure_days) AS days,
    days_to_first_tree_edit IS NOT NULL AS hit FROM d),
c AS (SELECT ACCOUNT_TYPE, days, count(*) FILTER (WHERE hit) AS n_events, count(*) AS gone FROM e GROUP BY 1, 2),
r AS (SELECT ACCOUNT_TYPE, days, n_events, CAST(sum(gone) OVER (PARTITION BY ACCOUNT_TYPE ORDER BY days
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n_at_risk FROM c)
SELECT ACCOUNT_TYPE, days, n_at_risk, n_events, round(n_events / n_at_risk, 6) AS hazard,
  round(CASE WHEN max(CASE WHEN n_events = n_at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0
    ELSE exp(sum(CASE WHEN n_events < n_at_risk THEN ln(1 - n_events / n_at_risk) ELSE 0 END) OVER w) END, 6) AS survival
FROM r WINDOW w AS (PARTITION BY ACCOUNT_TYPE ORDER BY days)""", _TR))
def kaplan_meier(spark, sf):
    users = I.tracked(I.users_labelled(spark, sf)).select(
        "ACCOUNT_TYPE", F.coalesce("days_to_first_tree_edit", "tenure_days").alias("days"),
        F.col("days_to_first_tree_edit").isNotNull().alias("hit"))
    return r(ST.kaplan_meier(users, ["ACCOUNT_TYPE"], "days", "hit"), "hazard", "survival")


# --- cluster quality on rule-based labels ---------------------------------------------------

_Z = f"""
zs AS (SELECT {', '.join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_X3))} FROM d),
x AS (SELECT USER_ID, funnel_stage AS c, {', '.join(f"({c} - m{i}) / s{i} AS x{i}" for i, c in enumerate(_X3))} FROM d, zs),
cent AS (SELECT c, count(*) AS n, avg(x0) AS c0, avg(x1) AS c1, avg(x2) AS c2,
  var_pop(x0) + var_pop(x1) + var_pop(x2) AS v FROM x GROUP BY c)"""


def scaled(spark, sf):
    return MP.standardize(tier(spark, sf, ["USER_ID", "funnel_stage", *_X3]), _X3[:2] + ["activity_breadth"])


@query("m28_calinski_harabasz", sql("label", """
SELECT count(*) AS n_clusters, round((sum(n * (c0 * c0 + c1 * c1 + c2 * c2)) / (count(*) - 1))
  / (sum(n * v) / (sum(n) - count(*))), 4) AS calinski_harabasz FROM cent""", _D, _Z))
def calinski(spark, sf):
    return r(E.calinski_harabasz(scaled(spark, sf), _X3, "funnel_stage"), "calinski_harabasz", digits=4)


@query("m28_davies_bouldin", sql("label", """
, sp AS (SELECT c, c0, c1, c2, avg(sqrt((x0 - c0) ** 2 + (x1 - c1) ** 2 + (x2 - c2) ** 2)) AS s
  FROM x JOIN cent USING (c) GROUP BY ALL)
SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT a.c, max((a.s + b.s)
  / sqrt((a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2)) AS w
  FROM sp a JOIN sp b ON a.c <> b.c GROUP BY a.c)""", _D, _Z))
def davies(spark, sf):
    return r(E.davies_bouldin(scaled(spark, sf), _X3, "funnel_stage"), "davies_bouldin")


@query("m27_silhouette_squared", sql("label", """
, dist AS (SELECT x.USER_ID, x.c AS mine, k.c AS other, k.n, (x0 - k.c0) ** 2 + (x1 - k.c1) ** 2 + (x2 - k.c2) ** 2
    + k.v AS d2 FROM x, cent k),
ab AS (SELECT USER_ID, max(CASE WHEN mine = other THEN CASE WHEN n > 1 THEN d2 * n / (n - 1) ELSE 0 END END) AS a,
  min(CASE WHEN mine <> other THEN d2 END) AS b, max(CASE WHEN mine = other THEN n END) AS size FROM dist GROUP BY USER_ID)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_squared FROM ab""", _D, _Z))
def silhouette_squared(spark, sf):
    value = E.silhouette_squared(scaled(spark, sf), _X3, "funnel_stage")
    return spark.createDataFrame([(round(value, 6),)], "silhouette_squared double")


@query("m27_silhouette_rows", sql("label", """
, p AS (SELECT a.USER_ID, a.c AS mine, b.c AS other, sum((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2
    + (a.x2 - b.x2) ** 2) AS s FROM x a, x b GROUP BY ALL),
k AS (SELECT c, count(*) AS n FROM x GROUP BY c),
ab AS (SELECT USER_ID, mine, max(CASE WHEN mine = other THEN s / greatest(n - 1, 1) END) AS a,
  min(CASE WHEN mine <> other THEN s / n END) AS b FROM p JOIN k ON k.c = other GROUP BY USER_ID, mine)
SELECT mine AS funnel_stage, count(*) AS n, round(avg((b - a) / greatest(a, b)), 5) AS silhouette_squared
FROM ab GROUP BY mine""",
    _D, _Z))
def silhouette_rows(spark, sf):
    rows = E.silhouette_squared_rows(materialize(scaled(spark, sf)), _X3, "funnel_stage")
    return rows.groupBy("funnel_stage").agg(
        F.count("*").alias("n"), F.round(F.avg("silhouette_squared"), 5).alias("silhouette_squared"))


_ARI = """
cells AS (SELECT funnel_stage AS a, activity_segment AS b, count(*) AS n FROM d GROUP BY 1, 2),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * (n - 1) / 2) AS s FROM cells),
ra AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(n) AS m FROM cells GROUP BY a)),
rb AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(n) AS m FROM cells GROUP BY b))"""


@query("m30_adjusted_rand", sql("label", """
SELECT tot.n, round((tot.s - ra.s * rb.s / (tot.n * (tot.n - 1) / 2))
  / ((ra.s + rb.s) / 2 - ra.s * rb.s / (tot.n * (tot.n - 1) / 2)), 6) AS ari FROM tot, ra, rb""", _D, _ARI))
def adjusted_rand(spark, sf):
    return r(ST.adjusted_rand(tier(spark, sf), "funnel_stage", "activity_segment"), "ari")


@query("m31_best_jaccard", sql("label", """
SELECT a AS funnel_stage, round(max(n / (r + c - n)), 6) AS jaccard,
  CASE WHEN max(n / (r + c - n)) >= 0.75 THEN 'stable' WHEN max(n / (r + c - n)) >= 0.6 THEN 'borderline'
    ELSE 'unstable' END AS stability FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS r,
    sum(n) OVER (PARTITION BY b) AS c FROM cells) GROUP BY a""", _D, _ARI))
def best_jaccard(spark, sf):
    return r(ST.best_jaccard(tier(spark, sf), "funnel_stage", "activity_segment"), "jaccard")


@query("m33_persistence_overlay", sql("label", """
SELECT funnel_stage, count(*) AS n, round(avg(persist_median) * 100, 4) AS pct_persistent,
  round(avg(persistence_c), 6) AS mean_persistence_c,
  round(1.96::DOUBLE * stddev_samp(persistence_c) / sqrt(count(*)), 6) AS ci95 FROM d GROUP BY 1""", _D))
def overlay(spark, sf):
    return E.persistence_overlay(tier(spark, sf), ["funnel_stage"])


_PROFILE_SQL = f"""
prof AS (SELECT country_cluster, count(*) AS n, round(avg(persist_median) * 100, 1) AS pct_persistent,
  round(avg(logins_90d), 3) AS mean_logins_90d, round(avg(activity_breadth), 3) AS mean_activity_breadth
  FROM d GROUP BY 1)"""


def _profiles(spark, sf):
    return E.cluster_profile(tier(spark, sf), ["country_cluster"], ["logins_90d", "activity_breadth"])


@query("m34_personas_by_level", sql("label", """
SELECT country_cluster, n, CASE WHEN n < 10 THEN 'Micro-cluster (artifact)'
  WHEN pct_persistent >= 95 AND mean_activity_breadth >= 4 THEN 'Power Contributors'
  WHEN pct_persistent >= 90 AND mean_logins_90d >= 15 THEN 'Heavy Loggers'
  WHEN pct_persistent >= 85 THEN 'Steady Persisters' WHEN pct_persistent >= 70 THEN 'Moderate Engagers'
  WHEN pct_persistent >= 50 THEN 'At-Risk Contributors' ELSE 'Likely Churners' END AS persona FROM prof""",
    _D, _PROFILE_SQL))
def personas_level(spark, sf):
    return E.personas_by_level(_profiles(spark, sf)).select("country_cluster", "n", "persona")


@query("m34_personas_by_rank", sql("label", """
, q AS (SELECT quantile_cont(mean_logins_90d, 0.8) AS l80, quantile_cont(mean_logins_90d, 0.25) AS l25,
  quantile_cont(mean_activity_breadth, 0.5) AS b50, quantile_cont(mean_activity_breadth, 0.75) AS b75 FROM prof)
SELECT country_cluster, CASE WHEN mean_logins_90d > l80 THEN 'Power Contributors'
  WHEN pct_persistent > 70 AND mean_activity_breadth > b50 THEN 'Steady Engagers'
  WHEN pct_persistent < 30 THEN 'Likely Churners' WHEN mean_activity_breadth > b75 THEN 'Broad Explorers'
  WHEN mean_logins_90d < l25 THEN 'Minimal Engagers'
  ELSE 'Mid-Range (Cluster ' || country_cluster || ')' END AS persona FROM prof, q""", _D, _PROFILE_SQL))
def personas_rank(spark, sf):
    return E.personas_by_rank(_profiles(spark, sf), "country_cluster").select("country_cluster", "persona")


@query("m47_normalized_profile", sql("label", """
SELECT country_cluster, round(mean_logins_90d / max(mean_logins_90d) OVER (), 6) AS mean_logins_90d,
  round(mean_activity_breadth / max(mean_activity_breadth) OVER (), 6) AS mean_activity_breadth FROM prof""",
    _D, _PROFILE_SQL))
def normalized(spark, sf):
    columns = ["mean_logins_90d", "mean_activity_breadth"]
    out = E.normalized_profile(_profiles(spark, sf).select("country_cluster", *columns), columns)
    return r(out, *columns)


@query("m50_degenerate_clusters", sql("label", """
SELECT ACCOUNT_TYPE, count(*) AS n_clusters, count(*) FILTER (WHERE n < 20) AS n_degenerate FROM (
  SELECT ACCOUNT_TYPE, country_cluster, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1""", _D))
def degenerate(spark, sf):
    sizes = tier(spark, sf).groupBy("ACCOUNT_TYPE", "country_cluster").agg(F.count("*").alias("n"))
    return E.degenerate_clusters(sizes, ["ACCOUNT_TYPE"])
