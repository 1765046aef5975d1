"""Queries on the population: counts, profiles, distributions, windows and top lists."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators import features, labels, profile as P, ranks
from cohortry.operators.ranks import join_groups
from cohortry.operators.dictionary import DESCRIPTIONS, describe_features
from cohortry.plans import inputs as I
from cohortry.plans.registry import query
from cohortry.plans.sql_base import sql, tier_d, z
from cohortry.session import materialize

_NUM = C.ACTIVITY_COLUMNS + C.NAME_COLUMNS
_VOL = ["logins_90d", "tree_edits_90d", "names_90d", "sources_90d"]


def _unpivot(source: str, columns: list[str], name: str = "feature", where: str = "",
             keys: str = "") -> str:
    """Long form in SQL as a union of one SELECT per column."""
    return " UNION ALL ".join(
        f"SELECT {keys}'{c}' AS {name}, CAST({c} AS DOUBLE) AS value FROM {source} {where}"
        for c in columns)


# --- remaining projections -----------------------------------------------------------


@query("p31_age_engagement", sql("feat", """
SELECT f.USER_ID, round(m * logins_per_week, 9) AS age_engagement_index,
  CAST(user_age <= 19 AND activity_breadth - has_login >= 2 AS INTEGER) AS youth_burst_flag
FROM users_features f LEFT JOIN (SELECT age_group, median(logins_per_week) AS m FROM users_features
  WHERE NOT is_mnar AND age_group IS NOT NULL GROUP BY age_group) USING (age_group)
WHERE NOT is_mnar"""))
def age_engagement(spark, sf):
    users = I.tracked(I.users_labelled(spark, sf))
    known = users.filter(F.col("age_group").isNotNull())
    medians = materialize(ranks.quantiles(known, ["age_group"], "logins_per_week", {"m": 0.5}))
    return users.join(medians, "age_group", "left").select(
        "USER_ID", F.round(F.col("m") * F.col("logins_per_week"), 9).alias("age_engagement_index"),
        ((F.col("user_age") <= 19) & (F.col("activity_breadth") - F.col("has_login") >= 2))
        .cast("int").alias("youth_burst_flag"))


_W7 = "greatest(greatest(tenure_days, 1) / 7, 1.0::DOUBLE)"


@query("p32_clustering_features", sql("clean", "SELECT c.USER_ID, " + ", ".join(
    f"round_even({z(c)} / {_W7} * 10000, 0) / 10000 AS {n}" for n, c in C.WIDE_RATES.items()) + ", "
    + " + ".join(f"CASE WHEN {z(c)} > 0 THEN 1 ELSE 0 END" for n, c in C.FLAGS.items()
                 if n != "has_login") + f""" AS N_ACTIVITY_TYPES,
  least({z('DAYS_LOGGING_IN')} / greatest(tenure_days, 1), 1.0::DOUBLE) AS LOGIN_CONSISTENCY,
  CASE WHEN {z('TOTAL_NAMES_ADDED')} > 0 THEN {z('DECEASED_NAMES_ADDED')} / TOTAL_NAMES_ADDED
    ELSE 0.0::DOUBLE END AS PCT_DECEASED_NAMES,
  CASE WHEN {z('TOTAL_NAMES_ADDED')} > 0 THEN {z('NOVEL_NAMES_ADDED')} / TOTAL_NAMES_ADDED
    ELSE 0.0::DOUBLE END AS PCT_NOVEL_NAMES, coalesce(user_age, 0) AS USER_CURRENT_AGE, """
    + ", ".join(f"{z(c)} AS {c}, round(ln(1 + {z(c)}), 9) AS {c}_LOG"
                for c in features.CLUSTERING_LOGS) + " FROM users_clean c"))
def clustering_features(spark, sf):
    out = features.clustering_features(I.users_clean(spark, sf), age="user_age")
    return out.withColumns({f"{c}_LOG": F.round(f"{c}_LOG", 9) for c in features.CLUSTERING_LOGS})


@query("p33_derived_features", sql("feat", """
SELECT USER_ID, logins_90d + tree_edits_90d + names_90d AS total_output_90d,
  CASE WHEN tree_edits_per_week > names_per_week THEN 1 ELSE 0 END AS tree_first
FROM users_features"""))
def derived(spark, sf):
    users = I.users_labelled(spark, sf)
    registry = spark.createDataFrame(
        [("total_output_90d", "logins_90d + tree_edits_90d + names_90d"),
         ("tree_first", "CASE WHEN tree_edits_per_week > names_per_week THEN 1 ELSE 0 END")],
        "feature string, sql_expression string")
    allowed = _VOL + ["tree_edits_per_week", "names_per_week"]
    return P.derived_features(users, registry, allowed).select(
        "USER_ID", "total_output_90d", "tree_first")


_BAD = "('Unknown', 'Redacted', '-', '')"


@query("p34_density_status", sql("raw", " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
     f"count(*) FILTER (WHERE {c} = 0) AS n_idle, count(*) FILTER (WHERE {c} <> 0) AS n_meaningful "
     f"FROM users_raw" for c in _NUM]
    + [f"SELECT '{c}', count(*) - count({c}), count(*) FILTER (WHERE trim({c}) IN {_BAD}), "
       f"count(*) FILTER (WHERE trim({c}) NOT IN {_BAD}) FROM users_raw" for c in C.GEO_COLUMNS])))
def density(spark, sf):
    return P.density_status(I.users_raw(spark, sf), _NUM, C.GEO_COLUMNS)


@query("p35_meaningful_columns", sql("raw", "SELECT n_columns, count(*) AS n FROM (SELECT " + " + ".join(
    [f"CAST(coalesce({c} <> 0, FALSE) AS INTEGER)" for c in _NUM]
    + [f"CAST(coalesce(trim({c}) NOT IN {_BAD}, FALSE) AS INTEGER)" for c in C.GEO_COLUMNS])
    + " AS n_columns FROM users_raw) GROUP BY n_columns"))
def meaningful(spark, sf):
    return P.meaningful_columns(I.users_raw(spark, sf), _NUM, C.GEO_COLUMNS)


@query("p36_feature_dictionary", sql("feat", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{text}' AS description, count({f}) AS n_present FROM users_features"
    for f, text in DESCRIPTIONS.items())))
def dictionary(spark, sf):
    return describe_features(I.users_labelled(spark, sf))


@query("p37_rare_countries", sql("clean", """
SELECT pooled, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY COUNTRY) < 60
  THEN 'Micro' ELSE COUNTRY END AS pooled FROM users_clean) GROUP BY pooled"""))
def rare_countries(spark, sf):
    pooled = P.pooled_category(I.users_raw(spark, sf), "COUNTRY", 60)
    return pooled.groupBy("pooled").agg(F.count("*").alias("n"))


# --- counts and distributions ---------------------------------------------------------


@query("a1_conditional_counts", sql("feat", f"""
SELECT count(*) AS n_users, count(*) FILTER (WHERE is_mnar) AS n_untracked,
  count(*) FILTER (WHERE NOT is_mnar AND tenure_days < 31) AS n_short_tenure,
  count(*) FILTER (WHERE {tier_d()}) AS n_tier_d, count(*) FILTER (WHERE {tier_d(2)}) AS n_contributors
FROM users_features"""))
def conditional_counts(spark, sf):
    return I.users_clean(spark, sf).agg(
        F.count("*").alias("n_users"), F.count_if("is_mnar").alias("n_untracked"),
        F.count_if(~F.col("is_mnar") & (F.col("tenure_days") < 31)).alias("n_short_tenure"),
        F.count_if(X.tier_d()).alias("n_tier_d"), F.count_if(X.tier_d(2)).alias("n_contributors"))


_CLEAN_COLS = ["user_age", "province", "city", "iso3_code", *C.MILESTONES.values(), *_NUM]


@query("a2_null_rates", sql("clean", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS pct_null FROM users_clean"
    for c in _CLEAN_COLS)))
def null_rates(spark, sf):
    return P.null_rates(I.users_clean(spark, sf).select(*_CLEAN_COLS))


@query("a3_tenure_and_age", sql("clean", """
SELECT min(tenure_days) AS min_tenure, max(tenure_days) AS max_tenure,
  round(avg(tenure_days), 6) AS mean_tenure, median(tenure_days) AS median_tenure,
  min(user_age) AS min_age, max(user_age) AS max_age, round(avg(user_age), 6) AS mean_age,
  median(user_age) AS median_age, count(*) FILTER (WHERE tenure_days < 31) AS n_short
FROM users_clean"""))
def tenure_and_age(spark, sf):
    """Day counts and ages have a small fixed domain, so ``median`` folds them well."""
    return I.users_clean(spark, sf).agg(
        F.min("tenure_days").alias("min_tenure"), F.max("tenure_days").alias("max_tenure"),
        F.round(F.avg("tenure_days"), 6).alias("mean_tenure"),
        F.median("tenure_days").alias("median_tenure"),
        F.min("user_age").alias("min_age"), F.max("user_age").alias("max_age"),
        F.round(F.avg("user_age"), 6).alias("mean_age"), F.median("user_age").alias("median_age"),
        F.count_if(F.col("tenure_days") < 31).alias("n_short"))


@query("a4_distinct_counts", sql("feat", """
SELECT count(DISTINCT COUNTRY) AS n_countries, count(DISTINCT milestone_sequence) AS n_sequences
FROM users_features"""))
def distinct_counts(spark, sf):
    return I.users_labelled(spark, sf).agg(
        F.count_distinct("COUNTRY").alias("n_countries"),
        F.count_distinct("milestone_sequence").alias("n_sequences"))


_DIST = ["ACCOUNT_TYPE", "age_group", "country_cluster", "funnel_stage", "activity_breadth",
         "activity_segment", "persist_median", "persist_tertile"]


@query("a5_distributions", sql("label", "SELECT column_name, value, count(*) AS n, "
    "round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY column_name), 2) AS pct FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM users_labelled"
                         for c in _DIST) + ") GROUP BY column_name, value"))
def distributions(spark, sf):
    return P.distributions(I.users_labelled(spark, sf), _DIST)


@query("a6_persistence_cuts", sql("label", """
SELECT round(med, 9) AS median, round(p33, 9) AS p33, round(p67, 9) AS p67 FROM cuts"""))
def cuts(spark, sf):
    found = labels.persistence_cuts(I.users_labelled(spark, sf))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query("a7_persistence_labels", sql("label", """
SELECT USER_ID, persist_median, persist_tertile FROM users_labelled"""))
def persistence_labels(spark, sf):
    return I.users_labelled(spark, sf).select("USER_ID", "persist_median", "persist_tertile")


@query("a8_persistence_correlations", sql("feat", """
SELECT round(corr(persistence_a, persistence_b), 6) AS a_b,
  round(corr(persistence_a, persistence_c), 6) AS a_c,
  round(corr(persistence_b, persistence_c), 6) AS b_c FROM users_features WHERE NOT is_mnar"""))
def persistence_correlations(spark, sf):
    pairs = {f"{a}_{b}": (f"persistence_{a}", f"persistence_{b}")
             for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}
    return P.correlations(I.tracked(I.users_labelled(spark, sf)), pairs)


_SUMMARY = C.VELOCITY + _VOL + ["activity_breadth", "login_consistency", "persistence_b",
                                "persistence_c"]


@query("a9_feature_summary", sql("feat", f"""
SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median
FROM ({_unpivot('users_features', _SUMMARY, where='WHERE NOT is_mnar')}) GROUP BY feature"""))
def feature_summary(spark, sf):
    out = P.summary(I.tracked(I.users_labelled(spark, sf)), _SUMMARY)
    return out.select("feature", "n", *[F.round(c, 6).alias(c)
                                        for c in ("mean", "std", "min", "max", "median")])


@query("a10_milestone_sequences", sql("feat", "SELECT USER_ID, milestone_sequence FROM users_features"))
def sequences(spark, sf):
    return I.users_clean(spark, sf).select(
        "USER_ID", features.milestone_sequence().alias("milestone_sequence"))


@query("j7_sequence_write_back", sql("feat", """
SELECT USER_ID, milestone_sequence FROM users_features"""))
def sequence_write_back(spark, sf):
    users = I.users_clean(spark, sf)
    return features.write_back_sequences(users, features.sequences_by_aggregation(users)).select(
        "USER_ID", "milestone_sequence")


_TEXT = ["ACCOUNT_TYPE", "COUNTRY", "PROVINCE", "CITY", "USER_WORLD_REGION", "USER_AREA_NAME"]


@query("a17_data_health", sql("raw", f"""
SELECT column_name, count(*) AS n_total, count(*) - count(value) AS n_missing,
  count(*) FILTER (WHERE value = 0) AS n_zeros, round(avg(value), 2) AS mean,
  round(stddev_samp(value), 2) AS std, CAST(trunc(min(value)) AS BIGINT) AS min,
  CAST(trunc(max(value)) AS BIGINT) AS max,
  CASE WHEN count(value) > 100 THEN round(skewness(value), 2) END AS skewness,
  CAST(trunc(median(value)) AS BIGINT) AS median,
  CAST(trunc(quantile_cont(value, 0.99)) AS BIGINT) AS p99, NULL AS n_unique,
  round((count(*) - count(value)) * 100.0 / count(*), 2) AS pct_missing,
  round(count(*) FILTER (WHERE value = 0) * 100.0 / count(value), 2) AS pct_zeros
FROM ({_unpivot('users_raw', ['USER_CURRENT_AGE', *_NUM], 'column_name')}) GROUP BY column_name
UNION ALL SELECT column_name, count(*), count(*) - count(v), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  NULL, count(DISTINCT v), round((count(*) - count(v)) * 100.0 / count(*), 2), NULL
FROM ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, {c} AS v FROM users_raw" for c in _TEXT)})
GROUP BY column_name"""))
def data_health(spark, sf):
    return P.data_health(I.users_raw(spark, sf), ["USER_CURRENT_AGE", *_NUM], _TEXT)


_PROFILE = _VOL + ["activity_breadth", "activation_speed", "persistence_c"]


@query("a18_segment_profile", sql("feat", f"""
SELECT activity_segment, feature, count(*) AS n, round(avg(value), 6) AS mean,
  round(median(value), 6) AS median FROM (SELECT activity_segment, feature, coalesce(value, 0) AS value
  FROM ({_unpivot('users_features', _PROFILE, keys='activity_segment, ')})) GROUP BY 1, 2"""))
def segment_profile(spark, sf):
    return P.group_profile(I.users_labelled(spark, sf), ["activity_segment"], _PROFILE)


_BIN = ("CASE WHEN tenure_days <= 30 THEN '0-30d' WHEN tenure_days <= 90 THEN '31-90d' "
        "WHEN tenure_days <= 180 THEN '91-180d' WHEN tenure_days <= 270 THEN '181-270d' "
        "WHEN tenure_days <= 365 THEN '271-365d' ELSE '365+d' END")
_ACT = ["DAYS_LOGGING_IN", "TREE_EDITS", "SOURCES_ADDED", "logins_per_week", "names_per_week"]


@query("a19_activity_by_tenure", sql("feat", f"SELECT {_BIN} AS bin, count(*) AS n, " + ", ".join(
    f"round(avg({z(c)}), 6) AS mean_{c}, round(stddev_samp({z(c)}) / nullif(avg({z(c)}), 0), 6) AS cv_{c}"
    for c in _ACT) + " FROM users_features WHERE NOT is_mnar GROUP BY 1"))
def activity_by_tenure(spark, sf):
    return P.activity_by_bin(I.tracked(I.users_labelled(spark, sf)), P.tenure_bin(), _ACT)


@query("a20_engagement_by_group", sql("feat", " UNION ALL ".join(f"""
SELECT '{k}' AS dimension, {k} AS value, count(*) AS n, round(avg(logins_per_week), 6) AS mean_logins,
  round(avg(activity_breadth), 6) AS mean_breadth,
  round(avg(CASE WHEN ACCOUNT_TYPE = 'Member' THEN 100.0::DOUBLE ELSE 0 END), 4) AS pct_member,
  round(avg(CASE WHEN USER_WORLD_REGION = 'EUROPE' THEN 100.0::DOUBLE ELSE 0 END), 4) AS pct_region
FROM users_features WHERE NOT is_mnar GROUP BY 1, 2"""
    for k in ("age_group", "COUNTRY", "activity_segment"))))
def engagement_by_group(spark, sf):
    keys = ["age_group", "COUNTRY", "activity_segment"]
    measures = ["logins_per_week", "activity_breadth", "ACCOUNT_TYPE", "USER_WORLD_REGION"]
    users = I.tracked(I.users_labelled(spark, sf)).select(*keys, *measures)
    long = users.unpivot(measures, keys, "dimension", "value")

    def percent(condition):
        return F.round(F.avg(F.when(condition, 100.0).otherwise(0.0)), 4)

    return long.groupBy("dimension", "value").agg(
        F.count("*").alias("n"), F.round(F.avg("logins_per_week"), 6).alias("mean_logins"),
        F.round(F.avg("activity_breadth"), 6).alias("mean_breadth"),
        percent(F.col("ACCOUNT_TYPE") == "Member").alias("pct_member"),
        percent(F.col("USER_WORLD_REGION") == "EUROPE").alias("pct_region"))


_TIERS = ["MNAR", "NON_LOGIN", "BROWSE", "D", "E"]
_TIER_SQL = f"""CASE WHEN is_mnar THEN 'MNAR' WHEN {z('DAYS_LOGGING_IN')} = 0 THEN 'NON_LOGIN'
  WHEN {tier_d()} AND {z('SOURCES_ADDED')} > 0 AND earliest_source_date IS NOT NULL THEN 'E'
  WHEN {tier_d()} THEN 'D' ELSE 'BROWSE' END"""


@query("a21_region_by_tier", sql("feat", f"SELECT USER_WORLD_REGION, " + ", ".join(
    f"count(*) FILTER (WHERE t = '{t}') AS {t}, round(count(*) FILTER (WHERE t = '{t}') * 100.0 / count(*), 2) "
    f"AS pct_{t}" for t in _TIERS)
    + f" FROM (SELECT USER_WORLD_REGION, {_TIER_SQL} AS t FROM users_features) GROUP BY 1"))
def region_by_tier(spark, sf):
    users = I.users_clean(spark, sf).select("USER_WORLD_REGION", X.data_tier().alias("t"))
    return P.cross_tab(users, "USER_WORLD_REGION", "t", _TIERS)


@query("a22_density_funnel", sql("feat", f"""
, c AS (SELECT count(*) AS n0, count(*) FILTER (WHERE NOT is_mnar) AS n1,
  count(*) FILTER (WHERE NOT is_mnar AND {z('DAYS_LOGGING_IN')} > 0) AS n2,
  count(*) FILTER (WHERE NOT is_mnar AND {z('DAYS_LOGGING_IN')} > 0 AND {z('TREE_EDITS')} > 0) AS n3,
  count(*) FILTER (WHERE {z('DAYS_LOGGING_IN')} > 0 AND {z('TREE_EDITS')} > 0 AND {tier_d()}) AS n4,
  count(*) FILTER (WHERE {tier_d()} AND {z('SOURCES_ADDED')} > 0) AS n5 FROM users_features)
SELECT 'all' AS step, n0 AS n, 1 AS position, NULL AS lost FROM c
UNION ALL SELECT 'tracked', n1, 2, n0 - n1 FROM c UNION ALL SELECT 'logged_in', n2, 3, n1 - n2 FROM c
UNION ALL SELECT 'tree_edits', n3, 4, n2 - n3 FROM c UNION ALL SELECT 'tier_d', n4, 5, n3 - n4 FROM c
UNION ALL SELECT 'tier_e', n5, 6, n4 - n5 FROM c"""))
def density_funnel(spark, sf):
    return P.funnel(I.users_clean(spark, sf), [
        ("all", F.lit(True)), ("tracked", ~F.col("is_mnar")),
        ("logged_in", X.zero("DAYS_LOGGING_IN") > 0), ("tree_edits", X.zero("TREE_EDITS") > 0),
        ("tier_d", X.tier_d()), ("tier_e", X.zero("SOURCES_ADDED") > 0)])


_ACTS = [f for f in C.FLAGS if f != "has_login"]


@query("a23_co_occurrence", sql("feat", " UNION ALL ".join(
    [f"SELECT '{a}|{b}' AS combination, count(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS n FROM users_features"
     for i, a in enumerate(_ACTS) for b in _ACTS[i + 1:]]
    + [f"SELECT '{a}|only', count(*) FILTER (WHERE {a} = 1 AND activity_breadth - has_login = 1) "
       f"FROM users_features" for a in _ACTS])))
def co_occurrence(spark, sf):
    return P.co_occurrence(I.users_clean(spark, sf), {f: X.flags()[f] for f in _ACTS})


@query("a24_order_consistency", sql("clean", """
SELECT round(avg(CAST(earliest_login_date <= earliest_tree_edit_date AS DOUBLE)), 6) AS login_tree,
  round(avg(CAST(earliest_tree_edit_date <= earliest_source_date AS DOUBLE)), 6) AS tree_source
FROM users_clean"""))
def order_consistency(spark, sf):
    return P.order_consistency(I.users_clean(spark, sf),
                               {"login_tree": ("L", "T"), "tree_source": ("T", "S")})


@query("a25_top_share", sql("feat", """
SELECT round(sum(v) FILTER (WHERE rn <= ceil(n * 0.01)) / sum(v), 6) AS top_1pct,
  round(sum(v) FILTER (WHERE rn <= ceil(n * 0.1)) / sum(v), 6) AS top_10pct
FROM (SELECT tree_edits_90d AS v, row_number() OVER (ORDER BY tree_edits_90d DESC) AS rn,
  count(*) OVER () AS n FROM users_features WHERE NOT is_mnar)"""))
def top_share(spark, sf):
    return P.top_share(I.tracked(I.users_labelled(spark, sf)), "tree_edits_90d", [0.01, 0.1])


@query("a26_milestone_coverage", sql("clean", f"""
SELECT milestone, count(days) AS n_reached, round(count(days) * 100.0 / count(*), 4) AS pct_reached,
  round(count(*) FILTER (WHERE days < 0) * 100.0 / count(days), 4) AS pct_before_creation,
  median(days) AS median_days FROM ({' UNION ALL '.join(
      f"SELECT '{m}' AS milestone, CAST(date_diff('day', account_create_date, {c}) AS DOUBLE) AS days "
      f"FROM users_clean" for m, c in C.MILESTONES.items())}) GROUP BY milestone"""))
def milestone_coverage(spark, sf):
    return P.milestone_coverage(I.users_clean(spark, sf))


@query("a27_geo_patterns", sql("raw", "SELECT " + " || ".join(
    f"CASE WHEN trim({c}) IN {_BAD} OR {c} IS NULL THEN '0' ELSE '1' END" for c in C.GEO_COLUMNS)
    + " AS pattern, count(*) AS n FROM users_raw GROUP BY 1"))
def geo_patterns(spark, sf):
    return I.users_raw(spark, sf).groupBy(P.geo_pattern(C.GEO_COLUMNS).alias("pattern")).agg(
        F.count("*").alias("n"))


_COUNTS = ["DAYS_LOGGING_IN", "TREE_EDITS", "SOURCES_ADDED", "MEMORIES_ADDED", "TOTAL_NAMES_ADDED"]


@query("a28_count_profiles", sql("raw", f"""
, l AS ({_unpivot('users_raw', _COUNTS)}),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l
  GROUP BY feature)
SELECT feature, count(*) AS n, round(count(*) FILTER (WHERE value = 0) * 100.0 / count(*), 4) AS pct_zero,
  round(avg(value), 6) AS mean, max(value) AS max, round(median(value), 6) AS median,
  round(quantile_cont(value, 0.99), 6) AS p99, round(skewness(value), 4) AS skewness,
  round(kurtosis_pop(value), 4) AS kurtosis,
  round(count(*) FILTER (WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5) * 100.0
    / count(*), 4) AS pct_outliers
FROM l JOIN q USING (feature) WHERE value IS NOT NULL GROUP BY feature"""))
def count_profiles(spark, sf):
    return P.count_profile(I.users_raw(spark, sf), _COUNTS)


@query("a29_histogram", sql("feat", """
, v AS (SELECT ln(1 + tree_edits_90d) AS v FROM users_features WHERE NOT is_mnar),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n
FROM v, e GROUP BY 1"""))
def histogram(spark, sf):
    return P.histogram(I.tracked(I.users_labelled(spark, sf)), "tree_edits_90d", 20, log=True)


@query("a30_five_numbers", sql("feat", """
SELECT country_cluster, round(min(persistence_c), 6) AS q0,
  round(quantile_cont(persistence_c, 0.25), 6) AS q1, round(median(persistence_c), 6) AS q2,
  round(quantile_cont(persistence_c, 0.75), 6) AS q3, round(max(persistence_c), 6) AS q4
FROM users_features WHERE NOT is_mnar GROUP BY country_cluster"""))
def five_numbers(spark, sf):
    return P.five_numbers(I.tracked(I.users_labelled(spark, sf)), ["country_cluster"], "persistence_c")


@query("a32_correlation_by_breadth", sql("feat", """
SELECT activity_breadth, count(*) AS n, count(*) >= 30 AS enough_rows,
  CASE WHEN count(*) >= 30 THEN round(corr(activation_speed, persistence_c), 6) END AS r
FROM users_features WHERE NOT is_mnar AND activation_speed IS NOT NULL GROUP BY activity_breadth"""))
def correlation_by_breadth(spark, sf):
    users = I.tracked(I.users_labelled(spark, sf)).filter(F.col("activation_speed").isNotNull())
    return users.groupBy("activity_breadth").agg(
        F.count("*").alias("n"), (F.count("*") >= 30).alias("enough_rows"),
        F.when(F.count("*") >= 30, F.round(F.corr("activation_speed", "persistence_c"), 6)).alias("r"))


_LOGIN_TIER = f"""CASE WHEN {z('DAYS_LOGGING_IN')} = 0 THEN '0' WHEN {z('DAYS_LOGGING_IN')} = 1 THEN '1'
  WHEN {z('DAYS_LOGGING_IN')} <= 5 THEN '2-5' WHEN {z('DAYS_LOGGING_IN')} <= 30 THEN '6-30' ELSE '31+' END"""


@query("a33_login_tiers", sql("clean", f"""
SELECT {_LOGIN_TIER} AS login_tier, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM users_clean WHERE NOT is_mnar GROUP BY 1"""))
def login_tiers(spark, sf):
    return P.frequencies(I.tracked(I.users_clean(spark, sf)), X.login_tier().alias("login_tier"))


@query("a34_segment_composition", sql("feat", " UNION ALL ".join(f"""
SELECT activity_segment, '{k}' AS dimension, {k} AS value, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY activity_segment), 2) AS pct,
  count(*) * 2 > sum(count(*)) OVER (PARTITION BY activity_segment) AS dominant
FROM users_features GROUP BY activity_segment, {k}"""
    for k in ("USER_WORLD_REGION", "age_group", "ACCOUNT_TYPE"))))
def segment_composition(spark, sf):
    keys = ["USER_WORLD_REGION", "age_group", "ACCOUNT_TYPE"]
    long = I.users_labelled(spark, sf).select("activity_segment", *keys).unpivot(
        "activity_segment", keys, "dimension", "value")
    counts = long.groupBy("activity_segment", "dimension", "value").agg(F.count("*").alias("n"))
    within = ["activity_segment", "dimension"]
    return P.share_of_total(counts, within=within).withColumn(
        "dominant", F.col("n") * 2 > F.sum("n").over(W.partitionBy(*within)))


@query("a35_untracked_rates", sql("clean", " UNION ALL ".join(f"""
SELECT '{k}' AS dimension, {k} AS value, count(*) AS n, round(avg(CAST(is_mnar AS DOUBLE)), 6) AS rate
FROM users_clean GROUP BY {k}""" for k in ("USER_WORLD_REGION", "COUNTRY", "ACCOUNT_TYPE"))))
def untracked_rates(spark, sf):
    keys = ["USER_WORLD_REGION", "COUNTRY", "ACCOUNT_TYPE"]
    long = I.users_clean(spark, sf).select("is_mnar", *keys).unpivot(
        "is_mnar", keys, "dimension", "value")
    return long.groupBy("dimension", "value").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("is_mnar").cast("double")), 6).alias("rate"))


# --- windows, top lists, set operations ------------------------------------------------


@query("w3_percentile_ranks", sql("feat", "SELECT USER_ID, " + ", ".join(
    f"round((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER (), 9) "
    f"AS {c}" for c in _VOL) + " FROM users_features WHERE NOT is_mnar"))
def percentile_ranks(spark, sf):
    out = ranks.percent_rank_average(I.tracked(I.users_labelled(spark, sf)), "USER_ID", _VOL)
    return out.select("USER_ID", *[F.round(c, 9).alias(c) for c in _VOL])


@query("w5_group_median_labels", sql("feat", f"""
SELECT USER_ID, CAST(persistence_c >= median(persistence_c) OVER (PARTITION BY ACCOUNT_TYPE) AS INTEGER) AS y
FROM users_features WHERE {tier_d(2)}"""))
def group_median_labels(spark, sf):
    users = I.tier_d(I.users_labelled(spark, sf), 2)
    return labels.group_median_label(users, ["ACCOUNT_TYPE"]).select("USER_ID", "y")


@query("w6_ordered_relabel", sql("feat", """
SELECT f.USER_ID, tier FROM users_features f JOIN (
  SELECT country_cluster, dense_rank() OVER (ORDER BY avg(tenure_days)) - 1 AS tier
  FROM users_features GROUP BY country_cluster) USING (country_cluster)"""))
def ordered_relabel(spark, sf):
    """Group labels replaced by the order of their centre, then joined back."""
    from cohortry.operators.cluster import order_labels

    users = I.users_labelled(spark, sf).select("USER_ID", "country_cluster", "tenure_days")
    centres = users.groupBy("country_cluster").agg(F.avg("tenure_days").alias("centre"))
    return order_labels(users, centres, "country_cluster").select("USER_ID", "tier")


@query("w7_area_means", sql("feat", """
SELECT USER_ID, round(avg(logins_per_week) OVER (PARTITION BY USER_AREA_NAME), 6) AS area_engagement_mean
FROM users_features"""))
def area_means(spark, sf):
    """Group means joined back: unlike a window, a hot area combines before the shuffle."""
    users = I.users_labelled(spark, sf).select("USER_ID", "USER_AREA_NAME", "logins_per_week")
    means = materialize(users.groupBy("USER_AREA_NAME").agg(
        F.round(F.avg("logins_per_week"), 6).alias("area_engagement_mean")))
    return join_groups(users, means, ["USER_AREA_NAME"]).select("USER_ID", "area_engagement_mean")


@query("o1_top_sequences", sql("feat", """
SELECT milestone_sequence, count(*) AS n FROM users_features WHERE milestone_sequence <> ''
GROUP BY 1 ORDER BY n DESC, milestone_sequence LIMIT 20"""))
def top_sequences(spark, sf):
    users = I.users_labelled(spark, sf).filter(F.col("milestone_sequence") != "")
    return users.groupBy("milestone_sequence").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "milestone_sequence").limit(20)


@query("o2_top_countries_per_cluster", sql("feat", """
SELECT country_cluster, COUNTRY, n, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY country_cluster ORDER BY n DESC, COUNTRY) AS rank FROM (
  SELECT country_cluster, COUNTRY, count(*) AS n FROM users_features GROUP BY 1, 2)) WHERE rank <= 3"""))
def top_countries(spark, sf):
    counts = I.users_labelled(spark, sf).groupBy("country_cluster", "COUNTRY").agg(
        F.count("*").alias("n"))
    order = W.partitionBy("country_cluster").orderBy(F.desc("n"), "COUNTRY")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 3)


@query("o5_best_by_metric", sql("feat", """
SELECT arg_max(activity_breadth, m) AS best_breadth FROM (SELECT activity_breadth,
  round(avg(persistence_c), 9) AS m FROM users_features WHERE NOT is_mnar GROUP BY activity_breadth)"""))
def best_by_metric(spark, sf):
    means = I.tracked(I.users_labelled(spark, sf)).groupBy("activity_breadth").agg(
        F.round(F.avg("persistence_c"), 9).alias("m"))
    return means.agg(F.max_by("activity_breadth", F.struct("m", "activity_breadth"))
                     .alias("best_breadth"))


@query("u1_union_by_name", sql("feat", """
SELECT ACCOUNT_TYPE, NULL AS age_group, count(*) AS n, round(avg(persistence_c), 6) AS mean_persistence
FROM users_features GROUP BY ACCOUNT_TYPE
UNION ALL SELECT NULL, age_group, count(*), NULL FROM users_features GROUP BY age_group"""))
def union_by_name(spark, sf):
    users = I.users_labelled(spark, sf)
    by_type = users.groupBy("ACCOUNT_TYPE").agg(
        F.count("*").alias("n"), F.round(F.avg("persistence_c"), 6).alias("mean_persistence"))
    by_age = users.groupBy("age_group").agg(F.count("*").alias("n"))
    return by_type.unionByName(by_age, allowMissingColumns=True)


@query("u2_distinct_countries", sql("raw", "SELECT DISTINCT COUNTRY FROM users_raw"))
def distinct_countries(spark, sf):
    return I.users_raw(spark, sf).select("COUNTRY").distinct()
