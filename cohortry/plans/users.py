"""Queries on single users: scans, cleaning rules, features and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators import clean, features
from cohortry.plans import inputs as I
from cohortry.plans.registry import query
from cohortry.plans.sql_base import BREADTH, FLAG, REF, gap, sql, tier_d, z
from cohortry.session import result_path
from cohortry.sources import standins as S, users as SU


def text_dates(df, *columns):
    """Dates as text, so that both engines print them alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def sql_text(columns):
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


def rnd(*names, digits=9):
    return [F.round(n, digits).alias(n) for n in names]


_RAW_DATES = list(C.DATE_COLUMNS)


@query("flagship_segment_persistence", sql("feat", """
SELECT activity_segment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct,
  round(avg(persistence_c), 6) AS mean_persistence,
  round(median(persistence_c), 6) AS median_persistence,
  round(avg(activity_breadth), 6) AS mean_breadth,
  round(avg(logins_per_week), 6) AS mean_logins_per_week
FROM users_features GROUP BY activity_segment"""))
def flagship(spark, sf):
    """Who persists, by activity segment."""
    from cohortry.operators.profile import segment_persistence

    return segment_persistence(I.features_without_cluster(spark, sf))


@query("s1_users_raw", sql("raw", f"""
SELECT * EXCLUDE ({', '.join(_RAW_DATES)}), {sql_text(_RAW_DATES)} FROM users_raw"""))
def users_raw(spark, sf):
    return text_dates(S.users_raw(spark, sf), *_RAW_DATES)


def spoiled_csv(spark, sf):
    """The raw table as CSV, with some dates and some ids that cannot be read."""
    path = result_path(spark, "users_csv")
    text = I.users_raw(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in SU.user_schema().names])
    number = F.col("USER_ID").cast("long")
    text.withColumns({
        "ACCOUNT_CREATE_DATE": F.when(number % 97 == 0, "soon").otherwise(F.col("ACCOUNT_CREATE_DATE")),
        "USER_ID": F.when(number % 101 == 0, F.concat(F.lit("x"), "USER_ID")).otherwise(F.col("USER_ID")),
    }).write.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)
    return path


@query("s1_users_csv", sql("raw", f"""
SELECT * EXCLUDE ({', '.join(_RAW_DATES)}) REPLACE (nullif(CITY, '') AS CITY, nullif(PROVINCE, '') AS PROVINCE),
  {sql_text([c for c in _RAW_DATES if c != 'ACCOUNT_CREATE_DATE'])},
  CASE WHEN USER_ID % 97 <> 0 THEN CAST(ACCOUNT_CREATE_DATE AS VARCHAR) END AS ACCOUNT_CREATE_DATE
FROM users_raw WHERE USER_ID % 101 <> 0"""))
def users_csv(spark, sf):
    """The raw table through its CSV reader: spoiled lines go, spoiled dates and empty texts are null."""
    good, _ = SU.scan_users_csv(spark, spoiled_csv(spark, sf))
    return text_dates(good, *_RAW_DATES)


@query("s1_users_csv_bad_lines", sql("raw", """
SELECT 'x' || USER_ID AS first_field FROM users_raw WHERE USER_ID % 101 = 0"""))
def users_csv_bad_lines(spark, sf):
    _, bad = SU.scan_users_csv(spark, spoiled_csv(spark, sf))
    return bad.select(F.substring_index("line", ",", 1).alias("first_field"))


@query("s2_first_rows", sql("raw", f"""
SELECT * EXCLUDE ({', '.join(_RAW_DATES)}), {sql_text(_RAW_DATES)} FROM users_raw ORDER BY USER_ID LIMIT 100"""))
def first_rows(spark, sf):
    """The first rows by id, so that every run shows the same ones."""
    return text_dates(I.users_raw(spark, sf).orderBy("USER_ID").limit(100), *_RAW_DATES)


@query("s10_describe")
def describe(spark, sf):
    from cohortry.sources.users import describe_table

    return describe_table(I.users_labelled(spark, sf))


@query("p1_age_rules", sql("raw", """
SELECT count(*) FILTER (WHERE USER_CURRENT_AGE IS NULL) AS n_null,
  count(*) FILTER (WHERE USER_CURRENT_AGE <= 0) AS n_zero_or_negative,
  count(*) FILTER (WHERE USER_CURRENT_AGE > 0 AND USER_CURRENT_AGE < 8) AS n_below_8,
  count(*) FILTER (WHERE USER_CURRENT_AGE > 110) AS n_above_110,
  count(*) FILTER (WHERE USER_CURRENT_AGE >= 8) AS n_kept FROM users_raw"""))
def age_rules(spark, sf):
    return clean.age_rule_counts(I.users_raw(spark, sf))


@query("p1_clean_ages", sql("clean", "SELECT USER_ID, user_age FROM users_clean"))
def clean_ages(spark, sf):
    return I.users_raw(spark, sf).select("USER_ID", X.clean_age("USER_CURRENT_AGE").alias("user_age"))


@query("p2_sentinel_counts", sql("raw", """
SELECT column_name, trim(v) AS sentinel, count(*) AS n FROM (
  SELECT 'PROVINCE' AS column_name, PROVINCE AS v FROM users_raw
  UNION ALL SELECT 'CITY', CITY FROM users_raw)
WHERE trim(v) IN ('Unknown', 'Redacted', '-', '') GROUP BY 1, 2"""))
def sentinels(spark, sf):
    return clean.sentinel_counts(I.users_raw(spark, sf))


@query("p2_clean_text", sql("clean", "SELECT USER_ID, province, city FROM users_clean"))
def clean_text(spark, sf):
    return I.users_raw(spark, sf).select(
        "USER_ID", X.clean_text("PROVINCE").alias("province"), X.clean_text("CITY").alias("city"))


@query("p3_untracked_flag", sql("clean", "SELECT USER_ID, CAST(is_mnar AS INTEGER) AS is_mnar FROM users_clean"))
def untracked(spark, sf):
    return I.users_raw(spark, sf).select("USER_ID", X.is_untracked().cast("int").alias("is_mnar"))


@query("p4_block_missingness", sql("raw", f"""
SELECT count(*) AS n_users,
  count(*) FILTER (WHERE {' AND '.join(c + ' IS NULL' for c in C.ACTIVITY_COLUMNS)}) AS n_all_null,
  count(*) FILTER (WHERE {' OR '.join(c + ' IS NULL' for c in C.ACTIVITY_COLUMNS)}) AS n_any_null,
  TRUE AS block_or_nothing FROM users_raw"""))
def block_missing(spark, sf):
    return clean.block_missingness(I.users_raw(spark, sf))


@query("p5_reference_date", sql("raw", f"""
SELECT CAST(greatest({', '.join(f'max({c})' for c in _RAW_DATES)}) AS VARCHAR) AS reference_date
FROM users_raw"""))
def reference(spark, sf):
    return text_dates(clean.reference_date(I.users_raw(spark, sf)), "reference_date")


@query("p6_tenure", sql("clean", "SELECT USER_ID, tenure_days, tenure_weeks FROM users_clean"))
def tenure(spark, sf):
    return I.users_clean(spark, sf).select("USER_ID", "tenure_days", "tenure_weeks")


@query("p7_velocity", sql("feat", f"SELECT USER_ID, {', '.join(X.VELOCITY_GAPS)} FROM users_features"))
def velocity(spark, sf):
    return I.users_clean(spark, sf).select("USER_ID", *[e.alias(n) for n, e in X.velocity().items()])


@query("p8_activation_speed", sql("feat", "SELECT USER_ID, activation_speed FROM users_features"))
def activation(spark, sf):
    return I.users_clean(spark, sf).select("USER_ID", X.activation_speed().alias("activation_speed"))


@query("p9_weekly_rates", sql("feat", """
SELECT USER_ID, logins_per_week, tree_edits_per_week, names_per_week, sources_per_week
FROM users_features"""))
def rates(spark, sf):
    return I.users_clean(spark, sf).select("USER_ID", *[e.alias(n) for n, e in X.rates().items()])


_W7 = "greatest(greatest(tenure_days, 1) / 7, 1.0::DOUBLE)"


@query("p9_wide_rates", sql("clean", "SELECT USER_ID, " + ", ".join(
    f"round_even({z(c)} / {_W7} * 10000, 0) / 10000 AS {n}" for n, c in C.WIDE_RATES.items()) + " FROM users_clean"))
def wide_rates(spark, sf):
    return features.wide_rates(I.users_clean(spark, sf)).select("USER_ID", *C.WIDE_RATES)


_LOGS = [n for s, (_, r) in C.RATES.items() for n in (f"log_{s}_pw", r)]


@query("p10_log_features", sql("feat", "SELECT USER_ID, " + ", ".join(
    f"round({n}, 9) AS {n}" for n in _LOGS) + " FROM users_features"))
def logs(spark, sf):
    exprs = X.log_features()
    return I.users_clean(spark, sf).select("USER_ID", *[F.round(exprs[n], 9).alias(n) for n in _LOGS])


def _window_sql(days):
    return ", ".join(f"{z(c)} * least({days}.0::DOUBLE, tenure_days) / greatest(tenure_days, 1.0::DOUBLE)"
                     f" AS {s}_{days}d" for s, (c, _) in C.RATES.items())


_WINDOWS = (60, 90, 120, 180)


@query("p11_fixed_windows", sql("clean", "SELECT USER_ID, " + ", ".join(
    _window_sql(d) for d in _WINDOWS) + " FROM users_clean"))
def windows(spark, sf):
    exprs = {n: e for d in _WINDOWS for n, e in X.prorated(d).items()}
    return I.users_clean(spark, sf).select("USER_ID", *[e.alias(n) for n, e in exprs.items()])


@query("p12_flags", sql("feat", f"SELECT USER_ID, {', '.join(C.FLAGS)} FROM users_features"))
def flags(spark, sf):
    return I.users_clean(spark, sf).select("USER_ID", *[e.alias(n) for n, e in X.flags().items()])


@query("p13_breadth", sql("feat", """
SELECT USER_ID, activity_breadth, activity_breadth - has_login AS activity_types
FROM users_features"""))
def breadth(spark, sf):
    return I.users_clean(spark, sf).select(
        "USER_ID", X.breadth().alias("activity_breadth"),
        X.breadth(include_login=False).alias("activity_types"))


@query("p14_funnel_stage", sql("feat", "SELECT USER_ID, funnel_stage FROM users_features"))
def funnel(spark, sf):
    return I.users_clean(spark, sf).select("USER_ID", X.funnel_stage().alias("funnel_stage"))


@query("p15_login_consistency", sql("feat", f"""
SELECT USER_ID, login_consistency,
  least({z('DAYS_LOGGING_IN')} / greatest(tenure_days, 1), 1.0::DOUBLE) AS login_share
FROM users_features"""))
def consistency(spark, sf):
    return I.users_clean(spark, sf).select(
        "USER_ID", X.per_week("DAYS_LOGGING_IN").alias("login_consistency"),
        X.login_share_of_days().alias("login_share"))


@query("p16_tenure_weight", sql("feat", """
SELECT USER_ID, round(tenure_weight, 9) AS tenure_weight,
  round(ln(greatest(tenure_days / 7, 1.0::DOUBLE)), 9) AS tenure_weight_weekly
FROM users_features"""))
def weight(spark, sf):
    return I.users_clean(spark, sf).select(
        "USER_ID", F.round(X.tenure_weight(), 9).alias("tenure_weight"),
        F.round(X.tenure_weight(weekly=True), 9).alias("tenure_weight_weekly"))


@query("p17_age_groups", sql("feat", f"""
SELECT f.USER_ID, age_group,
  CASE WHEN USER_CURRENT_AGE < 7 OR USER_CURRENT_AGE > 110 THEN NULL
    {' '.join(f"WHEN USER_CURRENT_AGE <= {b} THEN '{n}'" for b, n in zip(C.AGE_BOUNDS, C.AGE_LABELS))}
    ELSE '80+' END AS raw_age_bin
FROM users_features f JOIN users_raw r ON r.USER_ID = f.USER_ID"""))
def age_groups(spark, sf):
    raw = I.users_raw(spark, sf).withColumn("user_age", X.clean_age("USER_CURRENT_AGE"))
    return raw.select("USER_ID", X.age_group().alias("age_group"),
                      X.age_bin("USER_CURRENT_AGE").alias("raw_age_bin"))


@query("p18_country_cluster", sql("feat", "SELECT USER_ID, COUNTRY, country_cluster FROM users_features"))
def cluster(spark, sf):
    return I.users_features(spark, sf).select("USER_ID", "COUNTRY", "country_cluster")


@query("p19_p21_persistence", sql("feat", """
SELECT USER_ID, persistence_a, round(persistence_b, 9) AS persistence_b,
  round(persistence_c, 9) AS persistence_c FROM users_features"""))
def persistence(spark, sf):
    return I.features_without_cluster(spark, sf).select(
        "USER_ID", "persistence_a", *rnd("persistence_b", "persistence_c"))


@query("p22_segments", sql("feat", "SELECT USER_ID, activity_segment FROM users_features"))
def segments(spark, sf):
    return I.features_without_cluster(spark, sf).select("USER_ID", "activity_segment")


@query("p23_segment_variant", sql("feat", f"""
SELECT USER_ID, CASE WHEN activity_segment NOT IN ('E_LIGHT', 'F_MODERATE') THEN activity_segment
  WHEN {z('DAYS_LOGGING_IN')} <= 1 THEN 'E_LIGHT' WHEN {z('DAYS_LOGGING_IN')} <= 5 THEN 'F_MODERATE'
  ELSE 'G_REGULAR' END AS segment_variant FROM users_features"""))
def segment_variant(spark, sf):
    return I.features_without_cluster(spark, sf).select(
        "USER_ID", X.activity_segment(single_is_light=True).alias("segment_variant"))


@query("p24_tier_d", sql("feat", f"""
SELECT USER_ID, CAST(({tier_d(2)}) AS INTEGER) AS contributor FROM users_features WHERE {tier_d()}"""))
def tier_d_users(spark, sf):
    return I.tier_d(I.users_clean(spark, sf)).select(
        "USER_ID", X.tier_d(2).cast("int").alias("contributor"))


@query("p25_data_tiers", sql("feat", f"""
SELECT data_tier, count(*) AS n FROM (SELECT CASE WHEN is_mnar THEN 'MNAR'
  WHEN {z('DAYS_LOGGING_IN')} = 0 THEN 'NON_LOGIN'
  WHEN {tier_d()} AND {z('SOURCES_ADDED')} > 0 AND earliest_source_date IS NOT NULL THEN 'E'
  WHEN {tier_d()} THEN 'D' ELSE 'BROWSE' END AS data_tier FROM users_features) GROUP BY 1"""))
def data_tiers(spark, sf):
    return I.users_clean(spark, sf).groupBy(X.data_tier().alias("data_tier")).agg(
        F.count("*").alias("n"))


@query("p26_name_ratios", sql("clean", f"""
SELECT USER_ID,
  CASE WHEN {z('TOTAL_NAMES_ADDED')} > 0 THEN {z('DECEASED_NAMES_ADDED')} / {z('TOTAL_NAMES_ADDED')}
    ELSE 0.0::DOUBLE END AS pct_deceased,
  CASE WHEN {z('TOTAL_NAMES_ADDED')} > 0 THEN {z('NOVEL_NAMES_ADDED')} / {z('TOTAL_NAMES_ADDED')}
    ELSE 0.0::DOUBLE END AS pct_novel FROM users_clean"""))
def name_ratios(spark, sf):
    return I.users_clean(spark, sf).select(
        "USER_ID", X.ratio_of_names("DECEASED_NAMES_ADDED").alias("pct_deceased"),
        X.ratio_of_names("NOVEL_NAMES_ADDED").alias("pct_novel"))


@query("p27_clip", sql("raw", """
SELECT USER_ID, CASE WHEN USER_CURRENT_AGE IS NOT NULL
  THEN least(greatest(USER_CURRENT_AGE, 0), 100) END AS age_clipped,
  CASE WHEN TREE_EDITS IS NOT NULL THEN least(TREE_EDITS, 50.0::DOUBLE) END AS tree_edits_capped
FROM users_raw"""))
def clipped(spark, sf):
    return I.users_raw(spark, sf).select(
        "USER_ID", X.clip("USER_CURRENT_AGE", 0, 100).alias("age_clipped"),
        X.clip("TREE_EDITS", upper=50.0).alias("tree_edits_capped"))


@query("p28_bad_dates", sql("country", """
SELECT count(*) AS n_rows, count(snapshot_date) AS n_dates,
  CAST(max(snapshot_date) AS VARCHAR) AS latest FROM snapshot_rows"""))
def bad_dates(spark, sf):
    from cohortry.sources.users import parse_date

    return S.snapshots(spark, sf, I.nation_year(spark, sf)).select(parse_date("date").alias("d")).agg(
        F.count("*").alias("n_rows"), F.count("d").alias("n_dates"),
        F.max("d").cast("string").alias("latest"))


@query("p29_numbers_from_text", sql("country", """
SELECT country_name, coalesce(sum(lds_membership), 0) AS membership,
  count(*) - count(lds_membership) AS n_bad FROM snapshot_rows GROUP BY country_name"""))
def numbers_from_text(spark, sf):
    rows = S.snapshots(spark, sf, I.nation_year(spark, sf)).select("country", X.number_from_text("membership").alias("m"))
    return rows.groupBy(F.col("country").alias("country_name")).agg(
        F.coalesce(F.sum("m"), F.lit(0.0)).alias("membership"),
        (F.count("*") - F.count("m")).alias("n_bad"))


@query("p30_days_to_milestones", sql("clean", "SELECT USER_ID, " + ", ".join(
    f"{gap('account_create_date', c)} AS days_to_{m}" for m, c in C.MILESTONES.items()) + f""",
  coalesce(least({', '.join(gap('account_create_date', c) for m, c in C.MILESTONES.items() if m != 'L')}) <= 7,
    FALSE) AS early_contributor FROM users_clean"""))
def days_to_milestones(spark, sf):
    gaps = X.days_to_first()
    first = F.least(*[e for n, e in gaps.items() if n != "days_to_L"])
    return I.users_clean(spark, sf).select(
        "USER_ID", *[e.alias(n) for n, e in gaps.items()],
        F.coalesce(first <= 7, F.lit(False)).alias("early_contributor"))
