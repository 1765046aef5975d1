"""Queries on samples, splits, weights and the tables written from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators import clean, sampling as M
from cohortry.plans import inputs as I
from cohortry.plans.registry import query
from cohortry.plans.sql_base import sql, tier_d
from cohortry.session import materialize, result_path
from cohortry.sources import sinks

# draws small enough to leave rows out at every scale
ROWS, DRAWS = 300, 10


def drawn(spark, sf):
    """Stratified draws with features of the drawn users and a split by tertile."""
    return I.layer(spark, sf, "subsamples", lambda: _drawn(spark, sf))


def _drawn(spark, sf):
    population = M.with_strata(I.tier_d(I.users_labelled(spark, sf)))
    allocation = M.proportional_allocation(population, ROWS)
    picked = M.stratified_draws(population, allocation, DRAWS, ROWS)
    users = I.users_labelled(spark, sf)
    labelled = picked.join(users.select("USER_ID", "persist_tertile"), "USER_ID")
    split = M.split_train_test(
        materialize(labelled), ["subsample_id", "persist_tertile"],
        seed=F.col("subsample_id") + C.BASE_SEED + M.SPLIT_SEED)
    # written: its size on file lets Spark broadcast the few drawn keys, so no wide row is shuffled
    return materialize(split.drop("persist_tertile")).join(users, "USER_ID")


_TIER_D = f"""
pop0 AS (SELECT *, coalesce(country_cluster, 'Unknown') || '|' || coalesce(USER_WORLD_REGION, 'Unknown') AS s0
  FROM users_labelled WHERE {tier_d()}),
pop AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s0) < 15 THEN 'Other|Pooled' ELSE s0 END AS stratum
  FROM pop0)"""
_ALLOC = f"""
alloc AS (SELECT stratum, count(*) AS stratum_size, least(count(*), greatest(15,
  CAST(round_even(count(*) / sum(count(*)) OVER () * {ROWS}, 0) AS BIGINT))) AS draw_size
  FROM pop GROUP BY stratum)"""
_DRAWN = f"""
each AS (SELECT t AS subsample_id, p.*, stratum_size, draw_size FROM pop p JOIN alloc USING (stratum),
  range(1, {DRAWS + 1}) r(t)),
drawn0 AS (SELECT *, count(*) OVER (PARTITION BY subsample_id) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY subsample_id, stratum
    ORDER BY md5(USER_ID || '|' || (subsample_id + 42)), USER_ID) AS rk FROM each) WHERE rk <= draw_size),
drawn AS (SELECT *, stratum_size / draw_size AS sampling_weight FROM (
  SELECT *, row_number() OVER (PARTITION BY subsample_id
    ORDER BY md5(USER_ID || '|' || (subsample_id + 142)), USER_ID) AS rt FROM drawn0)
  WHERE total <= {ROWS + C.TRIM_SLACK} OR rt <= {ROWS}),
split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY subsample_id, persist_tertile
    ORDER BY md5(USER_ID || '|' || (subsample_id + 242)), USER_ID)
  <= floor(count(*) OVER (PARTITION BY subsample_id, persist_tertile) * 0.7::DOUBLE)
  THEN 'train' ELSE 'test' END AS split FROM drawn)"""
_CTES = (_TIER_D, _ALLOC, _DRAWN)


@query("e1_allocation", sql("label", "SELECT stratum, stratum_size, draw_size FROM alloc", _TIER_D, _ALLOC))
def allocation(spark, sf):
    population = M.with_strata(I.tier_d(I.users_labelled(spark, sf)))
    return M.proportional_allocation(population, ROWS)


@query("e1_w4_stratified_draws", sql("label", """
SELECT subsample_id, USER_ID, stratum, round(sampling_weight, 9) AS sampling_weight FROM drawn""", *_CTES))
def draws(spark, sf):
    return drawn(spark, sf).select("subsample_id", "USER_ID", "stratum",
                                   F.round("sampling_weight", 9).alias("sampling_weight"))


_COUNTRY = f"""
alloc AS (SELECT COUNTRY AS stratum, count(*) AS stratum_size FROM users_labelled WHERE {tier_d()} GROUP BY COUNTRY),
tot AS (SELECT coalesce(sum(stratum_size) FILTER (WHERE stratum_size < 30), 0) AS census, count(*) FILTER (WHERE stratum_size >= 30) AS k,
  sum(stratum_size) FILTER (WHERE stratum_size >= 30) AS sampled FROM alloc)"""


@query("e2_composite_allocation", sql("label", """
SELECT stratum, stratum_size, draw_size, round(stratum_size / draw_size, 9) AS sampling_weight FROM (SELECT stratum, stratum_size,
  CASE WHEN stratum_size < 30 THEN stratum_size ELSE least(stratum_size, 30 + CAST(round_even(
    greatest(600 - census - 30 * k, 0) * stratum_size / sampled, 0) AS BIGINT)) END AS draw_size FROM alloc, tot)""", _COUNTRY))
def composite_allocation(spark, sf):
    users = I.tier_d(I.users_labelled(spark, sf)).withColumn("stratum", F.col("COUNTRY"))
    out = M.composite_allocation(users, 600)
    return out.withColumn("sampling_weight", F.round("sampling_weight", 9))


@query("e3_simple_sample", sql("clean", """
SELECT USER_ID FROM users_clean ORDER BY md5(USER_ID || '|42'), USER_ID LIMIT 100"""))
def simple_sample(spark, sf):
    return M.simple_sample(I.users_clean(spark, sf).select("USER_ID"), 100)


@query("e4_stratified_split", sql("label", "SELECT subsample_id, USER_ID, split FROM split", *_CTES))
def stratified_split(spark, sf):
    return drawn(spark, sf).select("subsample_id", "USER_ID", "split")


@query("e5_plain_split", sql("label", f"""
SELECT USER_ID, CASE WHEN row_number() OVER (ORDER BY md5(USER_ID || '|42'), USER_ID)
  <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM users_labelled WHERE {tier_d(2)}"""))
def plain_split(spark, sf):
    users = I.tier_d(I.users_labelled(spark, sf), 2).select("USER_ID")
    return M.split_train_test(users, [])


@query("e6_paired_subsamples", sql("label", """
SELECT pair_id, subsample_id, USER_ID, CASE WHEN row_number() OVER (PARTITION BY pair_id
    ORDER BY md5(USER_ID || '-' || subsample_id || '|' || (pair_id + 100)), USER_ID || '-' || subsample_id)
  <= floor(count(*) OVER (PARTITION BY pair_id) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, CAST(ceil(subsample_id / 2) AS BIGINT) AS pair_id FROM drawn WHERE DAYS_LOGGING_IN >= 2)""", *_CTES))
def paired(spark, sf):
    pairs = M.pair_subsamples(drawn(spark, sf).filter(X.zero("DAYS_LOGGING_IN") >= 2))
    split = M.split_train_test(pairs.drop("split"), ["pair_id"], key="draw_key",
                               seed=F.col("pair_id") + 100)
    return split.select("pair_id", "subsample_id", "USER_ID", "split")


_STEPS = " + ".join(f"CASE WHEN u >= {s!r}::DOUBLE THEN 1 ELSE 0 END" for s in M.POISSON_STEPS)


@query("e7_bootstrap_weights", sql("clean", f"""
SELECT USER_ID, b AS bootstrap, {_STEPS} AS weight FROM (SELECT USER_ID, b,
  CAST('0x' || substr(md5(USER_ID || '|' || (b + 42)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM users_clean, range(0, 10) r(b))"""))
def bootstrap(spark, sf):
    users = I.users_clean(spark, sf).select(
        "USER_ID", F.explode(F.sequence(F.lit(0), F.lit(C.BOOTSTRAPS - 1))).alias("bootstrap"))
    return users.withColumn("weight", M.bootstrap_weight(F.col("bootstrap") + C.BASE_SEED))


@query("e7_exact_bootstraps", sql("clean", """
, numbered AS (SELECT USER_ID, row_number() OVER (ORDER BY USER_ID) - 1 AS number FROM users_clean),
size AS (SELECT count(*) AS n FROM users_clean),
hits AS (SELECT b AS bootstrap, count(*) AS weight,
  CAST(floor(CAST('0x' || substr(md5(number || '|' || (b + 42)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * n) AS BIGINT) AS hit
  FROM numbered, size, range(0, 10) r(b) GROUP BY ALL)
SELECT USER_ID, bootstrap, weight FROM hits JOIN numbered ON hit = number"""))
def exact_bootstrap(spark, sf):
    """Ten resamples of exactly as many draws as there are users."""
    return M.exact_bootstraps(I.users_clean(spark, sf), C.BOOTSTRAPS)


@query("e8_account_groups", sql("label", f"""
SELECT "group", count(*) AS n, round(avg(persistence_c), 6) AS mean_persistence FROM (
  SELECT 'Full' AS "group", persistence_c FROM users_labelled WHERE {tier_d(2)}
  UNION ALL SELECT ACCOUNT_TYPE, persistence_c FROM users_labelled WHERE {tier_d(2)}) GROUP BY 1"""))
def account_groups(spark, sf):
    users = M.by_account_type(I.tier_d(I.users_labelled(spark, sf), 2))
    return users.groupBy("group").agg(
        F.count("*").alias("n"), F.round(F.avg("persistence_c"), 6).alias("mean_persistence"))


@query("e8_group_subsamples", sql("label", f"""
SELECT "group", subsample_id, USER_ID FROM (SELECT *, row_number() OVER (PARTITION BY "group", subsample_id
  ORDER BY md5(USER_ID || '|' || (subsample_id + 42)), USER_ID) AS rk FROM (
    SELECT 'Full' AS "group", USER_ID FROM users_labelled WHERE {tier_d(2)}
    UNION ALL SELECT ACCOUNT_TYPE, USER_ID FROM users_labelled WHERE {tier_d(2)}), range(1, 6) r(subsample_id))
WHERE rk <= 100"""))
def group_subsamples(spark, sf):
    users = M.by_account_type(I.tier_d(I.users_labelled(spark, sf), 2))
    return M.repeated_samples(users, 100, 5, "group")


@query("e9_cached_sample", sql("label", """
SELECT count(*) AS n_rows, count(DISTINCT USER_ID) AS n_users FROM (
  SELECT USER_ID FROM users_labelled ORDER BY md5(USER_ID || '|42'), USER_ID LIMIT 500000)"""))
def cached_sample(spark, sf):
    path = result_path(spark, "sample_500k")
    sample = M.simple_sample(I.users_labelled(spark, sf), 500_000)
    return sinks.write_table(sample, path).agg(
        F.count("*").alias("n_rows"), F.count_distinct("USER_ID").alias("n_users"))


@query("e10_subsample_metadata", sql("label", """
SELECT subsample_id, count(*) AS n_rows, count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'test') AS n_test,
  round(avg(coalesce(persist_median, 0)) * 100, 4) AS persist_rate,
  round(avg(tenure_days), 4) AS mean_tenure, count(DISTINCT stratum) AS n_strata
FROM split GROUP BY subsample_id""", *_CTES))
def metadata(spark, sf):
    return M.subsample_metadata(drawn(spark, sf))


@query("e11_population_estimate", sql("label", """
SELECT subsample_id, activity_segment, count(*) AS n_sampled, round(sum(sampling_weight), 6) AS estimate,
  round(sum(sampling_weight) * 100.0 / sum(sum(sampling_weight)) OVER (PARTITION BY subsample_id), 4) AS pct
FROM drawn GROUP BY 1, 2""", *_CTES))
def population_estimate(spark, sf):
    out = M.population_estimate(drawn(spark, sf), ["subsample_id", "activity_segment"])
    return out.withColumn("estimate", F.round("estimate", 6))


@query("k1_table_replace", sql("label", "SELECT count(*) AS n_rows FROM users_labelled"))
def table_replace(spark, sf):
    path = result_path(spark, "table_replace")
    users = I.users_labelled(spark, sf).select("USER_ID", "persistence_c")
    return sinks.write_table(users, path).agg(F.count("*").alias("n_rows"))


@query("k2_s3_subsample_files", sql("label", """
SELECT subsample_id, count(*) AS n_drawn, count(*) AS n_read, TRUE AS columns_match FROM drawn
GROUP BY subsample_id""", *_CTES))
def subsample_files(spark, sf):
    path = result_path(spark, "subsample_files")
    rows = drawn(spark, sf)
    return sinks.verify_subsamples(rows, sinks.write_subsamples(rows, path))


@query("s3_read_one_subsample", sql("label", """
SELECT USER_ID, persistence_c FROM drawn WHERE subsample_id = 3""", *_CTES))
def read_one(spark, sf):
    from cohortry.sources.users import read_subsamples

    path = result_path(spark, "one_subsample")
    sinks.write_subsamples(drawn(spark, sf), path)
    return read_subsamples(spark, path, [3]).select("USER_ID", "persistence_c")


@query("k3_qc_log", sql("clean", """
SELECT '1.2' AS step, m AS metric, CAST(v AS VARCHAR) AS value, 'activity block' AS note FROM (
  SELECT 'n_users' AS m, count(*) AS v FROM users_clean
  UNION ALL SELECT 'n_untracked', count(*) FILTER (WHERE is_mnar) FROM users_clean
  UNION ALL SELECT 'n_countries', count(DISTINCT COUNTRY) FROM users_clean)"""))
def qc_log(spark, sf):
    metrics = I.users_clean(spark, sf).agg(
        F.count("*").alias("n_users"), F.count_if("is_mnar").alias("n_untracked"),
        F.count_distinct("COUNTRY").alias("n_countries"))
    return sinks.qc_rows("1.2", metrics, "activity block")


@query("k3_qc_log_appended", sql("clean", """
SELECT step, m AS metric, CAST(v AS VARCHAR) AS value, note, TRUE AS stamped FROM (
  SELECT '1.2' AS step, 'n_users' AS m, count(*) AS v, 'all' AS note FROM users_clean
  UNION ALL SELECT '1.3', 'n_untracked', count(*) FILTER (WHERE is_mnar), 'activity block' FROM users_clean)"""))
def qc_log_appended(spark, sf):
    """Two steps append to one log, which is read back."""
    path, users = result_path(spark, "qc_log"), I.users_clean(spark, sf)
    sinks.append_qc(sinks.qc_rows("1.2", users.agg(F.count("*").alias("n_users")), "all"), path)
    sinks.append_qc(sinks.qc_rows("1.3", users.agg(F.count_if("is_mnar").alias("n_untracked")), "activity block"), path)
    return spark.read.parquet(path).select("step", "metric", "value", "note", F.col("logged_at").isNotNull().alias("stamped"))


@query("k4_run_registry")
def run_registry(spark, sf):
    path = result_path(spark, "registry")
    runs = sinks.run_rows(M.subsample_metadata(drawn(spark, sf)), "sampling",
                          {"exclusions": "untracked, tenure under 31 days, outside tier D"},
                          C.BASE_SEED)
    return sinks.register_runs(runs, path)


@query("k5_result_csv", sql("label", """
SELECT activity_segment, count(*) AS n FROM users_labelled GROUP BY activity_segment"""))
def result_csv(spark, sf):
    path = result_path(spark, "segments_csv")
    counts = I.users_labelled(spark, sf).groupBy("activity_segment").agg(F.count("*").alias("n"))
    return sinks.write_csv(counts, path)


@query("k5_block_checks", sql("raw", "SELECT 'activity' AS block, count(*) AS n_users FROM users_raw"))
def block_checks(spark, sf):
    return clean.block_missingness(I.users_raw(spark, sf)).select(
        F.lit("activity").alias("block"), "n_users")
