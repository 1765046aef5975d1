"""Queries on country codes, country-level sources and the enrichment dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import config as C
from cohortry.operators import enrich, profile as P
from cohortry.plans import inputs as I
from cohortry.plans.registry import query
from cohortry.plans.sql_base import ATTITUDES, COMPOSITION, RESTRICTIONS, rounded, sql
from cohortry.session import result_path
from cohortry.sources import standins as S

_SNAP = ["lds_membership", "lds_congregations", "lds_temples", "lds_stakes", "lds_country_pop"]
_IND = list(C.INDICATORS.values())
_INDEX = ["hdi", "education_index", "life_expectancy"]
ENRICHMENT_COLUMNS = (_IND + _INDEX + _SNAP + ["lds_members_per_capita", "gepi"]
                      + COMPOSITION + RESTRICTIONS + ATTITUDES)


def r6(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("s4_indicator_records", sql("country", """
SELECT economy, time, indicator, round(value, 6) AS value, aggregate FROM indicator_records"""))
def indicator_records(spark, sf):
    return r6(S.indicator_records(spark, sf, I.nation_year(spark, sf)), ["value"])


@query("s5_latest_index", sql("country", f"SELECT iso3_code, {rounded(_INDEX)} FROM hdi"))
def latest_index(spark, sf):
    return r6(enrich.latest_index(S.index_wide(spark, sf, I.nation_year(spark, sf))), _INDEX)


@query("s5_index_csv", sql("country", f"SELECT iso3_code, {rounded(_INDEX)}, TRUE AS accent_kept FROM hdi"))
def index_csv(spark, sf):
    """The index through its CSV reader, from a file that is not UTF-8."""
    path = result_path(spark, "index_csv")
    wide = S.index_wide(spark, sf, I.nation_year(spark, sf))
    wide.withColumn("note", F.lit("indice d'évaluation")).write.option("encoding", "ISO-8859-1").csv(path, header=True)
    back = enrich.read_index_csv(spark, path)
    kept = back.agg(F.bool_and(F.col("note") == "indice d'évaluation")).head()[0]
    return r6(enrich.latest_index(back.drop("note")), _INDEX).withColumn("accent_kept", F.lit(kept))


@query("s6_w2_latest_snapshot", sql("country", f"""
SELECT country_name, CAST(snapshot_date AS VARCHAR) AS snapshot_date, {', '.join(_SNAP)} FROM snapshot"""))
def latest_snapshot(spark, sf):
    out = enrich.latest_snapshot(S.snapshots(spark, sf, I.nation_year(spark, sf)))
    return out.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query("s7_composition", sql("country", f"SELECT country_name, {rounded(COMPOSITION)} FROM composition"))
def composition(spark, sf):
    shares, diversity = S.composition(spark, sf, I.nation_year(spark, sf))
    return r6(enrich.religious_composition(shares, diversity, S.LATEST_YEAR), COMPOSITION)


@query("s8_restrictions", sql("country", f"SELECT country_name, {rounded(RESTRICTIONS)} FROM restrictions"))
def restrictions(spark, sf):
    rows = S.restrictions(spark, sf, I.nation_year(spark, sf))
    return r6(enrich.religious_restrictions(rows, S.LATEST_YEAR), RESTRICTIONS)


@query("s9_a11_attitudes", sql("country", f"SELECT country_name, {', '.join(ATTITUDES)} FROM attitudes"))
def attitudes(spark, sf):
    return enrich.attitude_shares(*S.attitudes(spark, sf))


@query("w1_latest_indicators", sql("country", """
SELECT economy, indicator, round(value, 6) AS value, time FROM latest_indicators"""))
def latest_indicators(spark, sf):
    return r6(I.indicators(spark, sf), ["value"])


@query("j1_users_with_codes", sql("clean", "SELECT USER_ID, COUNTRY, iso3_code FROM users_clean"))
def users_with_codes(spark, sf):
    return I.users_clean(spark, sf).select("USER_ID", "COUNTRY", "iso3_code")


_USED = ["gdp_per_capita_ppp", "hdi", "pct_christian", "lds_members_per_capita", "gepi"]


@query("j2_users_enriched", sql("all", f"""
SELECT USER_ID, u.iso3_code, {rounded(_USED)} FROM users_features u
LEFT JOIN enrichment e ON e.iso3_code = u.iso3_code"""))
def users_enriched(spark, sf):
    users = I.users_labelled(spark, sf).select("USER_ID", "iso3_code")
    return r6(enrich.enrich_users(users, I.enrichment(spark, sf), _USED), _USED)


@query("j3_user_coverage", sql("all", """
SELECT count(*) AS users_total, count(e.iso3_code) AS users_enrichable,
  count(gdp_per_capita_ppp) AS users_with_gdp_per_capita_ppp, count(hdi) AS users_with_hdi,
  count(gepi) AS users_with_gepi
FROM users_features u LEFT JOIN enrichment e ON e.iso3_code = u.iso3_code"""))
def coverage(spark, sf):
    return enrich.user_coverage(I.users_labelled(spark, sf), I.enrichment(spark, sf),
                                ["gdp_per_capita_ppp", "hdi", "gepi"])


@query("j3_users_with_index", sql("all", """
SELECT USER_ID FROM users_features WHERE iso3_code IN (SELECT iso3_code FROM enrichment WHERE hdi IS NOT NULL)"""))
def users_with_index(spark, sf):
    known = I.enrichment(spark, sf).filter(F.col("hdi").isNotNull()).select("iso3_code")
    return I.users_labelled(spark, sf).join(known, "iso3_code", "left_semi").select("USER_ID")


@query("j4_indicators_full_outer", sql("country", f"SELECT iso3_code, {rounded(_IND)} FROM wdi"))
def indicators_full_outer(spark, sf):
    return r6(enrich.join_indicators(I.indicators(spark, sf)), _IND)


@query("j4_sources_full_outer", sql("all", f"""
SELECT iso3_code, {rounded(COMPOSITION + RESTRICTIONS + ATTITUDES)} FROM composition_by_code
FULL JOIN restrictions_by_code USING (iso3_code) FULL JOIN attitudes_by_code USING (iso3_code)"""))
def sources_full_outer(spark, sf):
    codes = I.crosswalk(spark, sf)
    shares, diversity = S.composition(spark, sf, I.nation_year(spark, sf))
    rows = S.restrictions(spark, sf, I.nation_year(spark, sf))
    frames = [
        enrich.religious_composition(shares, diversity, S.LATEST_YEAR),
        enrich.religious_restrictions(rows, S.LATEST_YEAR),
        enrich.attitude_shares(*S.attitudes(spark, sf)),
    ]
    a, b, c = (enrich.unique_by_code(f, codes) for f in frames)
    return r6(a.join(b, "iso3_code", "full").join(c, "iso3_code", "full"),
              COMPOSITION + RESTRICTIONS + ATTITUDES)


@query("j5_enrichment", sql("enrich", f"SELECT iso3_code, {rounded(ENRICHMENT_COLUMNS)} FROM enrichment"))
def enrichment(spark, sf):
    out = r6(I.enrichment(spark, sf), ENRICHMENT_COLUMNS)
    return out.select("iso3_code", *ENRICHMENT_COLUMNS)


@query("j6_first_per_code", sql("enrich", f"SELECT iso3_code, {', '.join(_SNAP)} FROM snapshot_by_code"))
def first_per_code(spark, sf):
    rows = enrich.latest_snapshot(S.snapshots(spark, sf, I.nation_year(spark, sf)))
    return enrich.first_by_code(rows, I.crosswalk(spark, sf))


@query("j8_a12_composite_index", sql("enrich", """
SELECT iso3_code, round(gepi, 6) AS gepi, gepi_n_components FROM enrichment"""))
def composite(spark, sf):
    base = I.enrichment(spark, sf).drop("gepi")
    scored = enrich.composite_index(base)
    return scored.select("iso3_code", F.round("gepi", 6).alias("gepi"), "gepi_n_components")


@query("j9_country_crosswalk", sql("all", """
SELECT country_name, iso3_code, match_method FROM crosswalk
WHERE country_name IN (SELECT COUNTRY FROM users_raw)"""))
def crosswalk(spark, sf):
    names = I.users_raw(spark, sf).select(F.col("COUNTRY").alias("country_name"))
    return enrich.resolve_names(names, S.iso_names(spark, sf), S.manual_codes(spark, sf))


@query("j9_crosswalk_coverage", sql("xwalk", """
SELECT match_method, count(*) AS n, count(*) - count(iso3_code) AS n_null FROM crosswalk
GROUP BY match_method"""))
def crosswalk_coverage(spark, sf):
    return I.crosswalk(spark, sf).groupBy("match_method").agg(
        F.count("*").alias("n"), (F.count("*") - F.count("iso3_code")).alias("n_null"))


@query("a2_enrichment_coverage", sql("enrich", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_present, "
    f"round(count({c}) * 100.0 / count(*), 1) AS pct_present FROM enrichment"
    for c in ENRICHMENT_COLUMNS)))
def enrichment_coverage(spark, sf):
    return enrich.column_coverage(I.enrichment(spark, sf).select("iso3_code", *ENRICHMENT_COLUMNS))


@query("a13_members_per_capita", sql("enrich", """
SELECT iso3_code, round(lds_members_per_capita, 9) AS lds_members_per_capita FROM enrichment"""))
def per_capita(spark, sf):
    return I.enrichment(spark, sf).select(
        "iso3_code", F.round(enrich.members_per_capita(), 9).alias("lds_members_per_capita"))


@query("a31_country_composites", sql("enrich", """
SELECT iso3_code, round(internet_pct * hdi * education_index, 4) AS digital_readiness_score,
  round(lds_members_per_capita * (lds_temples / nullif(lds_country_pop, 0) * 1000000), 9)
    AS lds_intensity_score FROM enrichment"""))
def country_composites(spark, sf):
    return enrich.country_composites(I.enrichment(spark, sf)).select(
        "iso3_code", F.round("digital_readiness_score", 4).alias("digital_readiness_score"),
        F.round("lds_intensity_score", 9).alias("lds_intensity_score"))
