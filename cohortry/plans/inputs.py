"""Layers every query starts from: raw, cleaned, featured and enriched users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.functions import columns as X
from cohortry.operators import clean, enrich, features, labels
from cohortry.session import materialize
from cohortry.sources import standins as S

REFERENCE = S.PERIOD_END

_LAYERS: dict[tuple[str, str, str], DataFrame] = {}


def layer(spark: SparkSession, sf: str, name: str,
          build: Callable[[], DataFrame]) -> DataFrame:
    """A layer as a written table, built once per application and read by all queries."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _LAYERS:
        _LAYERS[key] = materialize(build())
    return _LAYERS[key]


def users_raw(spark: SparkSession, sf: str) -> DataFrame:
    return layer(spark, sf, "users_raw", lambda: S.users_raw(spark, sf))


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    """Name -> code, written once: its size on file decides on broadcasting."""
    return layer(spark, sf, "crosswalk", lambda: _crosswalk(spark, sf))


def _crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    names = S.table(spark, sf, "nation").select(S.country_label().alias("country_name"))
    return enrich.resolve_names(names, S.iso_names(spark, sf), S.manual_codes(spark, sf))


def users_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_users(users_raw(spark, sf), crosswalk(spark, sf),
                             F.lit(REFERENCE))


def features_without_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return features.add_features(users_clean(spark, sf), F.lit(REFERENCE))


def users_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.add_country_cluster(
        features_without_cluster(spark, sf), S.country_groups(spark, sf),
        S.HOME_COUNTRY, S.HOME_CORE_AREA)


def users_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Featured users with labels, written once; the cuts come from their scores, written before."""
    def build():
        users = users_features(spark, sf)
        scores = layer(spark, sf, "persistence_scores", lambda: users.select("is_mnar", "persistence_c"))
        return labels.add_persistence_labels(users, population=scores)

    return layer(spark, sf, "users_labelled", build)


def tracked(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_mnar"))


def tier_d(df: DataFrame, min_logins: int = 1) -> DataFrame:
    return df.filter(X.tier_d(min_logins))


def nation_year(spark: SparkSession, sf: str) -> DataFrame:
    return layer(spark, sf, "nation_year", lambda: S.nation_year(spark, sf))


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.latest_indicators(S.indicator_records(spark, sf, nation_year(spark, sf)))


def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """The country dimension, written once: its measured size decides on broadcasting."""
    return layer(spark, sf, "enrichment", lambda: _enrichment(spark, sf))


def _enrichment(spark: SparkSession, sf: str) -> DataFrame:
    shares, diversity = S.composition(spark, sf, nation_year(spark, sf))
    answers, code_labels = S.attitudes(spark, sf)
    return enrich.assert_unique(enrich.build_enrichment(
        crosswalk(spark, sf),
        enrich.pivot_indicators(indicators(spark, sf)),
        enrich.latest_index(S.index_wide(spark, sf, nation_year(spark, sf))),
        enrich.latest_snapshot(S.snapshots(spark, sf, nation_year(spark, sf))),
        [
            enrich.religious_composition(shares, diversity, S.LATEST_YEAR),
            enrich.religious_restrictions(S.restrictions(spark, sf, nation_year(spark, sf)), S.LATEST_YEAR),
            enrich.attitude_shares(answers, code_labels),
        ],
    ))


def users_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich_users(users_labelled(spark, sf), enrichment(spark, sf))
