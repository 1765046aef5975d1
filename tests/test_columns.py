"""Edge rows of the cleaning and feature rules."""

from datetime import date

from pyspark.sql import functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators import clean, enrich, features


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def user(spark, *rows):
    """Cleaned users from dicts; everything else is null or zero."""
    base = {"USER_ID": 1, "account_create_date": date(2001, 1, 1), "is_mnar": False,
            "tenure_days": 70, "tenure_weeks": 10.0, "user_age": 30}
    base |= {c: None for c in C.MILESTONES.values()}
    base |= {c: 0.0 for c in C.ACTIVITY_COLUMNS + C.NAME_COLUMNS}
    schema = ("USER_ID long, account_create_date date, is_mnar boolean, tenure_days int, "
              "tenure_weeks double, user_age long, "
              + ", ".join(f"{c} date" for c in C.MILESTONES.values()) + ", "
              + ", ".join(f"{c} double" for c in C.ACTIVITY_COLUMNS + C.NAME_COLUMNS))
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)


def test_age_rules(spark):
    df = spark.createDataFrame([(a,) for a in (-1, 0, 1, 7, 8, 110, 111, None)], "a long")
    assert values(df, X.clean_age("a")) == [(None,)] * 4 + [(8,), (110,), (110,), (None,)]


def test_sentinels_keep_other_text(spark):
    df = spark.createDataFrame([(s,) for s in (" Unknown ", "-", "", " x ", None)], "s string")
    assert values(df, X.clean_text("s")) == [(None,), (None,), (None,), (" x ",), (None,)]


def test_block_missingness(spark):
    def row(*null):
        return tuple(None if c in null else 1.0 for c in C.ACTIVITY_COLUMNS)

    rows = [row(), row(*C.ACTIVITY_COLUMNS), row("TREE_EDITS")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in C.ACTIVITY_COLUMNS))
    got = clean.block_missingness(df).head()
    assert (got.n_all_null, got.n_any_null, got.block_or_nothing) == (1, 2, False)


def test_same_day_milestones_sort_by_code(spark):
    day = date(2001, 2, 1)
    df = user(spark, {"earliest_login_date": day, "earliest_tree_edit_date": day,
                      "earliest_name_date": day},
              {"earliest_source_date": day}, {"earliest_login_date": day, "is_mnar": True})
    assert values(df, features.milestone_sequence()) == [("L>N>T",), ("",), ("",)]


def test_sequence_forms_agree(spark):
    df = user(spark, {"USER_ID": 1, "earliest_login_date": date(2001, 3, 1),
                      "earliest_source_date": date(2001, 2, 1)},
              {"USER_ID": 2, "earliest_source_date": date(2001, 2, 1)})
    joined = features.write_back_sequences(df, features.sequences_by_aggregation(df))
    got = dict(values(joined, "USER_ID", "milestone_sequence"))
    assert got == {1: "S>L", 2: ""} == dict(values(df, "USER_ID", features.milestone_sequence()))


def test_tenure_floor_in_rates(spark):
    df = user(spark, {"DAYS_LOGGING_IN": 3.0, "tenure_days": 0, "tenure_weeks": 0.0},
              {"DAYS_LOGGING_IN": 3.0, "tenure_days": 91, "tenure_weeks": 13.0})
    assert values(df, X.per_week("DAYS_LOGGING_IN")) == [(3.0,), (3.0 / 13,)]
    assert values(df, X.prorated()["logins_90d"]) == [(0.0,), (3.0 * 90 / 91,)]


def test_persistence_without_and_with_milestones(spark):
    ref = F.lit(date(2001, 3, 12))
    df = user(spark, {}, {"earliest_login_date": date(2000, 12, 22)},
              {"earliest_login_date": date(2001, 1, 1)}, {"earliest_tree_edit_date": date(2001, 3, 12)})
    # before creation: the create date closes the span, and recency needs a later milestone
    assert values(df, X.activity_spread()) == [(0.0,), (10 / 70,), (0.0,), (0.0,)]
    got = [r[0] for r in values(df, X.survival_score(ref))]
    assert got[:3] == [0.0, 0.0, 0.0] and abs(got[3] - 1 / 3) < 1e-12


def test_segments(spark):
    logins = [0, 1, 2, 10, 11, 50, 51]
    df = user(spark, *[{"DAYS_LOGGING_IN": float(n), "TREE_EDITS": 1.0 if n else 0.0} for n in logins])
    df = df.withColumn("activity_breadth", X.breadth())
    assert [r[0][0] for r in values(df, X.activity_segment())] == list("BEEFGGH")
    assert [r[0][0] for r in values(df, X.activity_segment(single_is_light=True))] == list("BEFGGGH")


def test_age_groups(spark):
    df = spark.createDataFrame([(a,) for a in (19, 20, 79, 80, None)], "user_age long")
    assert values(df, X.age_group()) == [("8-19",), ("20-29",), ("70-79",), ("80+",), (None,)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (5.0,)], "x double")
    assert values(df, X.clip("x", 0.0, 2.0)) == [(None,), (0.0,), (2.0,)]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1,234",), ("n/a",), (None,)], "s string")
    assert values(df, X.number_from_text("s")) == [(1234.0,), (None,), (None,)]


def test_literal_country_lists(spark):
    df = spark.createDataFrame(
        [("United States", "Utah Area"), ("United States", "x"), ("Brazil", "x"), ("Japan", "x"),
         ("Nowhere", "x"), (None, "x")], "COUNTRY string, USER_AREA_NAME string")
    out = features.add_country_cluster(df, features.default_country_groups(spark))
    assert {r.COUNTRY: r.country_cluster for r in out.filter("USER_AREA_NAME = 'x'").collect()} == {
        "United States": "Mod-Eng-US-Other", "Brazil": "High-LDS-International",
        "Japan": "Low-Eng-High-Dev", "Nowhere": "Micro-Other", None: "Micro-Other"}
    assert out.filter("USER_AREA_NAME = 'Utah Area'").head().country_cluster == "High-LDS-US-Utah"


def test_name_cascade(spark):
    names = spark.createDataFrame([("Russia",), ("Unknown",), ("france",), ("The Gambia",),
                                   ("Solomon Islands",), ("Atlantis",), (None,)], "country_name string")
    standard = spark.createDataFrame([("France", "FRA"), ("Gambia", "GMB"), ("Solomon", "SLB")],
                                     "name string, alpha3 string")
    out = enrich.resolve_names(names, standard, enrich.default_manual_codes(spark))
    got = {r.country_name: (r.iso3_code, r.match_method) for r in out.collect()}
    assert got == {"Russia": ("RUS", "manual"), "Unknown": (None, "manual"),
                   "france": ("FRA", "exact"), "The Gambia": ("GMB", "cleaned"),
                   "Solomon Islands": ("SLB", "cleaned"), "Atlantis": (None, "unmatched"),
                   None: (None, "unmatched")}
