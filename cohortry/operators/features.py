"""Feature table: one projection over the cleaned users, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortry import config as C
from cohortry.functions import columns as X


def add_country_cluster(users: DataFrame, groups: DataFrame,
                        home_country: str = C.HOME_COUNTRY,
                        core_area: str = C.HOME_CORE_AREA) -> DataFrame:
    """Cluster by a name -> cluster dimension; the home country splits by area."""
    lookup = groups.select(F.col("country_name").alias("COUNTRY"), "cluster")
    home = F.col("COUNTRY") == home_country
    label = (
        F.when(home & (F.col("USER_AREA_NAME") == core_area), C.CLUSTER_HOME_CORE)
        .when(home, C.CLUSTER_HOME_OTHER)
        .otherwise(F.coalesce("cluster", F.lit(C.CLUSTER_OTHER)))
    )
    return (
        users.join(lookup, "COUNTRY", "left")
        .withColumn("country_cluster", label).drop("cluster")
    )


def default_country_groups(spark) -> DataFrame:
    """The literal country lists as a dimension."""
    rows = [(name, cluster) for cluster, names in C.CLUSTER_COUNTRIES.items()
            for name in names]
    return spark.createDataFrame(rows, "country_name string, cluster string")


def milestone_sequence() -> Column:
    """Codes of the reached milestones by (date, code), as ``L>N>T``; no shuffle.

    Empty for untracked users and for users without login, tree edit or name.
    """
    known = F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("d"), F.lit(m).alias("m")))
        for m, c in C.MILESTONES.items()
    ])
    ordered = F.array_sort(F.filter(known, lambda s: s.isNotNull()))
    relevant = ~F.col("is_mnar") & X.any_of(
        F.col(C.MILESTONES[m]).isNotNull() for m in ("L", "T", "N")
    )
    text = F.array_join(F.transform(ordered, lambda s: s["m"]), ">")
    return F.when(relevant, text).otherwise("")


def milestone_rows(users: DataFrame) -> DataFrame:
    """Long form: one row per user and reached milestone."""
    relevant = users.filter(~F.col("is_mnar") & X.any_of(
        F.col(C.MILESTONES[m]).isNotNull() for m in ("L", "T", "N")
    ))
    return (
        relevant.select("USER_ID", *[F.col(c).alias(m) for m, c in C.MILESTONES.items()])
        .unpivot("USER_ID", list(C.MILESTONES), "milestone", "milestone_date")
        .filter(F.col("milestone_date").isNotNull())
    )


def sequences_by_aggregation(users: DataFrame) -> DataFrame:
    """The same sequence through an ordered string aggregate (a user has <= 7 rows)."""
    pairs = F.array_sort(F.collect_list(F.struct("milestone_date", "milestone")))
    return milestone_rows(users).groupBy("USER_ID").agg(
        F.array_join(F.transform(pairs, lambda s: s["milestone"]), ">")
        .alias("milestone_sequence")
    )


def write_back_sequences(users: DataFrame, sequences: DataFrame) -> DataFrame:
    """Join a key -> sequence table to the users; users without one get ''."""
    return users.drop("milestone_sequence").join(sequences, "USER_ID", "left").withColumn(
        "milestone_sequence", F.coalesce("milestone_sequence", F.lit(""))
    )


def add_features(clean: DataFrame, reference: Column) -> DataFrame:
    """All per-user features except labels and country cluster."""
    weekly_logins = X.per_week("DAYS_LOGGING_IN")
    return clean.withColumns(
        X.velocity()
        | {"activation_speed": X.activation_speed()}
        | X.rates()
        | X.log_features()
        | X.prorated()
        | X.flags()
        | {
            "activity_breadth": X.breadth(),
            "funnel_stage": X.funnel_stage(),
            "login_consistency": weekly_logins,
            "tenure_weight": X.tenure_weight(),
            "age_group": X.age_group(),
            "persistence_a": weekly_logins,
            "persistence_b": X.activity_spread(),
            "persistence_c": X.survival_score(reference),
            "milestone_sequence": milestone_sequence(),
        }
    ).withColumn("activity_segment", X.activity_segment())


def wide_rates(users: DataFrame) -> DataFrame:
    """Seven rates over a tenure of at least one day, rounded half-even to four digits."""
    weeks = F.greatest(F.greatest(F.col("tenure_days"), F.lit(1)) / 7, F.lit(1.0))
    return users.withColumns(
        {name: F.rint(X.zero(c) / weeks * 10000) / 10000 for name, c in C.WIDE_RATES.items()}
    )


CLUSTERING_LOGS = ["DAYS_LOGGING_IN", "TREE_EDITS", "SOURCES_ADDED", "TOTAL_NAMES_ADDED"]


def clustering_features(users: DataFrame, age: str = "USER_CURRENT_AGE") -> DataFrame:
    """Clustering matrix: 16 columns with nulls as zero, and four logs of counts."""
    filled = wide_rates(users).select(
        "USER_ID",
        *C.WIDE_RATES,
        X.breadth(include_login=False).alias("N_ACTIVITY_TYPES"),
        X.login_share_of_days().alias("LOGIN_CONSISTENCY"),
        X.ratio_of_names("DECEASED_NAMES_ADDED").alias("PCT_DECEASED_NAMES"),
        X.ratio_of_names("NOVEL_NAMES_ADDED").alias("PCT_NOVEL_NAMES"),
        F.coalesce(F.col(age), F.lit(0)).alias("USER_CURRENT_AGE"),
        *[X.zero(c).alias(c) for c in CLUSTERING_LOGS],
    )
    return filled.withColumns({f"{c}_LOG": F.log1p(c) for c in CLUSTERING_LOGS})
