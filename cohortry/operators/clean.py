"""From the raw table to the cleaned one, and the counts of the cleaning rules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from cohortry import config as C
from cohortry.functions import columns as X


def reference_date(raw: DataFrame) -> DataFrame:
    """Latest of all dates as one row; columns absent from the table are skipped."""
    present = [c for c in C.DATE_COLUMNS if c in raw.columns]
    return raw.agg(
        F.greatest(*[F.max(F.to_date(c)) for c in present]).alias("reference_date")
    )


def reference_column(raw: DataFrame, fixed: date | None = None) -> Column:
    """The reference date as an expression: a literal, or a scalar subquery on ``raw``."""
    return F.lit(fixed) if fixed else reference_date(raw).scalar()


def clean_users(raw: DataFrame, crosswalk: DataFrame, reference: Column) -> DataFrame:
    """Cleaned users: typed dates, null sentinels, ISO code, untracked flag, tenure."""
    dated = [F.to_date(old).alias(new) for old, new in C.DATE_COLUMNS.items()]
    codes = crosswalk.select(F.col("country_name").alias("COUNTRY"), "iso3_code")
    tenure = F.datediff(reference, F.to_date("ACCOUNT_CREATE_DATE"))
    return raw.join(codes, "COUNTRY", "left").select(
        "USER_ID",
        dated[0],
        "ACCOUNT_TYPE",
        X.clean_age("USER_CURRENT_AGE").alias("user_age"),
        "COUNTRY",
        X.clean_text("PROVINCE").alias("province"),
        X.clean_text("CITY").alias("city"),
        "USER_WORLD_REGION",
        "USER_AREA_NAME",
        "iso3_code",
        *dated[1:],
        *C.ACTIVITY_COLUMNS,
        *C.NAME_COLUMNS,
        X.is_untracked().alias("is_mnar"),
        tenure.alias("tenure_days"),
        (tenure / F.lit(7.0)).alias("tenure_weeks"),
    )


def age_rule_counts(raw: DataFrame, column: str = "USER_CURRENT_AGE") -> DataFrame:
    age = F.col(column)
    return raw.agg(
        F.count_if(age.isNull()).alias("n_null"),
        F.count_if(age <= 0).alias("n_zero_or_negative"),
        F.count_if((age > 0) & (age < 8)).alias("n_below_8"),
        F.count_if(age > 110).alias("n_above_110"),
        F.count_if(X.clean_age(column).isNotNull()).alias("n_kept"),
    )


def sentinel_counts(raw: DataFrame, columns: tuple[str, ...] = ("PROVINCE", "CITY")) -> DataFrame:
    """Placeholder values per column and value, all columns in one pass."""
    return (
        raw.unpivot([], list(columns), "column_name", "raw_value")
        .withColumn("sentinel", F.trim("raw_value"))
        .filter(F.col("sentinel").isin(C.SENTINELS))
        .groupBy("column_name", "sentinel").agg(F.count("*").alias("n"))
    )


def block_missingness(raw: DataFrame) -> DataFrame:
    """All-null rows against any-null rows of the activity block; they must agree."""
    every = X.is_untracked()
    some = X.any_of(F.col(c).isNull() for c in C.ACTIVITY_COLUMNS)
    return raw.agg(
        F.count("*").alias("n_users"),
        F.count_if(every).alias("n_all_null"),
        F.count_if(some).alias("n_any_null"),
        (F.count_if(every) == F.count_if(some)).alias("block_or_nothing"),
    )
