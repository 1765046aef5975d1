"""Column expressions: cleaning rules, tenure, rates, scores and segments."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, functions as F

from cohortry import config as C


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def total(columns: Iterable[Column]) -> Column:
    return reduce(add, columns)


def zero(column: str | Column) -> Column:
    """Null means "none of it": used for counts."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0.0))


# --- cleaning -----------------------------------------------------------------------


def clean_age(column: str) -> Column:
    age = F.col(column)
    return F.when(age < 8, None).when(age > 110, 110).otherwise(age)


def clean_text(column: str) -> Column:
    """Null for placeholder text; other values stay as they are, spaces included."""
    return F.when(F.trim(column).isin(C.SENTINELS), None).otherwise(F.col(column))


def is_untracked(columns: Iterable[str] = C.ACTIVITY_COLUMNS) -> Column:
    return all_of(F.col(c).isNull() for c in columns)


def clip(column: str | Column, lower=None, upper=None) -> Column:
    """Bounded value that keeps nulls (``greatest`` alone would fill them)."""
    value = F.col(column) if isinstance(column, str) else column
    bounded = value if lower is None else F.greatest(value, F.lit(lower))
    bounded = bounded if upper is None else F.least(bounded, F.lit(upper))
    return F.when(value.isNotNull(), bounded)


def number_from_text(column: str) -> Column:
    """Double from text with thousands commas, null where it is not a number."""
    return F.regexp_replace(column, ",", "").try_cast("double")


# --- velocity -----------------------------------------------------------------------


def gap_days(start: str, end: str, floor: bool = True) -> Column:
    """Days from ``start`` to ``end``, null unless both dates are known."""
    days = F.datediff(end, start)
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days)) if floor else days


VELOCITY_GAPS = {
    "days_to_first_login": ("account_create_date", "earliest_login_date"),
    "days_login_to_tree_edit": ("earliest_login_date", "earliest_tree_edit_date"),
    "days_login_to_name": ("earliest_login_date", "earliest_name_date"),
    "days_tree_to_source": ("earliest_tree_edit_date", "earliest_source_date"),
    "days_to_first_tree_edit": ("account_create_date", "earliest_tree_edit_date"),
    "days_to_first_name": ("account_create_date", "earliest_name_date"),
}


def velocity() -> dict[str, Column]:
    return {name: gap_days(*dates) for name, dates in VELOCITY_GAPS.items()}


def activation_speed() -> Column:
    login = gap_days("account_create_date", "earliest_login_date")
    tree = gap_days("earliest_login_date", "earliest_tree_edit_date")
    return 1.0 / (1.0 + login + F.coalesce(tree, F.lit(0)))


def days_to_first() -> dict[str, Column]:
    """Days from account creation to each of the seven milestones."""
    return {
        f"days_to_{code}": gap_days("account_create_date", c)
        for code, c in C.MILESTONES.items()
    }


# --- volume -------------------------------------------------------------------------


def weeks() -> Column:
    return F.greatest(F.col("tenure_weeks"), F.lit(1.0))


def per_week(column: str) -> Column:
    return zero(column) / weeks()


def rates() -> dict[str, Column]:
    return {f"{stem}_per_week": per_week(c) for stem, (c, _) in C.RATES.items()}


def log_features() -> dict[str, Column]:
    # ln(1 + x) as published: log1p differs in the last bits, which ranks would see
    logs = {f"log_{stem}_pw": F.log(1 + per_week(c)) for stem, (c, _) in C.RATES.items()}
    return logs | {name: F.log(1 + zero(c)) for c, name in C.RATES.values()}


def prorated(days: int = 90) -> dict[str, Column]:
    """Counts scaled to a fixed window of the account's life."""
    tenure = F.col("tenure_days")
    share = F.least(F.lit(float(days)), tenure)
    return {
        f"{stem}_{days}d": zero(c) * share / F.greatest(tenure, F.lit(1.0))
        for stem, (c, _) in C.RATES.items()
    }


# --- activity -----------------------------------------------------------------------


def flags() -> dict[str, Column]:
    return {name: (zero(c) > 0).cast("int") for name, c in C.FLAGS.items()}


def breadth(include_login: bool = True) -> Column:
    return total(flag for name, flag in flags().items()
                 if include_login or name != "has_login")


def funnel_stage() -> Column:
    def active(*names: str) -> Column:
        return any_of(zero(C.FLAGS[n]) > 0 for n in names)

    return (
        F.when(active("has_record_edits", "has_get_involved"), 4)
        .when(active("has_sources"), 3)
        .when(active("has_tree_edits", "has_names"), 2)
        .when(active("has_login"), 1)
        .otherwise(0)
    )


def login_share_of_days() -> Column:
    """Login days per day of tenure, at most 1."""
    tenure = F.greatest(F.col("tenure_days"), F.lit(1))
    return F.least(zero("DAYS_LOGGING_IN") / tenure, F.lit(1.0))


def tenure_weight(weekly: bool = False) -> Column:
    tenure = F.col("tenure_days")
    return F.log(F.greatest(tenure / 7, F.lit(1.0))) if weekly else F.log1p(tenure)


def age_group(column: str = "user_age") -> Column:
    age = F.col(column)
    label = F.when(age.isNull(), None)
    for bound, name in zip(C.AGE_BOUNDS, C.AGE_LABELS):
        label = label.when(age <= bound, name)
    return label.otherwise(C.AGE_LABELS[-1])


def age_bin(column: str) -> Column:
    """Interval form of the age groups on raw ages: null below 7, for 0 and above 110."""
    age = F.col(column)
    label = F.when(age.isNull() | (age < 7) | (age > 110), None)
    for bound, name in zip(C.AGE_BOUNDS, C.AGE_LABELS):
        label = label.when(age <= bound, name)
    return label.otherwise(C.AGE_LABELS[-1])


# --- persistence --------------------------------------------------------------------


def last_core_milestone() -> Column:
    created = F.col("account_create_date")
    return F.greatest(*[F.coalesce(C.MILESTONES[m], created) for m in C.CORE_MILESTONES])


def first_core_milestone() -> Column:
    never = F.lit(C.NO_MILESTONE_DATE)
    return F.least(*[F.coalesce(C.MILESTONES[m], never) for m in C.CORE_MILESTONES])


def activity_spread() -> Column:
    """Persistence B: share of the tenure between first and last core milestone."""
    first, last = first_core_milestone(), last_core_milestone()
    span = F.datediff(last, first)
    tenure = F.greatest(F.col("tenure_days"), F.lit(1))
    return F.when(last > first, span * 1.0 / tenure).otherwise(0.0)


def survival_score(reference: Column) -> Column:
    """Persistence C: login consistency, recency and breadth, a third each."""
    last = last_core_milestone()
    tenure = F.greatest(F.col("tenure_days"), F.lit(1))
    consistency = F.least(F.lit(1.0), per_week("DAYS_LOGGING_IN")) / 3.0
    recency = F.when(
        last > F.col("account_create_date"),
        (1.0 - F.datediff(reference, last) * 1.0 / tenure) / 3.0,
    ).otherwise(0.0)
    return consistency + recency + breadth() / 7.0 / 3.0


# --- segments and populations -------------------------------------------------------


def activity_segment(light: int = 2, moderate: int = 10, regular: int = 50,
                     single_is_light: bool = False) -> Column:
    """Segments A to H; the alternative cut sends only single-login users to E."""
    logins, wide = zero("DAYS_LOGGING_IN"), F.col("activity_breadth")
    no_output = all_of(zero(c) == 0
                       for c in ("TREE_EDITS", "TOTAL_NAMES_ADDED", "SOURCES_ADDED"))
    light_cut = 1 if single_is_light else light
    moderate_cut, regular_cut = (5, 50) if single_is_light else (moderate, regular)
    return (
        F.when(F.col("is_mnar"), "A_MNAR")
        .when(F.col("tenure_days") < C.MIN_TENURE_DAYS, "X_SHORT_TENURE")
        .when((logins == 0) & (wide == 0), "B_NO_ACTIVITY")
        .when((logins == 0) & (wide > 0), "C_NONLOGIN_CONTRIB")
        .when((logins == 1) & no_output, "D_SINGLE_BROWSE")
        .when(logins <= light_cut, "E_LIGHT")
        .when(logins <= moderate_cut, "F_MODERATE")
        .when(logins <= regular_cut, "G_REGULAR")
        .otherwise("H_POWER")
    )


def tier_d(min_logins: int = 1) -> Column:
    """Tracked users past the first month who log in, edit the tree and add names."""
    return all_of([
        ~F.col("is_mnar"),
        F.col("tenure_days") >= C.MIN_TENURE_DAYS,
        zero("DAYS_LOGGING_IN") >= min_logins,
        zero("TREE_EDITS") > 0,
        zero("TOTAL_NAMES_ADDED") > 0,
        *[F.col(C.MILESTONES[m]).isNotNull() for m in ("L", "T", "N")],
    ])


def data_tier() -> Column:
    """How much is known of a user, from untracked to E (tier D with sources)."""
    return (
        F.when(F.col("is_mnar"), "MNAR")
        .when(zero("DAYS_LOGGING_IN") == 0, "NON_LOGIN")
        .when(tier_d() & (zero("SOURCES_ADDED") > 0)
              & F.col("earliest_source_date").isNotNull(), "E")
        .when(tier_d(), "D")
        .otherwise("BROWSE")
    )


def ratio_of_names(part: str) -> Column:
    names = zero("TOTAL_NAMES_ADDED")
    return F.when(names > 0, zero(part) / names).otherwise(0.0)


def login_tier() -> Column:
    logins = zero("DAYS_LOGGING_IN")
    return (
        F.when(logins == 0, "0").when(logins == 1, "1").when(logins <= 5, "2-5")
        .when(logins <= 30, "6-30").otherwise("31+")
    )
