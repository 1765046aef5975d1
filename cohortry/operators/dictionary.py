"""Descriptions of the engineered features, kept as column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DESCRIPTIONS = {
    "days_to_first_login": "Days from account creation to the first login",
    "days_login_to_tree_edit": "Days from the first login to the first tree edit",
    "days_login_to_name": "Days from the first login to the first added name",
    "days_tree_to_source": "Days from the first tree edit to the first source",
    "days_to_first_tree_edit": "Days from account creation to the first tree edit",
    "days_to_first_name": "Days from account creation to the first added name",
    "activation_speed": "1 / (1 + days to login + days from login to tree edit)",
    "activity_breadth": "Number of activity types used, login included",
    "funnel_stage": "Furthest stage reached, 0 to 4",
    "login_consistency": "Login days per week of tenure",
    "tenure_weight": "Natural log of 1 + tenure in days",
    "persistence_a": "Login days per week of tenure",
    "persistence_b": "Days between first and last core milestone over tenure",
    "persistence_c": "Mean of login consistency, recency and breadth",
    "milestone_sequence": "Codes of reached milestones in order of date",
}


def annotate(df: DataFrame) -> DataFrame:
    """Attach descriptions to the columns that have one."""
    for name in (c for c in df.columns if c in DESCRIPTIONS):
        df = df.withMetadata(name, {"description": DESCRIPTIONS[name]})
    return df


def describe_features(df: DataFrame) -> DataFrame:
    """Description and number of known values per feature, read from the metadata."""
    known = {f.name: f.metadata["description"] for f in annotate(df).schema
             if "description" in f.metadata}
    table = df.sparkSession.createDataFrame(
        list(known.items()), "feature string, description string")
    counts = df.agg(*[F.count(c).alias(c) for c in known])
    return table.join(counts.unpivot([], list(known), "feature", "n_present"), "feature")
