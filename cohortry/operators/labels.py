"""Persistence labels from exact quantiles of the tracked population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortry import config as C
from cohortry.operators.ranks import join_groups, quantiles
from cohortry.session import materialize


def persistence_cuts(users: DataFrame, column: str = "persistence_c") -> DataFrame:
    """One row: median and both tertile cuts over tracked users."""
    low, high = C.TERTILE_CUTS
    return quantiles(users.filter(~F.col("is_mnar")), [], column,
                     {"median": 0.5, "p33": low, "p67": high})


def add_persistence_labels(users: DataFrame, column: str = "persistence_c",
                           population: DataFrame | None = None) -> DataFrame:
    """Median split and tertile label; null for untracked users."""
    source = users if population is None else population
    cuts = persistence_cuts(source, column).select(
        F.struct("median", "p33", "p67").alias("cuts"))
    tracked, score = ~F.col("is_mnar"), F.col(column)

    def cut(name: str) -> Column:
        return F.col(f"_cuts.{name}")

    return (
        users.withColumn("_cuts", cuts.scalar())
        .withColumns({
            "persist_median": F.when(tracked, (score >= cut("median")).cast("int")),
            "persist_tertile": F.when(
                tracked, F.when(score >= cut("p67"), 2).when(score >= cut("p33"), 1)
                .otherwise(0)),
        })
        .drop("_cuts")
    )


def group_median_label(df: DataFrame, keys: list[str], column: str = "persistence_c",
                       name: str = "y") -> DataFrame:
    """1 at or above the group's own median (of all rows without keys)."""
    medians = materialize(quantiles(df, keys, column, {"_median": 0.5}))
    joined = join_groups(df, medians, keys) if keys else df.withColumn("_median", medians.scalar())
    return joined.withColumn(
        name, (F.col(column) >= F.col("_median")).cast("int")
    ).drop("_median")
