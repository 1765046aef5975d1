"""Scans of the raw user table and of written subsamples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from cohortry.config import ACTIVITY_COLUMNS, DATE_COLUMNS, GEO_COLUMNS, NAME_COLUMNS
from cohortry.session import materialize

EXPECTED_COLUMNS = 33


def user_schema(date_type: T.DataType | None = None) -> T.StructType:
    """Explicit schema of the raw table, so that no scan infers types."""
    dates = list(DATE_COLUMNS)
    stamp = date_type or T.DateType()
    fields = [
        ("USER_ID", T.LongType()),
        (dates[0], stamp),
        ("ACCOUNT_TYPE", T.StringType()),
        ("USER_CURRENT_AGE", T.LongType()),
        *[(c, T.StringType()) for c in GEO_COLUMNS],
        *[(c, stamp) for c in dates[1:]],
        *[(c, T.DoubleType()) for c in ACTIVITY_COLUMNS + NAME_COLUMNS],
    ]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def read_users_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Raw CSV with a header; dates that do not parse become null.

    Dates are read as text because a typed column would fail or null whole rows.
    """
    raw = spark.read.schema(user_schema(T.StringType())).csv(path, header=True)
    typed = raw.select(
        *[parse_date(c).alias(c) if c in DATE_COLUMNS else F.col(c) for c in raw.columns]
    )
    return typed if rows is None else typed.limit(rows)


def scan_users_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a raw CSV that fit the schema, and the lines that do not, as ``line``.

    A number that cannot be read, or a line with too few or too many fields, spoils its
    line and no other; a date that cannot be read is null. The file is parsed once and the
    rows are written, so that both results read the same ones.
    """
    schema = user_schema(T.StringType()).add("line", T.StringType())
    raw = materialize(spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").csv(
        path, header=True))
    good = raw.filter(F.col("line").isNull()).select(
        *[parse_date(c).alias(c) if c in DATE_COLUMNS else F.col(c) for c in raw.columns if c != "line"])
    return good, raw.filter(F.col("line").isNotNull()).select("line")


def parse_date(column: str) -> F.Column:
    """Date of a text column, null where it cannot be read."""
    return F.to_date(F.try_to_timestamp(F.col(column)))


def read_users_parquet(spark: SparkSession, path: str,
                       columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(user_schema()).parquet(path)
    return df.select(*columns) if columns else df


def check_shape(df: DataFrame, columns: int = EXPECTED_COLUMNS) -> None:
    """Column count is part of the contract; the row count is only logged."""
    if len(df.columns) != columns:
        raise ValueError(f"expected {columns} columns, found {len(df.columns)}")


def read_subsamples(spark: SparkSession, path: str,
                    subsample_ids: list[int] | None = None) -> DataFrame:
    """Subsamples written by ``write_subsamples``; the id filter prunes partitions."""
    df = spark.read.parquet(path)
    return df if subsample_ids is None else df.filter(
        F.col("subsample_id").isin(subsample_ids)
    )


def describe_table(df: DataFrame) -> DataFrame:
    """Column name, type and position, like DESCRIBE, with the non-null count."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    columns = df.sparkSession.createDataFrame(
        rows, "position int, column_name string, column_type string"
    )
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return columns.join(
        counts.unpivot([], df.columns, "column_name", "n_present"), "column_name"
    )
