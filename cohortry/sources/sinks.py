"""Writers: layer tables, subsamples, QC log, run registry and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Replace a table and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_subsamples(draws: DataFrame, path: str) -> DataFrame:
    """One partition folder per subsample; one file each since a subsample is small."""
    draws.repartition("subsample_id").write.mode("overwrite").partitionBy(
        "subsample_id").parquet(path)
    return draws.sparkSession.read.parquet(path)


def verify_subsamples(draws: DataFrame, written: DataFrame) -> DataFrame:
    """Rows drawn and rows read back per subsample, and whether the columns agree."""
    same_columns = sorted(draws.columns) == sorted(written.columns)
    return (
        draws.groupBy("subsample_id").agg(F.count("*").alias("n_drawn"))
        .join(written.groupBy("subsample_id").agg(F.count("*").alias("n_read")),
              "subsample_id", "full")
        .withColumn("columns_match", F.lit(same_columns))
    )


def qc_rows(step: str, metrics: DataFrame, note: str = "") -> DataFrame:
    """One-row aggregates as (step, metric, value, note) rows."""
    names = metrics.columns
    text = metrics.select(*[F.col(c).cast("string").alias(c) for c in names])
    return text.unpivot([], names, "metric", "value").select(
        F.lit(step).alias("step"), "metric", "value", F.lit(note).alias("note"))


def append_qc(rows: DataFrame, path: str) -> None:
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def register_runs(runs: DataFrame, path: str) -> DataFrame:
    """Replace the rows of the phases in ``runs``, leave other phases alone."""
    (runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("phase").parquet(path))
    return runs.sparkSession.read.parquet(path)


def run_rows(metadata: DataFrame, phase: str, parameters: dict[str, str],
             base_seed: int) -> DataFrame:
    """Registry rows of a sampling phase: ids, seed, sizes and parameters as JSON."""
    settings = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()],
                                  "persist_rate", "mean_tenure", "n_strata"))
    return metadata.select(
        F.col("subsample_id").alias("experiment_id"), F.lit(phase).alias("phase"),
        "subsample_id", (F.col("subsample_id") + base_seed).alias("seed"),
        "n_rows", "n_train", "n_test", settings.alias("parameters"))


def write_csv(df: DataFrame, path: str) -> DataFrame:
    """Result table as CSV with a header, read back with its own schema."""
    df.write.mode("overwrite").csv(path, header=True)
    return df.sparkSession.read.schema(df.schema).csv(path, header=True)
