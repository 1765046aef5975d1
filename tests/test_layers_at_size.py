"""What the shared layers and draws write and shuffle, whatever the number of users."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from cohortry import config as C
from cohortry.operators import ranks
from cohortry.plans import experiments, inputs as I, samples


def _plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_wide_users_are_written_once_for_their_labels(spark, sf, monkeypatch):
    I.crosswalk(spark, sf), I.users_raw(spark, sf)
    known = dict(I._LAYERS)
    monkeypatch.setattr(I, "_LAYERS", {k: v for k, v in known.items() if k[2] in ("crosswalk", "users_raw")})
    written, write = [], I.materialize
    monkeypatch.setattr(I, "materialize", lambda df: written.append(df.columns) or write(df))
    found = I.users_labelled(spark, sf)
    assert sum(len(columns) > 10 for columns in written) == 1  # before, features were written and then read and written again
    scored = I.users_features(spark, sf).filter("not is_mnar").select("persistence_c").toPandas().persistence_c.dropna()
    cuts = [scored.quantile(p) for p in (0.5, *C.TERTILE_CUTS)]
    for r in found.select("is_mnar", "persistence_c", "persist_median", "persist_tertile").collect():
        if r.is_mnar:
            assert r.persist_median is None and r.persist_tertile is None
        elif r.persistence_c is not None:
            assert r.persist_median == int(r.persistence_c >= cuts[0])
            assert r.persist_tertile == sum(r.persistence_c >= c for c in cuts[1:])


def test_drawn_users_are_met_without_a_shuffle(spark, sf):
    I.users_labelled(spark, sf)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # less than the few users here take on file
    try:
        plan = _plan(samples._drawn(spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_histogram_of_many_groups_folds_its_rows(spark, monkeypatch):
    """Groups of some thousand rows take far fewer histogram lines than rows, and the same rows come out."""
    rows = spark.range(40_000).select("id", (F.col("id") % 5).alias("g"), F.lit(700).alias("n")).withColumn("d", ranks.hash_key("id", 3))
    wanted = set()
    for g in range(5):
        digests = sorted((hashlib.md5(f"{i}|3".encode()).hexdigest(), i) for i in range(g, 40_000, 5))
        wanted |= {i for _, i in digests[:700]}
    seen, write = [], ranks.materialize

    def counted(df):
        if "_cut" in df.columns:
            seen.append(", 1, 2)" in df._jdf.queryExecution().optimizedPlan().toString())  # two digits: 256 lines a group
        return write(df)

    monkeypatch.setattr(ranks, "materialize", counted)
    assert {r.id for r in ranks.smallest_hashes(rows, ["g"], "n", "d", "id").collect()} == wanted
    assert seen == [True]


def test_profiles_write_only_the_columns_they_use(spark, sf, monkeypatch):
    features = [f for f in C.PROFILE_FEATURES if f != "persistence_c"]
    users = spark.range(8).select(
        F.col("id").alias("USER_ID"), (F.col("id") % 2).cast("int").alias("persist_median"), F.col("id").cast("double").alias("persistence_c"),
        F.lit("Member").alias("ACCOUNT_TYPE"), *[F.col("id").cast("double").alias(f) for f in features],
        *[F.lit(i).alias(f"unused_{i}") for i in range(5)])
    placed = spark.range(8).select(F.col("id").alias("key"), (F.col("id") > 2).cast("int").alias("A_k5"), F.lit(0).alias("T_k5"))
    written, write = [], experiments.materialize
    monkeypatch.setattr(experiments, "contributors", lambda spark, sf: users)
    monkeypatch.setattr(experiments, "solution_results", lambda spark, sf: (None, placed, ["A_k5", "T_k5"]))
    monkeypatch.setattr(experiments, "materialize", lambda df: written.append(df.columns) or write(df))
    rows = {(r.solution, r.cluster): r for r in experiments.solution_profiles(spark, sf).collect()}
    assert {k: (r.n, r.mean_persistence_c) for k, r in rows.items()} == {("A_k5", 0): (3, 1.0), ("A_k5", 1): (5, 5.0), ("T_k5", 0): (8, 3.5)}
    assert len(written) == 1 and not any(c.startswith("unused") for c in written[0])  # before, whole users were written
