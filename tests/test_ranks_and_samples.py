"""Exact ranks, quantiles and keyed samples against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import labels, profile, ranks, sampling as M


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "ab"[int(i % 3 == 0)], float(v)) for i, v in
            enumerate(np.round(rng.exponential(3, 400), 1))]
    rows += [(1000 + i, "a", 0.0) for i in range(200)]  # one value holds a third
    frame = pd.DataFrame(rows, columns=["id", "g", "v"])
    return spark.createDataFrame(frame), frame


def test_quantiles_match_numpy(numbers):
    df, frame = numbers
    got = {r.g: r for r in ranks.quantiles(df, ["g"], "v", {"p10": 0.1, "med": 0.5, "p667": 0.667}).collect()}
    for g, part in frame.groupby("g"):
        want = np.quantile(part.v, [0.1, 0.5, 0.667])
        assert np.allclose([got[g].p10, got[g].med, got[g].p667], want)


def test_narrowed_quantiles_match_numpy(numbers, monkeypatch):
    """Several rounds of brackets, with groups of different sizes, ties and both ends."""
    df, frame = numbers
    monkeypatch.setattr(ranks, "RANKED", 3)
    probs = {"q0": 0.0, "q1": 0.013, "med": 0.5, "p667": 0.667, "p99": 0.99, "q4": 1.0}
    more = df.unionByName(df.sparkSession.createDataFrame([(-1, "c", 5.0), (-2, "c", 7.0), (-3, None, 1.0), (-4, "c", None)], df.schema))
    got = {r.g: r for r in ranks.quantiles(more, ["g"], "v", probs).collect()}
    parts = {g: part.v for g, part in frame.groupby("g")} | {"c": [5.0, 7.0], None: [1.0]}
    assert set(got) == set(parts)
    for g, values in parts.items():
        assert np.allclose([got[g][p] for p in probs], np.quantile(values, list(probs.values())))
    whole = ranks.quantiles(df, [], "v", probs).head()
    assert np.allclose([whole[p] for p in probs], np.quantile(frame.v, list(probs.values())))


def test_large_quantiles_move_few_values(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).cast("double").alias("v"))
    plan = ranks.quantiles(df, [], "v", {"med": 0.5, "p99": 0.99})
    assert tuple(plan.head()) == (29999.5, pytest.approx(59999 * 0.99))
    brackets = ranks._narrow(ranks._with_brackets(df.withColumnRenamed("v", "_v"), None, []), [], {"med": 0.5, "p99": 0.99}, True).head()
    held = [df.filter(F.col("v").between(b.lo, b.hi)).count() for b in brackets._b]
    assert max(held) < 60_000 * 5 / ranks.GRID and brackets._inside < ranks.RANKED


def test_heavy_ranks_are_looked_up(spark):
    """A value that holds nine tenths of a column is in no shuffled join."""
    rows = [(i, 0.0 if i % 10 else float(i * 37 % 5000)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ranks.percent_rank_average(df, "id", ["v"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.toPandas().set_index("id").v.sort_index()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert np.allclose(got, pd.DataFrame(rows, columns=["id", "v"]).set_index("id").v.rank(pct=True).sort_index())
    joins = plan.split("SortMergeJoin")[1:]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0]  # the rows of the one shuffled join passed the lookup before


def test_percent_rank_matches_pandas(numbers):
    df, frame = numbers
    got = ranks.percent_rank_average(df, "id", ["v"]).toPandas().set_index("id").v.sort_index()
    want = frame.set_index("id").v.rank(pct=True).sort_index()
    assert np.allclose(got, want)


def test_top_share_matches_sort(numbers):
    df, frame = numbers
    top = frame.v.sort_values(ascending=False)
    got = profile.top_share(df, "v", [0.1]).head()[0]
    assert abs(got - top.iloc[:int(np.ceil(len(top) * 0.1))].sum() / top.sum()) < 1e-5


def _md5(key, seed):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest()


def test_simple_sample_is_exact(numbers):
    df, frame = numbers
    got = {r.id for r in M.simple_sample(df, 37, "id", 5).collect()}
    assert got == set(sorted(frame.id, key=lambda i: _md5(i, 5))[:37])
    assert M.simple_sample(df, 10_000, "id").count() == len(frame)


def test_cut_inside_a_shared_prefix(spark):
    """Digests that share the prefix are ranked one by one."""
    df = spark.createDataFrame([(i, f"aaaa{i:02d}", 3) for i in range(10)], "id int, d string, n int")
    out = ranks.smallest_hashes(df.withColumn("g", F.lit("x")), ["g"], "n", "d", "id")
    assert sorted(r.id for r in out.collect()) == [0, 1, 2]


def test_quota_that_ends_with_a_prefix(spark):
    """Whole prefixes fill the quota, or nothing does, or everything does."""
    rows = [(i, f"{'aaaa' if i < 4 else 'bbbb'}{i:02d}", g, q) for g, q in (("x", 4), ("y", 0), ("z", 99)) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, d string, g string, n int")
    marked = ranks.mark_smallest(df, ["g"], "n", "d", "id", "hit").groupBy("g").agg(F.count_if("hit").alias("n")).collect()
    assert {r.g: r.n for r in marked} == {"x": 4, "y": 0, "z": 8}


def test_splits_do_not_shuffle_wide_rows(spark):
    df = spark.range(3000).selectExpr("id USER_ID", "id % 3 t", "repeat('w', 50) wide", "rand(3) r")
    plan = M.split_train_test(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and plan.count("wide") >= 1


def test_strata_floor_and_pooling(spark):
    rows = [(i, "big", "r") for i in range(100)] + [(200 + i, "edge", "r") for i in range(15)]
    rows += [(300 + i, "tiny", "r") for i in range(14)] + [(400, None, None)]
    df = spark.createDataFrame(rows, "USER_ID long, country_cluster string, USER_WORLD_REGION string")
    strata = M.with_strata(df)
    sizes = {r.stratum: r["count"] for r in strata.groupBy("stratum").count().collect()}
    assert sizes == {"big|r": 100, "edge|r": 15, "Other|Pooled": 15}
    plan = {r.stratum: r.draw_size for r in M.proportional_allocation(strata, 50).collect()}
    assert plan == {"big|r": 38, "edge|r": 15, "Other|Pooled": 15}


def test_draws_are_trimmed_and_weighted(spark):
    df = spark.createDataFrame([(i, f"s{i % 20}") for i in range(600)], "USER_ID long, stratum string")
    allocation = M.proportional_allocation(df, 100)  # 20 strata x 15 = 300 rows
    draws = M.stratified_draws(df, allocation, draws=3, rows=100)
    sizes = [r["count"] for r in draws.groupBy("subsample_id").count().collect()]
    assert sizes == [100, 100, 100]
    assert {r.sampling_weight for r in draws.collect()} == {2.0}
    assert draws.groupBy("subsample_id", "USER_ID").count().filter("count > 1").count() == 0


def test_split_sizes_with_null_stratum(spark):
    df = spark.createDataFrame([(i, [0, 1, None][i % 3]) for i in range(33)], "USER_ID long, t int")
    out = M.split_train_test(df, ["t"])
    got = {r.t: r.n for r in out.groupBy("t").agg(F.count_if(F.col("split") == "train").alias("n")).collect()}
    assert got == {0: 7, 1: 7, None: 7} and out.count() == 33


def test_sample_does_not_depend_on_partitioning(numbers):
    df, _ = numbers
    a = {r.id for r in M.simple_sample(df.repartition(1), 50, "id").collect()}
    b = {r.id for r in M.simple_sample(df.repartition(7, "v"), 50, "id").collect()}
    assert a == b


def test_bootstrap_weights_average_one(spark):
    df = spark.range(20_000).withColumnRenamed("id", "USER_ID")
    mean, var = df.select(M.bootstrap_weight(1).alias("w")).agg(F.avg("w"), F.var_pop("w")).head()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.06


def test_labels_from_cuts(spark):
    df = spark.createDataFrame([(i, float(i), False) for i in range(9)] + [(99, 50.0, True)],
                               "USER_ID int, persistence_c double, is_mnar boolean")
    rows = {r.USER_ID: (r.persist_median, r.persist_tertile)
            for r in labels.add_persistence_labels(df).collect()}
    assert rows[99] == (None, None) and rows[4] == (1, 1) and rows[3] == (0, 1) and rows[8] == (1, 2)
