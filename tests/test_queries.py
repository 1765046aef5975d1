"""Contract of the entry module, layer invariants, plans, and SQL on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from cohortry.operators import enrich, features
from cohortry.plans import inputs as I
from cohortry.sources import sinks, standins as S, users as U
from tools_check import TABLES, rows_of

CHECKED = [
    "flagship_segment_persistence", "s1_users_raw", "p2_sentinel_counts", "p30_days_to_milestones",
    "p32_clustering_features", "a17_data_health", "a25_top_share", "a28_count_profiles",
    "w3_percentile_ranks", "j5_enrichment", "j9_country_crosswalk", "e2_composite_allocation",
    "e5_plain_split", "m7_partial_correlations", "m41_kruskal_wallis", "m46_kaplan_meier",
]


# DuckDB 2.0 fails inside on some of these statements at sf0.001, so SQL runs one size up
SQL_SF = "/root/testdata/sf0.01"


@pytest.fixture()
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SQL_SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry_points.queries()[name](spark, SQL_SF)
    result = con.execute(entry_points.oracle_sql()[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry_and_names(spark):
    assert entry_points.entry(spark).count() >= 1
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_all_sql_binds(con):
    for name, text in entry_points.oracle_sql().items():
        con.execute("EXPLAIN " + text)


def test_raw_shape_and_rows(spark, sf):
    raw = I.users_raw(spark, sf)
    U.check_shape(raw)
    assert raw.count() == raw.select("USER_ID").distinct().count() == S.table(spark, sf, "customer").count()
    parts = F.col("DECEASED_NAMES_ADDED") + F.col("LIVING_NAMES_ADDED")
    assert raw.filter(parts != F.col("TOTAL_NAMES_ADDED")).count() == 0


def test_layers_keep_rows_and_bounds(spark, sf):
    users = I.users_enriched(spark, sf)
    assert users.count() == I.users_raw(spark, sf).count()
    bad = users.filter((F.col("user_age") < 8) | (F.col("user_age") > 110) | (F.col("tenure_days") < 0))
    assert bad.count() == 0


def test_sequence_needs_no_shuffle(spark, sf):
    plan = _plan(I.users_raw(spark, sf).transform(
        lambda raw: I.users_clean(spark, sf).select("USER_ID", features.milestone_sequence())))
    assert "SortMergeJoin" not in plan and "hashpartitioning(USER_ID" not in plan


def test_enrichment_is_broadcast(spark, sf):
    users = I.users_labelled(spark, sf).select("USER_ID", "iso3_code")
    plan = _plan(enrich.enrich_users(users, I.enrichment(spark, sf), ["hdi"]))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    # only the wanted column of the dimension is read
    assert "ReadSchema: struct<iso3_code:string,hdi:double>" in plan


def test_tier_filter_reaches_the_scan(spark, sf):
    plan = _plan(I.tier_d(I.users_labelled(spark, sf)).select("USER_ID"))
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan


def _plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_repeated_code_fails(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2)], "iso3_code string, x int")
    with pytest.raises(Exception, match="not unique"):
        enrich.assert_unique(df).collect()


def test_csv_scan_nulls_bad_dates(spark, sf, tmp_path):
    raw = I.users_raw(spark, sf)
    text = raw.withColumn("EARLIEST_LOGIN_DATE", F.when(F.col("USER_ID") == 1, "soon")
                          .otherwise(F.col("EARLIEST_LOGIN_DATE").cast("string")))
    text.write.csv(str(tmp_path / "raw"), header=True)
    back = U.read_users_csv(spark, str(tmp_path / "raw"))
    assert back.schema["EARLIEST_LOGIN_DATE"].dataType.simpleString() == "date"
    assert back.filter("USER_ID = 1").head().EARLIEST_LOGIN_DATE is None
    assert back.count() == raw.count() and back.agg(F.sum("TREE_EDITS")).head() == raw.agg(F.sum("TREE_EDITS")).head()
    assert U.read_users_csv(spark, str(tmp_path / "raw"), rows=7).count() == 7


def test_run_registry_replaces_one_phase(spark, tmp_path):
    def runs(phase, n):
        return spark.createDataFrame([(i, phase) for i in range(n)], "experiment_id int, phase string")

    path = str(tmp_path / "registry")
    sinks.register_runs(runs("draw", 3), path)
    sinks.register_runs(runs("model", 2), path)
    out = sinks.register_runs(runs("draw", 1), path)
    assert {r.phase: r["count"] for r in out.groupBy("phase").count().collect()} == {"draw": 1, "model": 2}


def test_qc_log_appends(spark, tmp_path):
    path = str(tmp_path / "qc")
    for step in ("1", "2"):
        sinks.append_qc(sinks.qc_rows(step, spark.range(3).agg(F.count("*").alias("n"))), path)
    assert {r.step: r.value for r in spark.read.parquet(path).collect()} == {"1": "3", "2": "3"}


def test_feature_expression_outside_the_allowed_columns(spark):
    from cohortry.operators.profile import derived_features

    df = spark.createDataFrame([(1.0, 2.0)], "a double, secret double")
    good = spark.createDataFrame([("twice", "a * 2")], "feature string, sql_expression string")
    assert derived_features(df, good, ["a"]).head().twice == 2.0
    bad = spark.createDataFrame([("leak", "secret + a")], "feature string, sql_expression string")
    with pytest.raises(Exception):
        derived_features(df, bad, ["a"])


def test_csv_scan_parts_spoiled_lines(spark, tmp_path):
    """Bad numbers and wrong field counts spoil their line only; bad dates are null."""
    from cohortry.sources import users as U

    names = U.user_schema().names
    line = lambda **given: ",".join(given.get(n, "") for n in names)
    lines = [",".join(names), line(USER_ID="1", ACCOUNT_CREATE_DATE="2001-02-03", CITY="A"),
             line(USER_ID="x2"), line(USER_ID="3", ACCOUNT_CREATE_DATE="soon"), "4,2001-01-01", line(USER_ID="5") + ",more",
             line(USER_ID="6", USER_CURRENT_AGE="old"), '7,"a,b"' + "," * (len(names) - 2)]
    (tmp_path / "users.csv").write_text("\n".join(lines) + "\n")
    good, bad = U.scan_users_csv(spark, str(tmp_path / "users.csv"))
    rows = {r.USER_ID: r for r in good.collect()}
    assert set(rows) == {1, 3, 7} and str(rows[1].ACCOUNT_CREATE_DATE) == "2001-02-03" and rows[1].CITY == "A"
    assert rows[3].ACCOUNT_CREATE_DATE is None and rows[7].ACCOUNT_CREATE_DATE is None
    assert sorted(r.line.split(",")[0] for r in bad.collect()) == ["4", "5", "6", "x2"]


def test_index_csv_falls_back_to_another_encoding(spark, tmp_path):
    from cohortry.operators.enrich import read_index_csv

    (tmp_path / "latin.csv").write_bytes("iso3,country,hdi_2001\nN01,Côte,0.5\n".encode("ISO-8859-1"))
    (tmp_path / "utf8.csv").write_bytes("iso3,country,hdi_2001\nN01,Côte,0.5\n".encode())
    for name in ("latin.csv", "utf8.csv"):
        assert read_index_csv(spark, str(tmp_path / name)).head().country == "Côte"
