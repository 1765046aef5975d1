"""Raw inputs derived from the star-schema tables.

The engine expects a private wide user table and country files. These functions derive
inputs of the same shape from ``customer``, ``orders``, ``lineitem`` and the small
dimensions, so that every query works on data that grows with the tables.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PERIOD_START = date(2000, 8, 1)
PERIOD_END = date(2001, 8, 1)
HOME_COUNTRY = "NATION_0"
HOME_CORE_AREA = "Core Area"
LATEST_YEAR = 2001
FIRST_YEAR = 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(condition: Column) -> Column:
    return F.count_if(condition)


#: Rules that a line can meet; a line's rules are the bits of one number.
_RULES = ["source", "memory", "involved", "record", "tree", "name", "deceased", "living", "novel", "qualified"]


def _lines_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order key, quantity and rules of each line; few bytes, as every line is shuffled."""
    flag_a, flag_r = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
    qty = F.col("l_quantity")
    met = {
        "source": F.col("l_discount") > 0.085, "memory": F.col("l_tax") > 0.075,
        "involved": qty < 1.5, "record": qty > 48.5, "tree": flag_r, "name": flag_a,
        "deceased": flag_a & (F.col("l_linestatus") == "F"),
        "living": flag_a & (F.col("l_linestatus") == "O"),
        "novel": flag_a & (F.col("l_discount") < 0.045),
        "qualified": flag_a & (F.col("l_tax") < 0.015),
    }
    bits = [F.when(met[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(_RULES)]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", qty.alias("qty"), reduce(lambda a, b: a.bitwiseOR(b), bits).alias("rules"))


_COUNTS = ["source", "memory", "involved", "record", "tree", "name"]
_SUMS = ["tree", "name", "deceased", "living", "novel", "qualified"]


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of each customer, through one row per customer and day.

    Lines meet the orders of the period before anything is summed, so most lines drop out
    after one narrow shuffle. The daily step turns distinct-day counts into plain counts,
    and a hot customer shuffles at most one row per day and task.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderdate").between(F.lit(PERIOD_START), F.lit(PERIOD_END)))
        .select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("od"),
                (F.col("o_orderpriority") != "5-LOW").alias("login"))
    )
    hit = {r: F.col("rules").bitwiseAND(1 << i) > 0 for i, r in enumerate(_RULES)}
    daily = (
        orders.hint("shuffle_hash").join(_lines_by_rule(spark, sf_dir),
                                         F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey", "od")
        .agg(F.max("login").alias("login"),
             *[_count(hit[c]).alias(f"cnt_{c}") for c in _COUNTS],
             *[F.sum(F.when(hit[c], F.col("qty"))).alias(f"q_{c}") for c in _SUMS])
    )
    on_day = {c: F.col(f"cnt_{c}") > 0 for c in _COUNTS} | {"login": F.col("login")}
    return daily.groupBy("o_custkey").agg(
        *[F.min(F.when(hit, F.col("od"))).alias(f"first_{c}") for c, hit in on_day.items()],
        *[F.count_if(hit).cast("double").alias(f"days_{c}") for c, hit in on_day.items()],
        *[F.sum(f"cnt_{c}").cast("double").alias(f"cnt_{c}") for c in _COUNTS],
        *[F.sum(f"q_{c}").alias(f"q_{c}") for c in _SUMS],
    )


def country_label(nation: str = "n_name", key: str = "n_nationkey") -> Column:
    """Nation name, with two spellings that only match after cleaning."""
    return (
        F.when(F.col(key) == 10, F.concat(F.lit("The "), nation))
        .when(F.col(key) == 11, F.concat(nation, F.lit(" Islands")))
        .otherwise(F.col(nation))
    )


def _sentinel(prefix: str, modulus: int, values: int) -> Column:
    pick = F.col("c_custkey") % modulus
    return (
        F.when(pick == 0, "Unknown").when(pick == 1, "Redacted").when(pick == 2, " - ")
        .when(pick == 3, "")
        .otherwise(F.concat(F.lit(prefix), (F.col("c_custkey") % values).cast("string")))
    )


def users_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 33-column raw user table, one row per customer."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    joined = (
        table(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(user_activity(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left")
    )
    named = F.col("days_name") > 0

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    def if_named(c: str) -> Column:
        return F.when(named, zero(c))

    offset = (F.col("c_custkey") * 37 % 366).cast("int")
    return joined.select(
        F.col("c_custkey").alias("USER_ID"),
        F.date_add(F.lit(PERIOD_START), offset).alias("ACCOUNT_CREATE_DATE"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Member").otherwise("Public")
        .alias("ACCOUNT_TYPE"),
        F.floor(F.col("c_acctbal") / 80).alias("USER_CURRENT_AGE"),
        country_label().alias("COUNTRY"),
        _sentinel("P", 10, 7).alias("PROVINCE"),
        _sentinel("C", 11, 13).alias("CITY"),
        F.col("r_name").alias("USER_WORLD_REGION"),
        F.when((F.col("n_nationkey") == 0) & (F.col("c_custkey") % 5 == 0), HOME_CORE_AREA)
        .otherwise(F.concat("r_name", F.lit(" Area"))).alias("USER_AREA_NAME"),
        F.col("first_login").alias("EARLIEST_LOGIN_DATE"),
        F.col("first_name").alias("EARLIEST_NAME_CONTRIBUTOR_DATE"),
        F.col("first_source").alias("EARLIEST_SOURCE_CONTRIBUTOR_DATE"),
        F.col("first_memory").alias("EARLIEST_MEMORY_CONTRIBUTOR_DATE"),
        F.col("first_involved").alias("EARLIEST_GET_INVOLVED_USAGE_DATE"),
        F.col("first_record").alias("EARLIEST_RECORD_EDIT_DATE"),
        F.col("first_tree").alias("EARLIEST_TREE_EDIT_DATE"),
        F.col("days_login").alias("DAYS_LOGGING_IN"),
        F.col("cnt_source").alias("SOURCES_ADDED"),
        F.col("days_source").alias("DAYS_ADDING_SOURCES"),
        F.col("cnt_memory").alias("MEMORIES_ADDED"),
        F.col("days_memory").alias("DAYS_ADDING_MEMORIES"),
        F.col("cnt_involved").alias("GET_INVOLVED_ITEMS_REVIEWED"),
        F.col("days_involved").alias("DAYS_REVIEWING_GET_INVOLVED_ITEMS"),
        F.col("cnt_record").alias("RECORD_EDITS"),
        F.col("days_record").alias("DAYS_EDITING_RECORDS"),
        F.when(F.col("o_custkey").isNotNull(), zero("q_tree")).alias("TREE_EDITS"),
        F.col("days_tree").alias("DAYS_EDITING_TREES"),
        if_named("days_name").alias("DAYS_ADDING_NAMES"),
        if_named("q_name").alias("TOTAL_NAMES_ADDED"),
        if_named("q_deceased").alias("DECEASED_NAMES_ADDED"),
        if_named("q_living").alias("LIVING_NAMES_ADDED"),
        if_named("q_novel").alias("NOVEL_NAMES_ADDED"),
        if_named("q_qualified").alias("QUALIFIED_NAMES_ADDED"),
    )


# --- country-level inputs -----------------------------------------------------------


def iso_code(key: str = "n_nationkey") -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col(key).cast("string"), 2, "0"))


def iso_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard names; two nations are missing so that they stay unmatched."""
    return (
        table(spark, sf_dir, "nation").filter(~F.col("n_nationkey").isin(22, 23))
        .select(F.col("n_name").alias("name"), iso_code().alias("alpha3"))
    )


def manual_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual overrides: two names share one code, two map to null."""
    key = F.col("n_nationkey")
    return (
        table(spark, sf_dir, "nation").filter(key.between(1, 5))
        .select(country_label().alias("country_name"),
                F.when(key == 1, "N01").when(key.isin(2, 3), "N02").alias("iso3_code"))
    )


def country_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country name to cluster, the derived form of the literal country lists."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").filter(key.between(1, 23)).select(
        country_label().alias("country_name"),
        F.when(key <= 8, "High-LDS-International").when(key <= 16, "Mod-Eng-Low-LDS")
        .when(key <= 20, "Low-Eng-High-Dev").otherwise("Low-Eng-Developing")
        .alias("cluster"),
    )


def nation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics per nation and year, the seed of all country files."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("lines"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc_cents"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax_cents"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("price_cents"),
        F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mon"),
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey",
        F.round(F.col("c_acctbal") * 100).cast("long").alias("bal_cents"),
    )
    status = F.col("o_orderstatus")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "yr", "mon")
        .agg(
            F.count("*").alias("n_orders"),
            F.sum("price_cents").alias("price_cents"),
            F.max("price_cents").alias("max_price_cents"),
            F.sum("bal_cents").alias("bal_cents"),
            F.min("bal_cents").alias("min_bal_cents"),
            _count(status == "F").alias("n_f"),
            _count(status == "O").alias("n_o"),
            _count(status == "P").alias("n_p"),
            F.sum("lines").alias("lines"),
            F.sum("disc_cents").alias("disc_cents"),
            F.sum("tax_cents").alias("tax_cents"),
            F.sum("qty").alias("qty"),
        )
    )


_YEAR_SUMS = ["n_orders", "price_cents", "bal_cents", "n_f", "n_o", "n_p", "lines",
              "disc_cents", "tax_cents", "qty"]


def _by_year(monthly: DataFrame, *keys: str) -> DataFrame:
    return monthly.groupBy(*keys, "yr").agg(
        *[F.sum(c).alias(c) for c in _YEAR_SUMS],
        F.max("max_price_cents").alias("max_price_cents"),
        F.min("min_bal_cents").alias("min_bal_cents"),
    )


def _nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", country_label().alias("country"), "r_name")


def indicator_records(spark: SparkSession, sf_dir: str, monthly: DataFrame) -> DataFrame:
    """Long records: economy, time, indicator, value, aggregate."""
    monthly = monthly.join(
        _nation_names(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    )
    per_nation = _by_year(monthly, "n_nationkey").select(
        iso_code().alias("economy"), F.lit(False).alias("aggregate"), "*"
    ).withColumn("gap", (F.col("n_nationkey") + F.col("yr")) % 4 == 0).drop("n_nationkey")
    per_region = _by_year(monthly, "r_name").select(
        F.col("r_name").alias("economy"), F.lit(True).alias("aggregate"), "*"
    ).withColumn("gap", F.lit(False)).drop("r_name")
    values = {
        "gdp_per_capita_ppp": F.col("price_cents") / F.col("n_orders") / 100,
        "internet_pct": F.col("bal_cents") / F.col("n_orders") / 10000,
        "mobile_per_100": F.col("max_price_cents") / 100000,
        "tertiary_enrollment": F.col("min_bal_cents") / 100,
        "population": F.col("n_orders").cast("double") * 1000,
    }
    return (
        per_nation.unionByName(per_region)
        .select("economy", F.col("yr").alias("time"), "aggregate", "gap",
                *[v.alias(k) for k, v in values.items()])
        .unpivot(["economy", "time", "aggregate", "gap"], list(values), "indicator",
                 "value")
        .select("economy", "time", "indicator",
                F.when(~F.col("gap"), F.col("value")).alias("value"), "aggregate")
    )


def _text(value: Column, digits: int) -> Column:
    return F.round(value, digits).cast(f"decimal(18,{digits})").cast("string")


def index_wide(spark: SparkSession, sf_dir: str, monthly: DataFrame) -> DataFrame:
    """Wide index file, all values as text: iso3, country, hdi_YYYY, eys_2001, le_2001."""
    years = list(range(FIRST_YEAR, LATEST_YEAR + 1))
    yearly = _by_year(monthly, "c_nationkey").join(
        _nation_names(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    )
    hdi = _text(F.col("disc_cents") / F.col("lines") / 10, 4)
    latest = F.col("yr") == LATEST_YEAR
    dots = latest & F.col("n_nationkey").isin(6, 7, 8)
    wide = yearly.groupBy("n_nationkey", "country").agg(
        *[F.max(F.when(F.col("yr") == y, F.when(dots, "..").otherwise(hdi)))
          .alias(f"hdi_{y}") for y in years],
        F.max(F.when(latest, _text(F.col("tax_cents") / F.col("lines"), 4)))
        .alias(f"eys_{LATEST_YEAR}"),
        F.max(F.when(latest, _text(F.col("qty") / F.col("lines"), 4)))
        .alias(f"le_{LATEST_YEAR}"),
    )
    return wide.withColumn("iso3", iso_code()).drop("n_nationkey")


def snapshots(spark: SparkSession, sf_dir: str, monthly: DataFrame) -> DataFrame:
    """Monthly snapshots with comma-formatted text numbers, a bad date and duplicates."""
    from pyspark.sql import Window as W

    key, mon = F.col("c_nationkey"), F.col("mon")
    running = F.sum("n_orders").over(
        W.partitionBy("c_nationkey").orderBy("mon")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    month = F.when(key.isin(2, 3) & (mon == 7), 6).otherwise(mon)
    stamp = F.concat(F.lit(f"{LATEST_YEAR}-"), F.lpad(month.cast("string"), 2, "0"),
                     F.lit("-01"))

    def commas(value: Column) -> Column:
        return F.format_number(value, 0)

    return (
        monthly.filter(F.col("yr") == LATEST_YEAR)
        .withColumn("running", running)
        .join(_nation_names(spark, sf_dir), key == F.col("n_nationkey"))
        .select(
            "country",
            F.when((key == 12) & (mon == 3), "unknown").otherwise(stamp).alias("date"),
            F.when((key == 9) & (mon == 7), "n/a")
            .otherwise(commas(F.col("running") * 1237)).alias("membership"),
            commas(F.col("running") * 7).alias("congregations"),
            commas(F.col("running") % 5).alias("temples"),
            commas(F.col("running") % 11).alias("stakes"),
            commas(F.col("running") * 100003).alias("population"),
        )
    )


def composition(spark: SparkSession, sf_dir: str,
                monthly: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Composition shares and diversity scores, nation rows (Level 1) and region rows."""
    monthly = monthly.join(
        _nation_names(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    )
    both = (
        _by_year(monthly, "country").withColumn("Level", F.lit(1))
        .withColumnRenamed("country", "Country")
        .unionByName(_by_year(monthly, "r_name").withColumn("Level", F.lit(2))
                     .withColumnRenamed("r_name", "Country"))
    )
    share = {c: F.col(f"n_{c}") / F.col("n_orders") for c in ("f", "o", "p")}
    keys = ["Country", "Level", F.col("yr").alias("Year")]
    squares = sum((s * s for s in share.values()), F.lit(0.0))
    return (
        both.select(*keys, (share["f"] * 100).alias("Christians"),
                    (share["o"] * 100).alias("Muslims"),
                    (share["p"] * 100).alias("Religiously_unaffiliated")),
        both.select(*keys, ((1 - squares) * 10).alias("RDI_score")),
    )


def restrictions(spark: SparkSession, sf_dir: str, monthly: DataFrame) -> DataFrame:
    yearly = _by_year(monthly, "c_nationkey").join(
        _nation_names(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return yearly.select(
        F.col("country").alias("Ctry_EditorialName"), F.col("yr").alias("Question_Year"),
        (F.col("tax_cents") / F.col("lines")).alias("GRI"),
        (F.col("disc_cents") / F.col("lines")).alias("SHI"),
    )


def attitudes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Survey answers with a numeric country code, and the labels of that code."""
    answers = (
        table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"),
              F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_size"),
              F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("s_nationkey").alias("country"),
                (F.col("p_size") % 10).alias("religion_import"),
                F.col("l_linenumber").alias("pray_freq"),
                (F.col("p_size") % 3).alias("believe_god"))
    )
    labels = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("code"), country_label().alias("label")
    )
    return answers, labels
