"""Country codes, country-level sources and the enrichment dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry import config as C
from cohortry.functions import columns as X


def _tidy(column: str) -> Column:
    return F.lower(F.trim(column))


def resolve_names(names: DataFrame, standard: DataFrame, manual: DataFrame,
                  column: str = "country_name") -> DataFrame:
    """Codes for distinct names: manual map, exact name, cleaned name, else unmatched.

    ``standard`` has (name, alpha3), ``manual`` has (country_name, iso3_code) where a
    null code is a decision, not a miss.
    """
    exact = standard.select(_tidy("name").alias("key"), "alpha3").groupBy("key").agg(
        F.max("alpha3").alias("alpha3")
    )
    stripped = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        _tidy(column), "the ", ""), " islands", ""), " island", ""))
    listed = manual.select(F.col("country_name").alias(column),
                           F.col("iso3_code").alias("manual_code"),
                           F.lit(True).alias("in_manual"))
    return (
        names.select(column).distinct()
        .join(listed, column, "left")
        .withColumn("exact_key", _tidy(column))
        .join(exact.select(F.col("key").alias("exact_key"),
                           F.col("alpha3").alias("exact_code")), "exact_key", "left")
        .withColumn("clean_key", stripped)
        .join(exact.select(F.col("key").alias("clean_key"),
                           F.col("alpha3").alias("clean_code")), "clean_key", "left")
        .select(
            column,
            F.when(F.col("in_manual"), F.col("manual_code"))
            .otherwise(F.coalesce("exact_code", "clean_code")).alias("iso3_code"),
            F.when(F.col("in_manual"), "manual").when(F.col("exact_code").isNotNull(), "exact")
            .when(F.col("clean_code").isNotNull(), "cleaned").otherwise("unmatched")
            .alias("match_method"),
        )
    )


def default_manual_codes(spark) -> DataFrame:
    return spark.createDataFrame(list(C.MANUAL_ISO3.items()),
                                 "country_name string, iso3_code string")


def resolve_column(df: DataFrame, logical: str, required: bool = True) -> str | None:
    """First candidate name of a logical column that the file has."""
    for candidate in C.COLUMN_CANDIDATES[logical]:
        if candidate in df.columns:
            return candidate
    if required:
        raise ValueError(f"no column for {logical!r} in {df.columns}")
    return None


def latest_indicators(records: DataFrame) -> DataFrame:
    """Latest non-null value of each economy and indicator, wide; aggregates dropped."""
    latest = (
        records.filter(~F.col("aggregate") & F.col("value").isNotNull())
        .groupBy("economy", "indicator")
        .agg(F.max_by("value", "time").alias("value"), F.max("time").alias("time"))
    )
    return latest


def pivot_indicators(latest: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = names or list(C.INDICATORS.values())
    return latest.groupBy(F.col("economy").alias("iso3_code")).agg(
        *[F.max(F.when(F.col("indicator") == n, F.col("value"))).alias(n) for n in names]
    )


def join_indicators(latest: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The same wide table as an N-way full outer join, one frame per indicator."""
    names = names or list(C.INDICATORS.values())
    frames = [
        latest.filter(F.col("indicator") == n)
        .select(F.col("economy").alias("iso3_code"), F.col("value").alias(n))
        for n in names
    ]
    return reduce(lambda a, b: a.join(b, "iso3_code", "full"), frames)


def _latest_column(df: DataFrame, prefix: str) -> str | None:
    years = [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    return max(years, key=lambda c: int(c[len(prefix):]), default=None)


def latest_index(wide: DataFrame) -> DataFrame:
    """Index of the latest year with schooling and life expectancy, non-numbers dropped."""
    hdi = _latest_column(wide, "hdi_")
    if hdi is None:
        raise ValueError("no hdi_YYYY column")
    extras = {"education_index": _latest_column(wide, "eys_"),
              "life_expectancy": _latest_column(wide, "le_")}
    return wide.select(
        F.col(resolve_column(wide, "iso3")).alias("iso3_code"),
        F.col(hdi).try_cast("double").alias("hdi"),
        *[F.col(c).try_cast("double").alias(n) for n, c in extras.items() if c],
    ).filter(F.col("hdi").isNotNull())


def read_index_csv(spark, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """Index file as text columns, in the first encoding that reads all of its characters.

    A byte that an encoding does not know is read as the replacement character; the last
    encoding is taken as it is.
    """
    for encoding in encodings:
        table = spark.read.option("encoding", encoding).csv(path, header=True)
        lost = F.concat_ws(" ", *[F.col(f"`{c}`") for c in table.columns]).contains("\ufffd")
        if encoding == encodings[-1] or table.filter(lost).head() is None:
            return table
    raise ValueError("no encoding given")


_SNAPSHOT_MEASURES = {"membership": "lds_membership", "congregations": "lds_congregations",
                      "temples": "lds_temples", "stakes": "lds_stakes",
                      "population": "lds_country_pop"}


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """Latest row of each country; larger membership first when dates tie."""
    country = resolve_column(rows, "country")
    stamp = resolve_column(rows, "date", required=False)
    found = {logical: resolve_column(rows, logical, required=False)
             for logical in _SNAPSHOT_MEASURES}
    parsed = rows.select(
        F.col(country).alias("country_name"),
        (F.to_date(F.try_to_timestamp(stamp)) if stamp else F.lit(None).cast("date"))
        .alias("snapshot_date"),
        *[X.number_from_text(c).alias(_SNAPSHOT_MEASURES[k]) for k, c in found.items() if c],
    ).filter(F.col("country_name").isNotNull())
    measures = [c for c in parsed.columns if c not in ("country_name", "snapshot_date")]
    order = F.struct("snapshot_date", *measures)
    return parsed.groupBy("country_name").agg(F.max(order).alias("top")).select(
        "country_name", "top.*"
    )


def first_by_code(rows: DataFrame, crosswalk: DataFrame, column: str = "country_name") -> DataFrame:
    """One row per code: the first non-null value by country name of each measure."""
    measures = [c for c in rows.columns if c not in (column, "snapshot_date")]
    coded = rows.join(
        crosswalk.filter(F.col("iso3_code").isNotNull())
        .select(F.col("country_name").alias(column), "iso3_code"), column
    )
    return coded.groupBy("iso3_code").agg(*[
        F.min_by(m, F.when(F.col(m).isNotNull(), F.col(column))).alias(m)
        for m in measures
    ])


def religious_composition(shares: DataFrame, diversity: DataFrame, year: int) -> DataFrame:
    nation_rows = (F.col("Level") == 1) & (F.col("Year") == year)
    return (
        shares.filter(nation_rows)
        .join(diversity.filter(nation_rows).select("Country", "RDI_score"), "Country", "left")
        .select(
            F.col("Country").alias("country_name"),
            F.col("Christians").alias("pct_christian"),
            F.col("Muslims").alias("pct_muslim"),
            F.col("Religiously_unaffiliated").alias("pct_unaffiliated"),
            F.col("RDI_score").alias("religious_diversity_index"),
        )
    )


def religious_restrictions(rows: DataFrame, year: int) -> DataFrame:
    return rows.filter(F.col("Question_Year") == year).select(
        F.col("Ctry_EditorialName").alias("country_name"),
        F.col("GRI").alias("govt_restrictions_index"),
        F.col("SHI").alias("social_hostilities_index"),
    )


def attitude_shares(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of respondents per country, refusals (8, 9) excluded, in percent."""
    def share(condition: Column) -> Column:
        return F.round(F.count_if(condition) / F.count("*") * 100, 2)

    by_code = answers.filter(~F.col("religion_import").isin(8, 9)).groupBy("country").agg(
        F.count("*").alias("pew_n_respondents"),
        share(F.col("religion_import").isin(1, 2)).alias("pct_relig_important"),
        share(F.col("religion_import") == 1).alias("pct_relig_very_important"),
        share(F.col("pray_freq").isin(1, 2)).alias("pct_prays_daily"),
        share(F.col("believe_god") == 2).alias("pct_god_necessary_morality"),
    )
    return by_code.join(labels, F.col("country") == F.col("code")).select(
        F.col("label").alias("country_name"),
        *[c for c in by_code.columns if c != "country"],
    )


def unique_by_code(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Country rows keyed by code; names that share a code fold to their largest value."""
    measures = [c for c in rows.columns if c != "country_name"]
    return (
        rows.join(crosswalk.filter(F.col("iso3_code").isNotNull())
                  .select("country_name", "iso3_code"), "country_name")
        .groupBy("iso3_code").agg(*[F.max(m).alias(m) for m in measures])
    )


def composite_index(rows: DataFrame, components: list[str] = C.COMPOSITE_COMPONENTS,
                    minimum: int = C.COMPOSITE_MIN_COMPONENTS,
                    name: str = "gepi") -> DataFrame:
    """Mean of the available z-scores, null with fewer than ``minimum`` of them."""
    stats = rows.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in components],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in components],
    ).alias("stats"))
    scored = rows.withColumn("_stats", stats.scalar())

    def z(c: str) -> Column:
        spread = F.col(f"_stats.s_{c}")
        value = (F.col(c) - F.col(f"_stats.m_{c}")) / F.nullif(spread, F.lit(0.0))
        return F.when(spread > 0, value).otherwise(F.lit(0.0))

    terms = [z(c) for c in components]
    present = X.total(t.isNotNull().cast("int") for t in terms)
    value = X.total(F.coalesce(t, F.lit(0.0)) for t in terms) / F.nullif(present, F.lit(0))
    return scored.withColumns({
        name: F.when(present >= minimum, value), f"{name}_n_components": present,
    }).drop("_stats")


def members_per_capita(population: str = "lds_country_pop") -> Column:
    return F.col("lds_membership") / X.clip(population, lower=1.0)


def build_enrichment(crosswalk: DataFrame, indicators: DataFrame, index: DataFrame,
                     snapshot: DataFrame, by_name: list[DataFrame]) -> DataFrame:
    """One row per code: left joins of all sources onto the distinct codes."""
    base = crosswalk.filter(F.col("iso3_code").isNotNull()).select("iso3_code").distinct()
    joined = (
        base.join(indicators, "iso3_code", "left").join(index, "iso3_code", "left")
        .join(first_by_code(snapshot, crosswalk), "iso3_code", "left")
        .withColumn("lds_members_per_capita", members_per_capita())
    )
    scored = composite_index(joined).drop("gepi_n_components")
    coded = [unique_by_code(rows, crosswalk) for rows in by_name]
    religion = reduce(lambda a, b: a.join(b, "iso3_code", "full"), coded)
    return scored.join(religion, "iso3_code", "left")


def assert_unique(df: DataFrame, key: str = "iso3_code") -> DataFrame:
    """Fails the job when the key repeats: a repeated code would fan out every user."""
    once = F.assert_true(F.count("*").over(W.partitionBy(key)) == 1,
                         f"{key} is not unique")
    return df.withColumn("_once", once).filter(F.col("_once").isNull()).drop("_once")


def enrich_users(users: DataFrame, enrichment: DataFrame,
                 columns: list[str] | None = None) -> DataFrame:
    columns = columns or [c for c in enrichment.columns if c != "iso3_code"]
    return users.join(enrichment.select("iso3_code", *columns), "iso3_code", "left")


def user_coverage(users: DataFrame, enrichment: DataFrame, columns: list[str]) -> DataFrame:
    """Users with an enrichment row, and with each column, counted once each.

    Users are counted per code first, so the join handles a few hundred rows.
    """
    per_code = users.groupBy("iso3_code").agg(F.count("*").alias("n_users"))
    keyed = enrichment.select("iso3_code", *columns).withColumn("hit", F.lit(True))
    joined = per_code.join(keyed, "iso3_code", "left")

    def users_if(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n_users")).otherwise(0))

    return joined.agg(
        F.sum("n_users").alias("users_total"),
        users_if(F.col("hit")).alias("users_enrichable"),
        *[users_if(F.col(c).isNotNull()).alias(f"users_with_{c}") for c in columns],
    )


def column_coverage(enrichment: DataFrame) -> DataFrame:
    """Non-null count and share of every enrichment column, in one pass."""
    columns = [c for c in enrichment.columns if c != "iso3_code"]
    counts = enrichment.agg(F.count("*").alias("n_rows"),
                            *[F.count(c).alias(c) for c in columns])
    return counts.unpivot("n_rows", columns, "column_name", "n_present").select(
        "column_name", "n_present",
        F.round(F.col("n_present") * 100.0 / F.col("n_rows"), 1).alias("pct_present"),
    )


def country_composites(enrichment: DataFrame) -> DataFrame:
    """Products of country-level measures: digital readiness and intensity."""
    temples = F.col("lds_temples") / F.nullif(F.col("lds_country_pop"), F.lit(0.0)) * 1_000_000
    return enrichment.withColumns({
        "digital_readiness_score":
            F.col("internet_pct") * F.col("hdi") * F.col("education_index"),
        "lds_intensity_score": F.col("lds_members_per_capita") * temples,
    })
