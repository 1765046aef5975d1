"""Profiles of columns, groups and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators.ranks import join_groups, quantiles, quantiles_of_runs, running_counts, to_long
from cohortry.session import materialize


def share_of_total(counts: DataFrame, value: str = "n", name: str = "pct",
                   digits: int = 2, within: list[str] | None = None) -> DataFrame:
    """Percent of the total (or of each ``within`` group) on an aggregated table."""
    whole = F.sum(value).over(W.partitionBy(*(within or [])))
    return counts.withColumn(name, F.round(F.col(value) * 100.0 / whole, digits))


def frequencies(df: DataFrame, *keys: str | Column) -> DataFrame:
    return share_of_total(df.groupBy(*keys).agg(F.count("*").alias("n")))


def segment_persistence(users: DataFrame) -> DataFrame:
    """Size, share, mean and exact median persistence per activity segment.

    The folded (segment, score) table carries the other sums along, so the users are
    read once.
    """
    key, score = "activity_segment", "persistence_c"
    runs = running_counts(users, [key], score, {
        "n": F.count("*"), "b": F.sum("activity_breadth"), "l": F.sum("logins_per_week")})
    means = runs.groupBy(key).agg(
        F.round(F.sum(F.col(score) * F.col("n")) / F.sum("n"), 6).alias("mean_persistence"),
        F.round(F.sum("b") / F.sum("n"), 6).alias("mean_breadth"),
        F.round(F.sum("l") / F.sum("n"), 6).alias("mean_logins_per_week"),
        F.sum("n").alias("n"))
    medians = quantiles_of_runs(runs, [key], score, {"median": 0.5})
    return join_groups(share_of_total(means), materialize(medians), [key]).select(
        key, "n", "pct", "mean_persistence",
        F.round("median", 6).alias("median_persistence"),
        "mean_breadth", "mean_logins_per_week")


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and share per column: one aggregate, then unpivoted."""
    columns = columns or df.columns
    nulls = df.agg(F.count("*").alias("n_rows"),
                   *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return nulls.unpivot("n_rows", columns, "column_name", "n_null").select(
        "column_name", "n_null",
        F.round(F.col("n_null") * 100.0 / F.col("n_rows"), 2).alias("pct_null"))


def summary(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact median per column (and group)."""
    keys = keys or []
    long = to_long(df, keys, columns)
    by = [*keys, "feature"]
    moments = long.groupBy(*by).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    return join_groups(moments, materialize(quantiles(long, by, "value", {"median": 0.5})), by, "left")


def correlations(df: DataFrame, pairs: dict[str, tuple[str, str]], digits: int = 6) -> DataFrame:
    return df.agg(*[F.round(F.corr(a, b), digits).alias(n) for n, (a, b) in pairs.items()])


def data_health(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Missing, zeros, moments, median, p99, skewness and distinct values per column.

    Distinct values and quantiles come from the folded (column, value) table, so both
    are exact without a per-column pass.
    """
    long = to_long(df, [], numeric, "column_name")
    value, n = F.col("value"), F.count("value")
    # bias-corrected skewness, only with enough values
    skew = F.skewness("value") * F.sqrt(n * (n - 1.0)) / (n - 2)
    moments = long.groupBy("column_name").agg(
        F.count("*").alias("n_total"), (F.count("*") - n).alias("n_missing"),
        F.count_if(value == 0).alias("n_zeros"), F.round(F.avg("value"), 2).alias("mean"),
        F.round(F.stddev_samp("value"), 2).alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.when(n > 100, F.round(skew, 2)).alias("skewness"))
    spread = quantiles(long, ["column_name"], "value", {"median": 0.5, "p99": 0.99})
    numbers = moments.join(spread, "column_name", "left").withColumns({
        c: F.col(c).cast("long") for c in ("median", "min", "max", "p99")})
    words = df.select(*[F.col(c).cast("string") for c in text]).unpivot(
        [], text, "column_name", "value")
    distinct = words.groupBy("column_name", "value").agg(F.count("*").alias("m")).groupBy(
        "column_name").agg(
            F.sum("m").alias("n_total"),
            F.sum(F.when(F.col("value").isNull(), F.col("m")).otherwise(0)).alias("n_missing"),
            F.count("value").alias("n_unique"))
    both = numbers.unionByName(distinct, allowMissingColumns=True)
    share = {f"pct_{k}": F.round(F.col(f"n_{k}") * 100.0 / F.col(base), 2)
             for k, base in (("missing", "n_total"),)}
    valid = F.col("n_total") - F.col("n_missing")
    share["pct_zeros"] = F.when(valid > 0, F.round(F.col("n_zeros") * 100.0 / valid, 2))
    return both.withColumns(share)


def group_profile(df: DataFrame, keys: list[str], features: list[str],
                  digits: int = 6) -> DataFrame:
    """Size, share, and mean and median of each feature per group, in long form."""
    long = to_long(df, keys, features).fillna(0.0, ["value"])
    by = [*keys, "feature"]
    means = long.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("value"), digits).alias("mean"))
    medians = materialize(quantiles(long, by, "value", {"median": 0.5}))
    return join_groups(means, medians, by).withColumn("median", F.round("median", digits))


def five_numbers(df: DataFrame, keys: list[str], column: str, digits: int = 6) -> DataFrame:
    """Minimum, quartiles and maximum per group, exact."""
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}
    found = quantiles(df, keys, column, probs)
    return found.select(*keys, *[F.round(c, digits).alias(c) for c in probs])


def count_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shape of count columns: zeros, quantiles, skew, kurtosis, share of IQR outliers."""
    long = to_long(df, [], columns).filter(F.col("value").isNotNull())
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    spread = materialize(quantiles(long, ["feature"], "value", probs))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
    n = F.count("*")
    return long.join(spread, "feature").groupBy("feature").agg(
        n.alias("n"),
        F.round(F.count_if(F.col("value") == 0) * 100.0 / n, 4).alias("pct_zero"),
        F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"),
        *[F.round(F.max(c), 6).alias(c) for c in ("median", "p99")],
        F.round(F.skewness("value") * F.sqrt(n * (n - 1.0)) / (n - 2), 4).alias("skewness"),
        F.round(F.kurtosis("value"), 4).alias("kurtosis"),
        F.round(F.count_if(outside) * 100.0 / n, 4).alias("pct_outliers"))


def histogram(df: DataFrame, column: str, bins: int, log: bool = False) -> DataFrame:
    """Counts per equal-width bin between the extremes; the maximum joins the last bin."""
    value = F.log1p(column) if log else F.col(column).cast("double")
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    ends = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")))
    lo, hi = F.col("_ends.lo"), F.col("_ends.hi")
    width = F.nullif((hi - lo) / bins, F.lit(0.0))
    spot = F.floor((F.col("v") - lo) / width)
    return (
        values.withColumn("_ends", ends.scalar())
        .select(F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("n"))
    )


def top_share(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Part of the column's total held by the top share of rows.

    Works on distinct values with running totals; the value at the cut contributes only
    as many of its rows as still fit, so the result equals the row-by-row one.
    """
    runs = running_counts(df, [], column, {"n": F.count("*"), "s": F.sum(column)})
    parts = []
    for share in shares:
        first = F.col("n_all") - F.ceil(F.col("n_all") * share)
        inside = X.clip(F.col("n_before") + F.col("n") - first, lower=0)
        taken = F.least(inside, F.col("n"))
        parts.append(
            F.round(F.sum(taken * F.col(column)) / F.max("s_all"), 6)
            .alias(f"top_{share * 100:g}pct".replace(".", "_")))
    return runs.agg(*parts)


def density_status(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Cells per column that carry meaning, hold zero or a placeholder, or are null."""
    def kinds(c: str) -> tuple[Column, Column]:
        empty = F.col(c).isNull()
        idle = (F.col(c) == 0) if c in numeric else F.trim(c).isin(C.SENTINELS)
        return empty, ~empty & idle

    columns = numeric + text
    cells = df.agg(F.count("*").alias("n_rows"), *[
        F.struct(F.count_if(kinds(c)[0]).alias("n_null"),
                 F.count_if(kinds(c)[1]).alias("n_idle")).alias(c) for c in columns])
    return cells.unpivot("n_rows", columns, "column_name", "k").select(
        "column_name", "k.n_null", "k.n_idle",
        (F.col("n_rows") - F.col("k.n_null") - F.col("k.n_idle")).alias("n_meaningful"))


def meaningful_columns(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Histogram of how many columns carry meaning per row."""
    good = [F.coalesce(F.col(c) != 0, F.lit(False)) for c in numeric]
    good += [F.coalesce(~F.trim(c).isin(C.SENTINELS), F.lit(False)) for c in text]
    per_row = X.total(g.cast("int") for g in good)
    return df.groupBy(per_row.alias("n_columns")).agg(F.count("*").alias("n"))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Nested filters counted in one pass, with the loss from step to step."""
    passed, conditions = F.lit(True), []
    for name, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        conditions.append(F.count_if(passed).alias(name))
    names = [name for name, _ in steps]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("step")).cast("int")
    # a handful of rows: one per step
    before = F.lag("n").over(W.orderBy("position"))
    return (
        df.agg(*conditions).unpivot([], names, "step", "n").withColumn("position", rank)
        .withColumn("lost", before - F.col("n"))
    )


def co_occurrence(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Users with both activities of each pair, and with exactly one activity."""
    names = list(flags)
    pairs = {f"{a}|{b}": (a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    marked = df.select(*[f.alias(n) for n, f in flags.items()])
    alone = X.total(F.col(n) for n in names) == 1
    counts = marked.agg(
        *[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(p) for p, (a, b) in pairs.items()],
        *[F.count_if(alone & (F.col(n) == 1)).alias(f"{n}|only") for n in names])
    return counts.unpivot([], counts.columns, "combination", "n")


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares of every value of several columns, in one pass."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return share_of_total(counts, within=["column_name"])


def cross_tab(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Counts per row key and column value with row percentages."""
    wide = df.groupBy(rows).pivot(column, values).count().fillna(0, values)
    whole = X.total(F.col(v) for v in values)
    return wide.withColumns({
        f"pct_{v}": F.round(F.col(v) * 100.0 / whole, 2) for v in values})


def tenure_bin(column: str = "tenure_days") -> Column:
    days = F.col(column)
    return (F.when(days <= 30, "0-30d").when(days <= 90, "31-90d").when(days <= 180, "91-180d")
            .when(days <= 270, "181-270d").when(days <= 365, "271-365d").otherwise("365+d"))


def activity_by_bin(df: DataFrame, bin_column: Column, columns: list[str],
                    digits: int = 6) -> DataFrame:
    """Mean and coefficient of variation of activity columns per bin."""
    filled = df.select(bin_column.alias("bin"), *[X.zero(c).alias(c) for c in columns])
    return filled.groupBy("bin").agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(c), digits).alias(f"mean_{c}") for c in columns],
        *[F.round(F.stddev_samp(c) / F.nullif(F.avg(c), F.lit(0.0)), digits).alias(f"cv_{c}")
          for c in columns])


def milestone_coverage(users: DataFrame) -> DataFrame:
    """Share reaching each milestone, median days to it, and share before creation."""
    gaps = {m: X.gap_days("account_create_date", c, floor=False)
            for m, c in C.MILESTONES.items()}
    long = users.select(*[g.cast("double").alias(m) for m, g in gaps.items()]).unpivot(
        [], list(gaps), "milestone", "days")
    counts = long.groupBy("milestone").agg(
        F.count("days").alias("n_reached"),
        F.round(F.count("days") * 100.0 / F.count("*"), 4).alias("pct_reached"),
        F.round(F.count_if(F.col("days") < 0) * 100.0 / F.count("days"), 4)
        .alias("pct_before_creation"))
    medians = quantiles(long, ["milestone"], "days", {"median_days": 0.5})
    return counts.join(medians, "milestone", "left")


def order_consistency(users: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of users with both milestones who reached the first no later."""
    return users.agg(*[
        F.round(F.avg((F.col(C.MILESTONES[a]) <= F.col(C.MILESTONES[b])).cast("double")), 6)
        .alias(name) for name, (a, b) in pairs.items()])


def geo_pattern(columns: list[str]) -> Column:
    """Which geography columns are set, as a 0/1 string."""
    return F.concat(*[F.when(X.clean_text(c).isNotNull(), "1").otherwise("0") for c in columns])


def pooled_category(df: DataFrame, column: str, minimum: int, other: str = "Micro") -> DataFrame:
    """Rare values of a column replaced by one label."""
    sizes = materialize(df.groupBy(column).agg(F.count("*").alias("_size")))
    return df.join(sizes, column, "left").withColumn(
        "pooled", F.when(F.col("_size") < minimum, other).otherwise(F.col(column))
    ).drop("_size")


def derived_features(df: DataFrame, definitions: DataFrame, allowed: list[str]) -> DataFrame:
    """Add columns from a (feature, sql_expression) registry.

    Only the few registry rows reach the driver. An expression may use the allowed
    columns and nothing else: it is analysed against a frame with just those.
    """
    empty = df.select(*allowed).limit(0)
    out = df
    for row in definitions.select("feature", "sql_expression").orderBy("feature").toLocalIterator():
        _ = empty.select(F.expr(row.sql_expression)).schema  # raises on other columns
        out = out.withColumn(row.feature, F.expr(row.sql_expression))
    return out
