"""Reproducible samples, splits and weights, keyed by md5 of the user and a seed.

The same rows come out whatever the partitioning, and again after a lost executor. Sizes
per stratum are written before they are joined: one pass over the users, and the size on
file lets Spark broadcast them, so no join shuffles users by a hot stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators.ranks import hash_key, hash_uniform, mark_smallest, smallest_hashes
from cohortry.session import materialize

TRIM_SEED = 100
SPLIT_SEED = 200


def stratum_label(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("Unknown")) for c in columns])


def with_strata(users: DataFrame, columns: tuple[str, ...] = ("country_cluster", "USER_WORLD_REGION"),
                floor: int = C.STRATUM_FLOOR) -> DataFrame:
    """Stratum of each user; strata under the floor share one pooled stratum."""
    labelled = users.withColumn("_raw", stratum_label(*columns))
    sizes = labelled.groupBy("_raw").agg(F.count("*").alias("_n"))
    return labelled.join(materialize(sizes), "_raw").withColumn(
        "stratum", F.when(F.col("_n") < floor, "Other|Pooled").otherwise(F.col("_raw"))
    ).drop("_raw", "_n")


def proportional_allocation(strata: DataFrame, rows: int = C.SUBSAMPLE_ROWS,
                            floor: int = C.STRATUM_FLOOR) -> DataFrame:
    """Rows to draw per stratum: its share of ``rows``, at least ``floor``, at most all."""
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("stratum_size"))
    total = sizes.agg(F.sum("stratum_size")).scalar()
    share = F.bround(F.col("stratum_size") / total * rows).cast("long")
    return sizes.withColumn("draw_size", F.least("stratum_size", F.greatest(F.lit(floor), share)))


def composite_allocation(strata: DataFrame, rows: int, minimum: int = 30) -> DataFrame:
    """Small strata whole, others ``minimum`` plus their share of the rest; with weights."""
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("stratum_size"))
    small = F.col("stratum_size") < minimum
    totals = sizes.agg(F.struct(
        F.sum(F.when(small, F.col("stratum_size")).otherwise(0)).alias("census"),
        F.count_if(~small).alias("sampled"),
        F.sum(F.when(~small, F.col("stratum_size"))).alias("sampled_rows")))
    budget = F.greatest(
        rows - F.col("_t.census") - minimum * F.col("_t.sampled"), F.lit(0))
    wanted = minimum + F.bround(budget * F.col("stratum_size") / F.col("_t.sampled_rows")).cast("long")
    return sizes.withColumn("_t", totals.scalar()).withColumn(
        "draw_size", F.when(small, F.col("stratum_size")).otherwise(F.least("stratum_size", wanted))
    ).drop("_t").withColumn("sampling_weight", F.col("stratum_size") / F.col("draw_size"))


def stratified_draws(users: DataFrame, allocation: DataFrame, draws: int = C.SUBSAMPLES,
                     rows: int | None = C.SUBSAMPLE_ROWS, key: str = "USER_ID",
                     base_seed: int = C.BASE_SEED) -> DataFrame:
    """(subsample_id, key, stratum, sampling_weight) of all draws in one plan.

    Only key and stratum are multiplied by the number of draws; features are joined to
    the drawn keys afterwards. Draws over ``rows`` plus slack are trimmed to ``rows``.
    """
    slim = users.select(key, "stratum").join(
        materialize(allocation.select("stratum", "stratum_size", "draw_size")), "stratum")
    each = slim.withColumn("subsample_id", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    seed = F.col("subsample_id") + base_seed
    drawn = smallest_hashes(each.withColumn("_digest", hash_key(key, seed)),
                            ["subsample_id", "stratum"], "draw_size", "_digest", key)
    weight = (F.col("stratum_size") / F.col("draw_size")).alias("sampling_weight")
    # written: the draw is small, and trimming and splitting read it several times
    drawn = materialize(drawn.select("subsample_id", key, "stratum", weight))
    return drawn if rows is None else _trim(drawn, rows, key, base_seed)


def _trim(drawn: DataFrame, rows: int, key: str, base_seed: int) -> DataFrame:
    totals = drawn.groupBy("subsample_id").agg(F.count("*").alias("_total"))
    quota = F.when(F.col("_total") > rows + C.TRIM_SLACK, F.lit(rows)).otherwise(F.col("_total"))
    seed = F.col("subsample_id") + base_seed + TRIM_SEED
    sized = drawn.join(materialize(totals), "subsample_id").withColumns(
        {"_quota": quota, "_digest": hash_key(key, seed)})
    kept = smallest_hashes(sized, ["subsample_id"], "_quota", "_digest", key)
    return materialize(kept.select(*drawn.columns))


def split_train_test(df: DataFrame, strata: list[str], key: str = "USER_ID",
                     seed: Column | int = C.BASE_SEED, share: float = C.TRAIN_SHARE) -> DataFrame:
    """Add ``split``: floor(share * n) rows of each stratum train, the rest test.

    Nulls in ``strata`` form a stratum of their own. ``df`` is read more than once.
    """
    safe = {f"_s{i}": F.coalesce(F.col(s).cast("string"), F.lit("(null)"))
            for i, s in enumerate(strata)}
    keyed = df.withColumns({**safe, "_digest": hash_key(key, seed)})
    sizes = keyed.groupBy(*safe).agg(F.floor(F.count("*") * share).alias("_train"))
    sized = keyed.join(materialize(sizes), list(safe)) if safe else keyed.withColumn(
        "_train", sizes.scalar())
    marked = mark_smallest(sized, list(safe), "_train", "_digest", key, "_in")
    return marked.withColumn("split", F.when(F.col("_in"), "train").otherwise("test")).drop(
        *safe, "_digest", "_train", "_in")


def simple_sample(df: DataFrame, rows: int, key: str = "USER_ID",
                  seed: int = C.BASE_SEED) -> DataFrame:
    """Exactly ``rows`` rows (or all), without replacement."""
    keyed = df.withColumns({"_digest": hash_key(key, seed), "_rows": F.lit(rows)})
    return smallest_hashes(keyed, [], "_rows", "_digest", key).drop("_digest", "_rows")


def repeated_samples(df: DataFrame, rows: int, draws: int, group: str | None = None,
                     key: str = "USER_ID", base_seed: int = C.BASE_SEED) -> DataFrame:
    """(group,) subsample_id and key of simple samples, all draws in one plan."""
    groups = [group] if group else []
    each = df.select(*groups, key).withColumns({
        "subsample_id": F.explode(F.sequence(F.lit(1), F.lit(draws))), "_rows": F.lit(rows)})
    seed = F.col("subsample_id") + base_seed
    drawn = smallest_hashes(each.withColumn("_digest", hash_key(key, seed)),
                            [*groups, "subsample_id"], "_rows", "_digest", key)
    return drawn.select(*groups, "subsample_id", key)


def pair_subsamples(draws: DataFrame) -> DataFrame:
    """Subsamples 1+2, 3+4, ... as one; a user drawn in both stays twice."""
    return draws.withColumns({
        "pair_id": F.ceil(F.col("subsample_id") / 2),
        "draw_key": F.concat_ws("-", F.col("USER_ID").cast("string"),
                                F.col("subsample_id").cast("string"))})


def by_account_type(users: DataFrame) -> DataFrame:
    """Each user under ``Full`` and under the own account type."""
    return users.withColumn("group", F.explode(F.array(F.lit("Full"), F.col("ACCOUNT_TYPE"))))


def _poisson_steps() -> list[float]:
    """P(X <= k) of Poisson(1) for k = 0, 1, ... until the tail is below what the 32-bit uniform resolves."""
    term, total, k, steps = math.exp(-1.0), math.exp(-1.0), 0, []
    while 1.0 - total >= 2.0 ** -32:
        steps.append(total)
        k += 1
        term /= k
        total += term
    return [*steps, total]


POISSON_STEPS = _poisson_steps()


def bootstrap_weight(seed: int | Column, key: str = "USER_ID") -> Column:
    """How often a row enters a bootstrap resample: Poisson(1), fixed by key and seed."""
    u = hash_uniform(hash_key(key, seed))
    return X.total((u >= step).cast("int") for step in POISSON_STEPS)


def row_numbers(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """``df`` with gapless numbers from 0 in the order of its unique ``key``.

    Rows are dealt by ranges of the key and counted there; a range starts where those
    before it end. Only the counts of the ranges are ordered in one place.
    """
    dealt = materialize(df.repartitionByRange(key).sortWithinPartitions(key).withColumn(
        "_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(sizes.select("_part", before.alias("_before")))
    return dealt.withColumn("_part", part).join(starts, "_part").withColumn(
        name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def exact_bootstraps(df: DataFrame, draws: int, key: str = "USER_ID", base_seed: int = C.BASE_SEED) -> DataFrame:
    """(key, bootstrap, weight): how often each resample of exactly n rows, with replacement, takes a row.

    Draw j of a resample takes the row whose number is the hash of (j, seed), scaled to n.
    Draws are counted by number before they meet the rows; rows not drawn have no line.
    """
    numbered = materialize(row_numbers(df.select(key), key))
    n = numbered.count()
    aim = df.sparkSession.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("bootstrap"))
    digest = hash_key("id", F.col("bootstrap") + base_seed)
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    hits = aim.groupBy("bootstrap", F.floor(u * n).alias("number")).agg(F.count("*").alias("weight"))
    return hits.join(numbered, "number").select(key, "bootstrap", "weight")


def with_bootstraps(df: DataFrame, draws: int, key: str = "USER_ID", name: str = "bootstraps") -> DataFrame:
    """``df`` with an array of its rows' weights in ``draws`` resamples of exactly n rows."""
    wide = exact_bootstraps(df, draws, key).groupBy(key).agg(F.array(*[
        F.sum(F.when(F.col("bootstrap") == b, F.col("weight")).otherwise(0)).cast("double") for b in range(draws)]).alias(name))
    none = F.array_repeat(F.lit(0.0), draws)
    return df.join(wide, key, "left").withColumn(name, F.coalesce(name, none))


def subsample_metadata(draws: DataFrame) -> DataFrame:
    """Size, split, persistence rate, tenure and strata of each subsample."""
    return draws.groupBy("subsample_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.round(F.avg(F.coalesce("persist_median", F.lit(0))) * 100, 4).alias("persist_rate"),
        F.round(F.avg("tenure_days"), 4).alias("mean_tenure"),
        F.count_distinct("stratum").alias("n_strata"))


def population_estimate(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated users per group from the sampling weights, with their share."""
    from cohortry.operators.profile import share_of_total

    sums = draws.groupBy(*keys).agg(F.count("*").alias("n_sampled"),
                                    F.sum("sampling_weight").alias("estimate"))
    return share_of_total(sums, "estimate", "pct", 4, keys[:-1])
