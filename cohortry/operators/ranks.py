"""Exact ranks, quantiles and running totals over whole populations.

A global ``row_number`` or ``percentile`` puts every row, or every distinct value, into
one task. Here equal values are folded first (map-side), the distinct values are dealt
into ranges, and only range totals are summed in order. Quantiles do not even move the
values: brackets around their places are narrowed by sketches, what lies below a bracket is
counted, and only the values inside it are ranked. Results are exact: sketches and ranges
decide where work happens, not what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry.session import materialize


def running_counts(df: DataFrame, keys: list[str], value: str,
                   sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per key and distinct value with running totals.

    For each entry of ``sums`` (default: ``n`` = row count) the result has the own total
    ``<s>``, the total of smaller values ``<s>_before`` and the group total ``<s>_all``.
    """
    sums = sums or {"n": F.count("*")}
    names = list(sums)
    folded = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[e.alias(n) for n, e in sums.items()])
    # written once: a value's range is the partition it was dealt to
    ranged = materialize(folded.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    by_range = W.partitionBy(*keys).orderBy("_range")
    earlier = by_range.rowsBetween(W.unboundedPreceding, -1)
    # at most one row per range in each group
    offsets = totals.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_offset")
          for n in names],
        *[F.sum(f"_{n}").over(W.partitionBy(*keys)).alias(f"{n}_all") for n in names],
    )
    within = (
        W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    )
    return join_groups(ranged, offsets, [*keys, "_range"]).select(
        *keys, value, *names,
        *[(F.col(f"_{n}_offset") + F.coalesce(F.sum(n).over(within), F.lit(0)))
          .alias(f"{n}_before") for n in names],
        *[f"{n}_all" for n in names],
    )


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with nulls equal; the keys come from the left."""
    names = {k: f"_{k}_of_group" for k in keys}
    right = right.withColumnsRenamed(names)
    same = F.lit(True)
    for k, other in names.items():
        same = same & left[k].eqNullSafe(right[other])
    return left.join(right, same, how).drop(*names.values())


#: Points of a sketch, its accuracy, and the number of values that one task ranks.
GRID, ACCURACY, RANKED = 200, 4000, 100_000


def _with_brackets(data: DataFrame, brackets: DataFrame | None, keys: list[str]) -> DataFrame:
    if brackets is None:
        return data.withColumn("_b", F.lit(None).cast("array<struct<lo:double,hi:double>>"))
    if keys:
        return join_groups(data, brackets.select(*keys, "_b"), keys)
    return data.withColumn("_b", brackets.select("_b").scalar())


def quantiles(df: DataFrame, keys: list[str], value: str,
              probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``.

    ``df`` is read once to narrow the brackets for every factor of about sixty that a group
    is larger than ``RANKED``, and once more to rank what they hold; pass a written table.
    """
    count = len(probs)
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    brackets, most = None, data.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    while most > RANKED:
        narrowed = _narrow(_with_brackets(data, brackets, keys), keys, probs, brackets is None)
        after = narrowed.agg(F.max("_inside")).head()[0]
        brackets = narrowed
        if after >= most:  # one value holds a bracket; folding makes it one row
            break
        most = after
    placed = _with_brackets(data, brackets, keys)
    numbers = F.sequence(F.lit(0), F.lit(count - 1))
    low, high = (F.element_at("_b", F.col("_i") + 1)[c] for c in ("lo", "hi"))
    each = placed.withColumn("_i", F.explode(numbers)).filter(high.isNull() | (F.col("_v") <= high))
    # everything below a bracket is one line without a value
    folded = each.groupBy(*keys, "_i", F.when(low.isNull() | (F.col("_v") >= low), F.col("_v")).alias("_v")).agg(
        F.count("*").alias("_n"))
    if brackets is None:
        total = F.sum("_n").over(W.partitionBy(*keys, "_i"))
        folded = folded.withColumn("_all", total)
    else:
        folded = join_groups(folded, brackets.select(*keys, "_all"), keys) if keys else folded.withColumn(
            "_all", brackets.select("_all").scalar())
    upto = F.sum("_n").over(W.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())
                            .rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = folded.withColumn("_upto", upto)
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs.values()]), F.col("_i") + 1)
    spot = (F.col("_all") - 1) * p

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.col("_v")))

    ends = ranked.withColumn("_spot", spot).groupBy(*keys, "_i").agg(
        at(F.floor("_spot")).alias("_lo"), at(F.ceil("_spot")).alias("_hi"), F.max("_spot").alias("_spot"))
    blend = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_spot") - F.floor("_spot"))
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, blend)).alias(name) for i, name in enumerate(probs)])


def _narrow(placed: DataFrame, keys: list[str], probs: dict[str, float], first: bool) -> DataFrame:
    """Per group ``_all`` values, narrower brackets ``_b`` and the most values in one, ``_inside``.

    A sketch of a bracket's values gives cuts around the wanted place. The cuts are several
    times further away than the sketch errs, so the place stays inside.
    """
    v, marks = F.col("_v"), [i / GRID for i in range(GRID + 1)]
    aggregates = [F.count("*").alias("_all")]
    for i in range(1 if first else len(probs)):
        low, high = F.element_at("_b", i + 1)["lo"], F.element_at("_b", i + 1)["hi"]
        inside = v if first else F.when((v >= low) & (v <= high), v)
        aggregates += [F.percentile_approx(inside, marks, ACCURACY).alias(f"_g{i}"), F.count(inside).alias(f"_in{i}"),
                       (F.lit(0) if first else F.count_if(v < low)).alias(f"_below{i}")]
    found = materialize(placed.groupBy(*keys).agg(*aggregates))
    brackets, inside = [], []
    for i, p in enumerate(probs.values()):
        at = 0 if first else i
        held, grid, spot = F.col(f"_in{at}"), F.col(f"_g{at}"), (F.col("_all") - 1) * p - F.col(f"_below{at}")
        low = F.greatest(F.floor(F.floor(spot) / held * GRID) - 1, F.lit(0)).cast("int")
        high = F.least(F.floor((F.ceil(spot) + 1) / held * GRID) + 2, F.lit(GRID)).cast("int")
        brackets.append(F.struct(F.element_at(grid, low + 1).alias("lo"), F.element_at(grid, high + 1).alias("hi")))
        inside.append(F.ceil(held * (high - low) / GRID))
    most = F.greatest(*inside) if len(inside) > 1 else inside[0]
    return materialize(found.select(*keys, "_all", F.array(*brackets).alias("_b"), most.alias("_inside")))


def quantiles_of_runs(runs: DataFrame, keys: list[str], value: str,
                      probs: dict[str, float]) -> DataFrame:
    after = F.col("n_before") + F.col("n")

    def at(position: Column) -> Column:
        return F.min(F.when(after > position, F.col(value)))

    last = F.max("n_all") - 1
    spots = {name: (F.col("n_all") - 1) * p for name, p in probs.items()}
    found = runs.groupBy(*keys).agg(
        last.alias("_last"),
        *[at(F.floor(s)).alias(f"_{n}_lo") for n, s in spots.items()],
        *[at(F.ceil(s)).alias(f"_{n}_hi") for n, s in spots.items()],
    )

    def blend(name: str, p: float) -> Column:
        spot = F.col("_last") * p
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + (high - low) * (spot - F.floor(spot))).alias(name)

    return found.select(*keys, *[blend(n, p) for n, p in probs.items()])


def to_long(df: DataFrame, keys: list[str], columns: list[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    """Numeric columns as rows (feature, value), for one pass over all of them."""
    return df.select(
        *keys, *[F.col(c).cast("double").alias(c) for c in columns]
    ).unpivot(keys, columns, name, value)


#: A value with this share of its column is ranked by lookup; there are at most 1 / HEAVY of them.
HEAVY = 0.001


def percent_rank_average(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns replaced by their percentile rank, ties sharing the mean rank.

    Ranks are found per distinct (column, value). Values that hold a thousandth of their
    column or more are few: their ranks are broadcast and looked up, whatever their number
    of rows. Rows with other values meet their ranks in a join without hot keys.
    """
    long = to_long(df, [key], columns)
    ranks = materialize(running_counts(long, ["feature"], "value").select(
        "feature", "value", (F.col("n") >= F.col("n_all") * HEAVY).alias("_heavy"),
        ((F.col("n_before") + (F.col("n") + 1) / 2) / F.col("n_all")).alias("pct")))
    heavy = F.broadcast(ranks.filter("_heavy").select("feature", "value", F.col("pct").alias("_known")))
    marked = long.join(heavy, ["feature", "value"], "left")
    rest = F.col("_known").isNull() & F.col("value").isNotNull()
    known = marked.filter(~rest).select(key, "feature", F.col("_known").alias("pct"))
    light = marked.filter(rest).join(ranks.filter("not _heavy"), ["feature", "value"]).select(key, "feature", "pct")
    return known.unionByName(light).groupBy(key).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("pct"))).alias(c) for c in columns])


def hash_key(column: str, seed: int | Column) -> Column:
    """Reproducible random order of rows: md5 of ``key|seed``."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", F.col(column).cast("string"), seed.cast("string")))


def hash_uniform(digest: Column) -> Column:
    """The digest's first 32 bits as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mark_smallest(df: DataFrame, groups: list[str], size: str, digest: str, key: str,
                  name: str, digits: int | None = None) -> DataFrame:
    """Flag the ``size`` rows of each group with the smallest (digest, key); exact.

    A histogram over digest prefixes finds the prefix where each group's quota ends, and
    a ranking of that prefix's (digest, key) pairs the last pair inside. Rows are then
    compared with their group's last pair, so no row is shuffled with its other columns.
    Group columns must not be null. ``df`` is read more than once.
    """
    marked, inside = _with_limits(df, groups, size, digest, key, digits)
    return marked.withColumn(name, inside).drop("_limit")


def smallest_hashes(df: DataFrame, groups: list[str], size: str, digest: str, key: str,
                    digits: int | None = None) -> DataFrame:
    """Only the rows ``mark_smallest`` would flag."""
    marked, inside = _with_limits(df, groups, size, digest, key, digits)
    return marked.filter(inside).drop("_limit")


def _with_limits(df: DataFrame, groups: list[str], size: str, digest: str, key: str,
                 digits: int | None) -> tuple[DataFrame, Column]:
    # a short prefix for many groups: a histogram of nearly as many lines as rows folds nothing
    digits = digits or (2 if groups else 4)
    narrow = df.select(*groups, F.col(size).alias("_size"), F.col(digest).alias("_d"), F.col(key).alias("_k")).withColumn(
        "_prefix", F.substring("_d", 1, digits))
    counts = narrow.groupBy(*groups, "_prefix").agg(
        F.count("*").alias("_n"), F.max("_size").alias("_size")
    )
    # at most 16^digits rows per group
    upto = (W.partitionBy(*groups).orderBy("_prefix")
            .rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = materialize(
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .filter((F.col("_upto") > F.col("_size"))
                & (F.col("_upto") - F.col("_n") <= F.col("_size")))
        .select(*groups, F.col("_prefix").alias("_cut"),
                (F.col("_size") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    # only pairs that share the prefix of the cut are ranked
    shared = narrow.join(cut, groups) if groups else narrow.withColumns(
        {c: cut.agg(F.max(c)).scalar() for c in ("_cut", "_need")})
    order = W.partitionBy(*groups).orderBy("_d", "_k")
    last = shared.filter(F.col("_prefix") == F.col("_cut")).withColumn("_rank", F.row_number().over(order)).filter(
        F.col("_rank") == F.col("_need"))
    # a quota that ends where a prefix begins has no pair in it; the bare prefix sorts before all of them
    bare = cut.filter("_need = 0").select(*groups, F.struct(
        F.col("_cut").alias("d"), F.lit(None).cast(df.schema[key].dataType).alias("k")).alias("_limit"))
    limits = last.select(*groups, F.struct(F.col("_d").alias("d"), F.col("_k").alias("k")).alias("_limit")).unionByName(bare)
    # groups whose quota covers all of their rows have no limit; at most one row per group
    marked = df.join(materialize(limits), groups, "left") if groups else df.withColumn("_limit", materialize(limits).select("_limit").scalar())
    d, k = F.col(digest), F.col(key)
    inside = (F.col("_limit").isNull() | (d < F.col("_limit.d"))
              | ((d == F.col("_limit.d")) & F.coalesce(k <= F.col("_limit.k"), F.lit(False))))
    return marked, inside
