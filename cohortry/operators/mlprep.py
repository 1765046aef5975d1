"""Feature matrices: filling, dummies, scaling, weighting and volume compression."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators.ranks import percent_rank_average, quantiles, to_long


def filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def require(df: DataFrame, features: list[str], allow_missing: bool = False) -> list[str]:
    """The features ``df`` has; a missing one is an error unless allowed."""
    missing = [f for f in features if f not in df.columns]
    if missing and not allow_missing:
        raise ValueError(f"missing features: {missing}")
    return [f for f in features if f not in missing]


# --- one-hot --------------------------------------------------------------------------


def categories(train: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted values of each categorical column in the training rows.

    Meant for labels with a fixed short list (clusters, age groups).
    """
    found = train.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).head()
    return {c: list(found[c]) for c in columns}


def dummy_name(column: str, value: str) -> str:
    return f"{column}_{value}"


def feature_matrix(df: DataFrame, continuous: list[str], levels: dict[str, list[str]],
                   keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Nulls as zero and dummies without the first level; levels come from training."""
    columns = {c: filled(c) for c in require(df, continuous)}
    for column, values in levels.items():
        for value in values[1:]:
            hit = F.coalesce(F.col(column) == value, F.lit(False))
            columns[dummy_name(column, value)] = hit.cast("double")
    out = df.select(*keep, *[e.alias(n) for n, e in columns.items()])
    return out, list(columns)


# --- scaling --------------------------------------------------------------------------


def _scaled(df: DataFrame, features: list[str], centre: list[Column], width: list[Column],
            fit_on: DataFrame | None = None) -> DataFrame:
    """(x - centre) / width with one scalar lookup; a zero width counts as one."""
    source = df if fit_on is None else fit_on
    stats = source.agg(F.struct(*[e.alias(f"c{i}") for i, e in enumerate(centre)],
                            *[e.alias(f"w{i}") for i, e in enumerate(width)]))
    out = df.withColumn("_stats", stats.scalar())
    scaled = {}
    for i, name in enumerate(features):
        w = F.col(f"_stats.w{i}")
        scaled[name] = (filled(name) - F.col(f"_stats.c{i}")) / F.when(w == 0, 1.0).otherwise(w)
    return out.withColumns(scaled).drop("_stats")


def standardize(df: DataFrame, features: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation, measured on ``fit_on`` (default: all rows)."""
    return _scaled(df, features, [F.avg(filled(f)) for f in features],
                   [F.stddev_pop(filled(f)) for f in features], fit_on)


def min_max(df: DataFrame, features: list[str]) -> DataFrame:
    return _scaled(df, features, [F.min(filled(f)) for f in features],
                   [F.max(filled(f)) - F.min(filled(f)) for f in features])


def robust(df: DataFrame, features: list[str]) -> DataFrame:
    """Median and interquartile range, exact."""
    ready = df.withColumns({f: filled(f) for f in features})
    found = quantiles(to_long(ready, [], features), ["feature"], "value",
                      {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = found.agg(F.struct(
        *[F.max(F.when(F.col("feature") == f, F.col("q2"))).alias(f"c{i}")
          for i, f in enumerate(features)],
        *[F.max(F.when(F.col("feature") == f, F.col("q3") - F.col("q1"))).alias(f"w{i}")
          for i, f in enumerate(features)]))
    out = ready.withColumn("_stats", wide.scalar())
    scaled = {
        f: (F.col(f) - F.col(f"_stats.c{i}"))
        / F.when(F.col(f"_stats.w{i}") == 0, 1.0).otherwise(F.col(f"_stats.w{i}"))
        for i, f in enumerate(features)}
    return out.withColumns(scaled).drop("_stats")


def mean_of_z(df: DataFrame, features: list[str], name: str, sign: float = -1.0,
              floor: float = 0.001) -> DataFrame:
    """Signed mean of z-scores over ``df``'s rows; deviations are floored."""
    stats = df.agg(F.struct(*[F.avg(filled(f)).alias(f"m{i}") for i, f in enumerate(features)],
                            *[F.stddev_samp(filled(f)).alias(f"s{i}") for i, f in enumerate(features)]))
    scored = df.withColumn("_stats", stats.scalar())
    z = [(filled(f) - F.col(f"_stats.m{i}")) / F.greatest(F.col(f"_stats.s{i}"), F.lit(floor))
         for i, f in enumerate(features)]
    return scored.withColumn(name, X.total(z) / len(features) * sign).drop("_stats")


# --- weighting and compression --------------------------------------------------------


def weights(features: list[str], strategy: str) -> dict[str, float]:
    """Weight of each feature under a named strategy."""
    constructs = {f: C.construct_of(f) for f in features}
    if strategy == "equal_construct":
        sizes = list(constructs.values())
        return {f: 1.0 / sizes.count(c) for f, c in constructs.items()}
    table = C.WEIGHT_BY_CONSTRUCT["sqrt_volume" if strategy == "volume_x0.7" else strategy]
    return {f: table.get(c, 1.0) for f, c in constructs.items()}


def apply_weights(df: DataFrame, features: list[str], strategy: str) -> DataFrame:
    return df.withColumns({f: F.col(f) * w for f, w in weights(features, strategy).items()})


def compress_volume(df: DataFrame, features: list[str], method: str, key: str = "USER_ID",
                    cap: float = 0.95) -> DataFrame:
    """Volume features by log1p (raw ones only), sqrt, rank share, or capped at a quantile."""
    volume = [f for f in features if C.construct_of(f) == "Volume"]
    if method == "log":
        return df.withColumns({f: F.log1p(X.clip(f, lower=0.0)) for f in volume
                               if not f.startswith("log_")})
    if method == "sqrt":
        return df.withColumns({f: F.sqrt(X.clip(f, lower=0.0)) for f in volume})
    if method == "rank":
        ranks = percent_rank_average(df, key, volume)
        return df.drop(*volume).join(ranks, key)
    if method == "winsor":
        found = quantiles(to_long(df, [], volume), ["feature"], "value", {"cap": cap})
        caps = found.agg(F.map_from_entries(F.collect_list(F.struct("feature", "cap"))))
        return df.withColumn("_caps", caps.scalar()).withColumns(
            {f: F.least(F.col(f), F.col("_caps")[f]) for f in volume}).drop("_caps")
    raise ValueError(f"unknown compression {method!r}")


def assemble(df: DataFrame, features: list[str], keep: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=name).transform(df).select(*keep, name)
