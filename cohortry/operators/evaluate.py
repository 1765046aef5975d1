"""Quality, overlay, stability and naming of clusters."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, functions as F

from cohortry import config as C
from cohortry.functions import columns as X
from cohortry.operators.mlprep import assemble
from cohortry.session import materialize


def _clean(df: DataFrame, label: str) -> DataFrame:
    """Noise points carry label -1 and stay out of quality measures."""
    return df.filter(F.col(label) >= 0)


def cluster_centres(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Size, centroid and within-cluster scatter per cluster."""
    return _clean(df, label).groupBy(label).agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(f) for f in features]).alias("centre"),
        X.total(F.var_pop(f) * F.count("*") for f in features).alias("within"))


def _distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def calinski_harabasz(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Between over within scatter; totals come from the per-cluster table."""
    centres = cluster_centres(df, features, label)
    size = F.sum("n")
    parts = [F.sum(F.col("n") * F.col("centre")[i] * F.col("centre")[i])
             - F.sum(F.col("n") * F.col("centre")[i]) * F.sum(F.col("n") * F.col("centre")[i]) / size
             for i in range(len(features))]
    k = F.count("*")
    return centres.agg(k.alias("n_clusters"), (
        (X.total(parts) / (k - 1)) / (F.sum("within") / (size - k))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance.

    The k centroids travel as one array, so no pair of rows is ever joined.
    """
    centres = materialize(cluster_centres(df, features, label).select(label, "centre"))
    point = F.array(*[F.col(f).cast("double") for f in features])
    spread = _clean(df, label).join(centres, label).groupBy(label).agg(
        F.avg(_distance(point, F.col("centre"))).alias("spread"))
    each = spread.join(centres, label).agg(
        F.collect_list(F.struct(F.col(label).alias("c"), "centre", "spread")).alias("all"))
    one = each.select("all", F.explode("all").alias("me"))
    worst = F.array_max(F.transform(
        F.filter("all", lambda o: o["c"] != F.col("me.c")),
        lambda o: (F.col("me.spread") + o["spread"]) / _distance(F.col("me.centre"), o["centre"])))
    return one.agg(F.avg(worst).alias("davies_bouldin"))


def silhouette_squared(df: DataFrame, features: list[str], label: str) -> float:
    """Mean silhouette on squared Euclidean distances, exact over all rows."""
    vectors = assemble(_clean(df, label).select(label, *features), features, [label])
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol=label,
                                    distanceMeasure="squaredEuclidean")
    return evaluator.evaluate(vectors)


def silhouette_squared_rows(df: DataFrame, features: list[str], label: str,
                            key: str = "USER_ID") -> DataFrame:
    """Silhouette of every row on squared Euclidean distances, exact at any size.

    The squared distances of a row to a whole cluster add up to n |x|^2 - 2 x S + Q, with
    the cluster's row count, sum and sum of squares, so no pair of rows is formed. A row
    that is its cluster's only one, or has no other cluster, gets 0.
    """
    rows = _clean(df, label).select(key, label, *[F.col(f).cast("double").alias(f) for f in features])
    clusters = rows.groupBy(label).agg(
        F.count("*").alias("n"), F.array(*[F.sum(f) for f in features]).alias("sum"),
        X.total(F.sum(F.col(f) * F.col(f)) for f in features).alias("square")
    ).agg(F.collect_list(F.struct(F.col(label).alias("c"), "n", "sum", "square"))).scalar()
    size = X.total(F.col(f) * F.col(f) for f in features)

    def away(o: Column) -> Column:
        dot = X.total(F.col(f) * o["sum"][i] for i, f in enumerate(features))
        return F.greatest(o["n"] * size - 2 * dot + o["square"], F.lit(0.0))

    own = F.filter("_clusters", lambda o: o["c"] == F.col(label))
    others = F.filter("_clusters", lambda o: o["c"] != F.col(label))
    inside = F.array_max(F.transform(own, lambda o: away(o) / F.greatest(o["n"] - 1, F.lit(1))))
    nearest = F.array_min(F.transform(others, lambda o: away(o) / o["n"]))
    alone = F.array_max(F.transform(own, lambda o: o["n"])) == 1
    value = (nearest - inside) / F.nullif(F.greatest(nearest, inside), F.lit(0.0))
    return rows.withColumn("_clusters", clusters).select(key, label, F.when(
        alone | nearest.isNull(), 0.0).otherwise(F.coalesce(value, F.lit(0.0))).alias("silhouette_squared"))


def persistence_overlay(df: DataFrame, keys: list[str], binary: str = "persist_median",
                        score: str = "persistence_c") -> DataFrame:
    """Size, persistent share and mean score with a 95 % interval per cluster."""
    spread = F.stddev_samp(score)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg(binary) * 100, 4).alias("pct_persistent"),
        F.round(F.avg(score), 6).alias("mean_persistence_c"),
        F.round(1.96 * spread / F.sqrt(F.count("*")), 6).alias("ci95"))


def cluster_profile(df: DataFrame, keys: list[str], features: list[str],
                    digits: int = 3) -> DataFrame:
    """Wide profile of each cluster with its share of all users."""
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("persist_median") * 100, 1).alias("pct_persistent"),
        F.round(F.avg("persistence_c"), 4).alias("mean_persistence_c"),
        F.round(F.stddev_samp("persistence_c"), 4).alias("std_persistence_c"),
        *[F.round(F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))), digits).alias(f"mean_{f}")
          for f in features],
        F.round(F.avg((F.col("ACCOUNT_TYPE") == "Member").cast("double")) * 100, 1).alias("pct_member"),
    ).withColumn("pct_of_total", F.round(F.col("n") * 100.0 / total, 1))


def personas_by_rank(profiles: DataFrame, name: str = "cluster") -> DataFrame:
    """Persona of each cluster relative to the other clusters (one row per cluster)."""
    logins, breadth = "mean_logins_90d", "mean_activity_breadth"
    cuts = profiles.agg(F.struct(
        F.percentile(logins, F.lit(0.8)).alias("l80"), F.percentile(logins, F.lit(0.25)).alias("l25"),
        F.percentile(breadth, F.lit(0.5)).alias("b50"), F.percentile(breadth, F.lit(0.75)).alias("b75")))
    persist = F.col("pct_persistent")
    persona = (
        F.when(F.col(logins) > F.col("_cuts.l80"), "Power Contributors")
        .when((persist > 70) & (F.col(breadth) > F.col("_cuts.b50")), "Steady Engagers")
        .when(persist < 30, "Likely Churners")
        .when(F.col(breadth) > F.col("_cuts.b75"), "Broad Explorers")
        .when(F.col(logins) < F.col("_cuts.l25"), "Minimal Engagers")
        .otherwise(F.concat(F.lit("Mid-Range (Cluster "), F.col(name).cast("string"), F.lit(")"))))
    return profiles.withColumn("_cuts", cuts.scalar()).withColumn("persona", persona).drop("_cuts")


def personas_by_level(profiles: DataFrame) -> DataFrame:
    """Persona of each cluster from fixed levels."""
    persist, breadth = F.col("pct_persistent"), F.col("mean_activity_breadth")
    return profiles.withColumn(
        "persona",
        F.when(F.col("n") < 10, "Micro-cluster (artifact)")
        .when((persist >= 95) & (breadth >= 4), "Power Contributors")
        .when((persist >= 90) & (F.col("mean_logins_90d") >= 15), "Heavy Loggers")
        .when(persist >= 85, "Steady Persisters").when(persist >= 70, "Moderate Engagers")
        .when(persist >= 50, "At-Risk Contributors").otherwise("Likely Churners"))


def normalized_profile(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """Columns divided by their largest value, where that is positive."""
    tops = profiles.agg(F.struct(*[F.max(c).alias(c) for c in columns]))
    out = profiles.withColumn("_top", tops.scalar())
    return out.withColumns({
        c: F.when(F.col(f"_top.{c}") > 0, F.col(c) / F.nullif(F.col(f"_top.{c}"), F.lit(0.0)))
        .otherwise(F.col(c)) for c in columns}).drop("_top")


def degenerate_clusters(profiles: DataFrame, keys: list[str],
                        minimum: int = C.DEGENERATE_CLUSTER) -> DataFrame:
    return profiles.groupBy(*keys).agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col("n") < minimum).alias("n_degenerate"))


def verdict(evidence: DataFrame) -> DataFrame:
    """Reading of each piece of evidence against its thresholds.

    ``evidence`` has (kind, value, other); ``other`` is the rival value or null.
    """
    kind, value, other = F.col("kind"), F.col("value"), F.col("other")
    behaviour, context = F.lit("H1"), F.lit("H0")
    reading = (
        F.when((kind == "loading_share") & (value >= 60), behaviour)
        .when((kind == "loading_share") & (value <= 40), context)
        .when((kind == "incremental_r2") & (value > 2 * other), behaviour)
        .when((kind == "incremental_r2") & (other > 2 * value), context)
        .when((kind == "cramers_v") & (value > 0.3), behaviour)
        .when((kind == "cramers_v") & (value < 0.1), context)
        .when((kind == "auc_range") & (value < 0.05), behaviour)
        .when((kind == "auc_range") & (value > 0.10), context)
        .otherwise("mixed"))
    return evidence.withColumn("verdict", reading)
