"""Clustering experiments over whole grids, named solutions, stability and cluster counts.

Fits have no SQL form. Each experiment therefore has a query of totals next to it: rows and
outcomes add up over the clusters of a fit, and what lies within and between its clusters
is the scatter of the whole, which SQL works out from the users.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortry import config as C
from cohortry.operators import (batched as B, cluster as K, evaluate as E, grid as G, labels, mlprep as MP,
                                sampling as M, stats as ST)
from cohortry.operators.experiments import KEEP
from cohortry.operators.ranks import hash_key, hash_uniform
from cohortry.plans import inputs as I
from cohortry.plans.models import contributors, population
from cohortry.plans.registry import query
from cohortry.plans.sql_base import sql, tier_d
from cohortry.session import materialize

GRID_FEATURES = list(dict.fromkeys(f for features in C.FEATURE_SETS.values() for f in features))
COMPRESSED = [f"{f}~{m}" for m in G.COMPRESSIONS[1:] for f in C.FEATURE_SETS["combined_full"]
              if C.construct_of(f) == "Volume"]


def labelled_contributors(spark, sf):
    """Contributors with ``y``, at or above their own median."""
    return I.layer(spark, sf, "labelled_contributors",
                   lambda: labels.group_median_label(contributors(spark, sf), []))


def _vectors(spark, sf, name, features, build) -> G.Vectors:
    return G.vectors_of(I.layer(spark, sf, name, build), features)


def grid_vectors(spark, sf) -> G.Vectors:
    names = GRID_FEATURES + COMPRESSED
    return _vectors(spark, sf, "grid_vectors", names, lambda: G.standard_rows(materialize(
        G.with_compressions(labelled_contributors(spark, sf), GRID_FEATURES)), names, "y"))


def cluster_vectors(spark, sf) -> G.Vectors:
    """All tier D users on the fifteen cluster features, with their tenure weight."""
    return _vectors(spark, sf, "cluster_vectors", C.CLUSTER_FEATURES, lambda: G.standard_rows(
        population(spark, sf), C.CLUSTER_FEATURES, row_weights=[F.col("tenure_weight")]))


# --- grids --------------------------------------------------------------------------------


def grid_results(spark, sf) -> DataFrame:
    return I.layer(spark, sf, "grid_results", lambda: G.clustering_grid(grid_vectors(spark, sf), C.FEATURE_SETS))


def best_sets(spark, sf, count: int = 3) -> dict[str, tuple[list[str], str]]:
    """The feature sets with the best cell, each with that cell's weighting."""
    order = [F.desc("composite_score"), "feature_set", "weighting", "method", "k"]
    rows = grid_results(spark, sf).orderBy(*order).select("feature_set", "weighting").collect()
    first = {}
    for row in rows:
        first.setdefault(row.feature_set, row.weighting)
    return {name: (C.FEATURE_SETS[name], first[name]) for name in list(first)[:count]}


def rotation_results(spark, sf) -> DataFrame:
    return I.layer(spark, sf, "rotation_results", lambda: G.rotation_experiment(
        grid_vectors(spark, sf), best_sets(spark, sf)))


def guided_results(spark, sf) -> DataFrame:
    return I.layer(spark, sf, "guided_results", lambda: G.guided_experiment(
        grid_vectors(spark, sf), {n: f for n, (f, _) in best_sets(spark, sf).items()}))


def compression_results(spark, sf) -> DataFrame:
    return I.layer(spark, sf, "compression_results", lambda: G.compression_experiment(
        grid_vectors(spark, sf), C.FEATURE_SETS["combined_full"]))


def _measures(df: DataFrame) -> DataFrame:
    return df.drop("n_users", "n_persistent", "within_ss", "between_ss", "total_ss")


def _totals(df: DataFrame, *keys: str) -> DataFrame:
    """Cells with the rows, outcomes and scatter that their clusters add up to."""
    return df.select(*keys, F.col("n_users").cast("long").alias("n_users"), F.col("n_persistent").cast("long").alias("n_persistent"),
                     F.round(F.col("within_ss") + F.col("between_ss"), 6).alias("total_ss"))


_CONTRIBUTORS = f"""
, joined AS (SELECT u.*, e.* EXCLUDE (iso3_code) FROM users_labelled u LEFT JOIN enrichment e USING (iso3_code)
             WHERE {tier_d(2)}),
d AS (SELECT *, CAST(persistence_c >= median(persistence_c) OVER () AS INTEGER) AS y FROM joined),
size AS (SELECT count(*) AS n, sum(y) AS n1 FROM d)"""


def _volume_sql(f: str, method: str) -> str:
    x = f"coalesce({f}, 0)::DOUBLE"
    if method == "log" and not f.startswith("log_"):
        return f"ln(1 + greatest({x}, 0))"
    return f"sqrt(greatest({x}, 0))" if method == "sqrt" else x


def _varying(features: list[str], method: str = "none") -> str:
    """Rows (feature, varies): whether a feature has any variance."""
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, coalesce(stddev_pop({_volume_sql(f, method if C.construct_of(f) == 'Volume' else 'none')}), 0) > 0 AS varies FROM d"
        for f in features)


def _weight_rows(sets: dict[str, list[str]], weightings: list[str]) -> str:
    return ", ".join(f"('{n}', '{s}', '{f}', {w!r}::DOUBLE)" for n, features in sets.items() for s in weightings
                     for f, w in MP.weights(features, s).items())


_GRID_SQL = sql("all", f"""{_CONTRIBUTORS},
varying AS ({_varying(GRID_FEATURES)}),
weights(feature_set, weighting, feature, weight) AS (VALUES {_weight_rows(C.FEATURE_SETS, C.WEIGHTINGS)}),
scatter AS (SELECT feature_set, weighting, sum(CASE WHEN varies THEN weight * weight ELSE 0 END) AS share
            FROM weights JOIN varying USING (feature) GROUP BY ALL)
SELECT feature_set, weighting, method, k, n AS n_users, CAST(n1 AS BIGINT) AS n_persistent, round(n * share, 6) AS total_ss
FROM scatter, size, (VALUES ('kmeans'), ('gmm'), ('agglomerative')) m(method), range(3, 9) r(k)""")


@query("m35_clustering_grid")
def grid(spark, sf):
    """Six feature sets, five weightings, three methods and six k: 540 cells, ten starts each."""
    return _measures(grid_results(spark, sf))


@query("m35_grid_totals", _GRID_SQL)
def grid_totals(spark, sf):
    return _totals(grid_results(spark, sf), "feature_set", "weighting", "method", "k")


@query("m35_rotation_experiment")
def rotations(spark, sf):
    """Five rotations of the three best feature sets, 5, 7 and 10 components, two methods, three k."""
    return _measures(rotation_results(spark, sf))


@query("m35_guided_experiment")
def guided(spark, sf):
    """3 to 6 components next to the discriminant axis, two methods, three k."""
    return _measures(guided_results(spark, sf))


@query("m35_compression_experiment")
def compressions(spark, sf):
    """Five compressions of the full set, three weightings, two methods, three k."""
    return _measures(compression_results(spark, sf))


_COMPRESSIONS_SQL = sql("all", f"""{_CONTRIBUTORS},
varying AS ({" UNION ALL ".join(f"SELECT '{m}' AS compression, * FROM ({_varying(C.FEATURE_SETS['combined_full'], m)})" for m in ("none", "log", "sqrt"))}),
weights(feature_set, weighting, feature, weight) AS (VALUES {_weight_rows({"combined_full": C.FEATURE_SETS["combined_full"]}, ["uniform", "equal_construct", "downweight_volume"])}),
scatter AS (SELECT compression, weighting, sum(CASE WHEN varies THEN weight * weight ELSE 0 END) AS share
            FROM weights JOIN varying USING (feature) GROUP BY ALL)
SELECT compression, weighting, method, k, n AS n_users, CAST(n1 AS BIGINT) AS n_persistent, round(n * share, 6) AS total_ss
FROM scatter, size, (VALUES ('kmeans'), ('gmm')) m(method), range(4, 7) r(k)""")


@query("m35_compression_totals", _COMPRESSIONS_SQL)
def compression_totals(spark, sf):
    """Ranks and capped values have their own tests; the other compressions add up here."""
    found = compression_results(spark, sf).filter(F.col("compression").isin("none", "log", "sqrt"))
    return _totals(found, "compression", "weighting", "method", "k")


_ROTATION_SQL = sql("all", f"""{_CONTRIBUTORS}
SELECT n AS n_users, CAST(n1 AS BIGINT) AS n_persistent, 270 AS rotation_cells, 72 AS guided_cells, TRUE AS adds_up
FROM size""")


@query("m35_rotation_totals", _ROTATION_SQL)
def rotation_totals(spark, sf):
    """Cells of the rotated and guided spaces; in each, within and between are the whole scatter."""
    gap = F.abs(F.col("within_ss") + F.col("between_ss") - F.col("total_ss")) <= 1e-6 * F.greatest(F.col("total_ss"), F.lit(1.0))
    kinds = [df.select(F.lit(name).alias("kind"), "n_users", "n_persistent", gap.alias("same"))
             for name, df in (("rotation", rotation_results(spark, sf)), ("guided", guided_results(spark, sf)))]
    return kinds[0].unionByName(kinds[1]).agg(
        F.max("n_users").cast("long").alias("n_users"), F.max("n_persistent").cast("long").alias("n_persistent"),
        F.count_if(F.col("kind") == "rotation").alias("rotation_cells"), F.count_if(F.col("kind") == "guided").alias("guided_cells"),
        (F.bool_and("same") & (F.min("n_users") == F.max("n_users"))
         & (F.min("n_persistent") == F.max("n_persistent"))).alias("adds_up"))


@query("o2_best_configurations")
def best_configurations(spark, sf):
    """The best cells by composite score: 20 of the grid, 10 at k = 5, 10 of each other experiment, 20 overall."""
    cells = {"grid": grid_results(spark, sf), "rotation": rotation_results(spark, sf),
             "guided": guided_results(spark, sf), "compression": compression_results(spark, sf)}
    names = ["feature_set", "compression", "weighting", "rotation", "n_components"]
    kinds = {"n_components": "int"}
    shared = {e: df.select(F.lit(e).alias("experiment"), *[
        (F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in names],
        "method", "k", "n_clusters", "silhouette_squared", "cramers_v", "composite_score") for e, df in cells.items()}
    order = [F.desc("composite_score"), "experiment", *names, "method", "k"]

    def top(title: str, df: DataFrame, count: int) -> DataFrame:
        return df.orderBy(*order).limit(count).withColumn("ranking", F.lit(title))

    lists = [top("grid", shared["grid"], 20), top("grid at k = 5", shared["grid"].filter("n_clusters = 5"), 10)]
    lists += [top(e, shared[e], 10) for e in ("rotation", "guided", "compression")]
    lists.append(top("overall", reduce(DataFrame.unionByName, shared.values()), 20))
    return reduce(DataFrame.unionByName, lists)


# --- named solutions ----------------------------------------------------------------------


def solution_vectors(spark, sf) -> G.Vectors:
    """Contributors on the features of the named solutions, with ten resamples of exactly n users."""
    columns = ["USER_ID", "y", *G.SOLUTION_FEATURES]
    return _vectors(spark, sf, "solution_vectors", G.SOLUTION_FEATURES, lambda: G.standard_rows(
        materialize(M.with_bootstraps(labelled_contributors(spark, sf).select(*columns), C.BOOTSTRAPS)),
        G.SOLUTION_FEATURES, "y", row_weights=[F.col("bootstraps")[b] for b in range(C.BOOTSTRAPS)]))


def solution_results(spark, sf) -> tuple[DataFrame, DataFrame, list[str]]:
    vectors, found = solution_vectors(spark, sf), []

    def run():
        if not found:
            found.append(G.named_solutions(vectors))
        return found[0]

    names = [f"{n}_k{k}" for n in G.SOLUTIONS for k in (5, 6)]
    quality = I.layer(spark, sf, "solution_quality", lambda: run()[0])
    return quality, I.layer(spark, sf, "solution_labels", lambda: run()[1]), names


@query("m36_named_solutions")
def solutions(spark, sf):
    """Three named solutions and the tier reference at k = 5 and 6."""
    return _measures(solution_results(spark, sf)[0])


@query("m36_solution_totals", sql("all", f"""{_CONTRIBUTORS}
SELECT s AS solution, k, n AS n_users, CAST(n1 AS BIGINT) AS n_persistent, TRUE AS adds_up
FROM size, (VALUES {", ".join(f"('{n}')" for n in G.SOLUTIONS)}) v(s), range(5, 7) r(k)"""))
def solution_totals(spark, sf):
    gap = F.abs(F.col("within_ss") + F.col("between_ss") - F.col("total_ss")) <= 1e-6 * F.greatest(F.col("total_ss"), F.lit(1.0))
    return solution_results(spark, sf)[0].select(
        "solution", "k", F.col("n_users").cast("long").alias("n_users"), F.col("n_persistent").cast("long").alias("n_persistent"),
        gap.alias("adds_up"))


@query("m36_solution_profiles")
def solution_profiles(spark, sf):
    """Profile and persona of every cluster of every named solution."""
    _, placed, names = solution_results(spark, sf)
    needed = dict.fromkeys(["USER_ID", "persist_median", "persistence_c", "ACCOUNT_TYPE", *C.PROFILE_FEATURES])
    users = contributors(spark, sf).select(*needed).join(placed.withColumnRenamed("key", "USER_ID").select("USER_ID", *names), "USER_ID")
    users = materialize(users)
    parts = []
    for name in names:
        part = E.personas_by_level(E.cluster_profile(users.withColumnRenamed(name, "cluster"), ["cluster"], C.PROFILE_FEATURES))
        parts.append(part.withColumn("solution", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query("m32_bootstrap_stability")
def bootstrap(spark, sf):
    """Every named solution refitted on ten resamples: agreement, silhouette and V."""
    return G.bootstrap_stability(solution_vectors(spark, sf), C.BOOTSTRAPS)


# --- single fits on the cluster features --------------------------------------------------


def _space(vectors: G.Vectors) -> list[np.ndarray]:
    return [np.eye(len(vectors.names))]


@query("m24_kmeans_overlay")
def kmeans(spark, sf):
    """Tenure-weighted k-means with ten starts, and persistence per cluster."""
    features = C.CLUSTER_FEATURES
    users = population(spark, sf)
    keep = [*KEEP, "tenure_weight", "persistence_c"]
    data = materialize(MP.assemble(MP.standardize(users.select(*keep, *features), features), features, [*keep, *features]))
    found = K.fit_kmeans(data, 5, weight="tenure_weight").transform(data)
    return E.persistence_overlay(found, ["cluster"])


@query("m24_mini_batch")
def mini_batch(spark, sf):
    """Centres of keyed mini-batches next to a whole fit's cost on the same rows."""
    vectors = cluster_vectors(spark, sf)
    space = _space(vectors)
    start = B.KMeansFit(0, 5)
    B.seed_centres(vectors.rows, space, [start])
    centres, seen = B.mini_batch_kmeans(vectors.rows, space[0], start.centres, batches=10, rounds=3)
    small = B.evaluate(vectors.rows, space, [B.Solution(0, 5, centres=centres)])[0]
    whole = B.best_of(B.kmeans(vectors.rows, space, [B.KMeansFit(0, 5, start=i) for i in range(G.RESTARTS)]))[(0, 5, None)]
    rows = [(c, int(seen[c]), int(small.sizes[c]), *(float(v) for v in centres[c]), small.within / whole.cost) for c in range(5)]
    features = ", ".join(f"{f} double" for f in C.CLUSTER_FEATURES)
    return spark.createDataFrame(rows, f"cluster int, rows_seen long, n long, {features}, cost_to_whole_fit double")


@query("m25_gaussian_mixture")
def mixture(spark, sf):
    """Full-covariance mixtures of 3 to 8 components from five starts each."""
    vectors = cluster_vectors(spark, sf)
    space = _space(vectors)
    starts = B.kmeans(vectors.rows, space, [B.KMeansFit(0, k, start=i) for k in C.CLUSTER_K for i in range(G.MIXTURE_STARTS)])
    fits = B.mixtures(vectors.rows, space, [B.MixtureFit(0, f.k, None, f.start, f.centres) for f in starts])
    rows = []
    for k in C.CLUSTER_K:
        best = max((f for f in fits if f.k == k), key=lambda f: f.likelihood)
        bic, aic = B.information_criteria(best, vectors.moments.n)
        rows.append((k, float(best.likelihood), round(float(bic), 4), round(float(aic), 4)))
    return spark.createDataFrame(rows, "k int, mean_log_likelihood double, bic double, aic double")


@query("m26_two_stage_ward")
def ward(spark, sf):
    vectors = cluster_vectors(spark, sf)
    cells = [G.Cell((), 0, "agglomerative", k) for k in C.CLUSTER_K]
    solutions = G.fit_cells(vectors.rows, _space(vectors), cells)
    rows = [(s.k, c, int(n)) for s, q in zip(solutions, B.evaluate(vectors.rows, _space(vectors), solutions))
            for c, n in enumerate(q.sizes)]
    return spark.createDataFrame(rows, "k int, cluster int, n long")


@query("m29_cluster_count_sweep")
def sweep(spark, sf):
    vectors = cluster_vectors(spark, sf)
    cells = [G.Cell((), 0, "kmeans", k) for k in C.CLUSTER_K]
    solutions = G.fit_cells(vectors.rows, _space(vectors), cells)
    rows = [(s.k, round(q.within, 4), round(q.silhouette, 4))
            for s, q in zip(solutions, B.evaluate(vectors.rows, _space(vectors), solutions))]
    table = spark.createDataFrame(rows, "k int, inertia double, silhouette_squared double")
    best = table.agg(F.max_by("k", F.struct("silhouette_squared", -F.col("k")))).scalar()
    return table.withColumn("selected", F.col("k") == best)


@query("m43_scale_up")
def scale_up(spark, sf):
    """Centres from a sample label everyone; agreement with a fit on everyone."""
    vectors = cluster_vectors(spark, sf)
    sample = materialize(M.simple_sample(vectors.rows, 10_000, key="key"))
    fits = [B.best_of(B.kmeans(rows, _space(vectors), [B.KMeansFit(0, 5, start=i) for i in range(G.RESTARTS)]))[(0, 5, None)]
            for rows in (sample, vectors.rows)]
    placed = B.place(vectors.rows, _space(vectors), {"sample_cluster": B.Solution.of(fits[0]), "cluster": B.Solution.of(fits[1])})
    return ST.adjusted_rand(placed, "sample_cluster", "cluster")


GAP_KS, GAP_REFERENCES = tuple(range(1, 9)), 10


def gap_rows(spark, sf) -> DataFrame:
    """Users next to ten uniform points each, drawn in the box of the users by hashes of their key."""
    users = materialize(MP.standardize(population(spark, sf).select("USER_ID", *C.CLUSTER_FEATURES), C.CLUSTER_FEATURES))
    ends = users.agg(F.struct(*[F.min(f).alias(f"a{i}") for i, f in enumerate(C.CLUSTER_FEATURES)],
                              *[F.max(f).alias(f"b{i}") for i, f in enumerate(C.CLUSTER_FEATURES)]))
    points = {f"{f}#{b}": F.col(f"_e.a{i}") + (F.col(f"_e.b{i}") - F.col(f"_e.a{i}")) * hash_uniform(hash_key("USER_ID", 1000 * b + i))
              for b in range(GAP_REFERENCES) for i, f in enumerate(C.CLUSTER_FEATURES)}
    placed = users.withColumn("_e", ends.scalar()).withColumns(points)
    return B.vector_rows(placed.withColumn("y", F.lit(0)), [*C.CLUSTER_FEATURES, *points], "y")


def gap_fits(spark, sf) -> tuple[G.Vectors, dict[tuple[int, int], B.KMeansFit]]:
    """The best fit of every k on the users (space 0) and on each reference."""
    names = [*C.CLUSTER_FEATURES, *[f"{f}#{b}" for b in range(GAP_REFERENCES) for f in C.CLUSTER_FEATURES]]
    vectors = _vectors(spark, sf, "gap_rows", names, lambda: gap_rows(spark, sf))
    spaces = [vectors.pick(C.CLUSTER_FEATURES)] + [vectors.pick([f"{f}#{b}" for f in C.CLUSTER_FEATURES]) for b in range(GAP_REFERENCES)]
    fits = B.kmeans(vectors.rows, spaces, [B.KMeansFit(s, k, start=i) for s in range(len(spaces)) for k in GAP_KS
                                           for i in range(G.RESTARTS if k > 1 else 1)])
    return vectors, {(s, k): f for (s, k, _), f in B.best_of(fits).items()}


@query("m44_gap_statistic")
def gap(spark, sf):
    """Dispersion of the users against ten uniform references, k from 1 to 8, all fitted together."""
    _, fits = gap_fits(spark, sf)
    logs = {at: float(np.log(max(f.cost, 1e-12))) for at, f in fits.items()}
    found = []
    for k in GAP_KS:
        references = np.array([logs[s, k] for s in range(1, GAP_REFERENCES + 1)])
        found.append((k, logs[0, k], float(references.mean()), float(references.mean()) - logs[0, k],
                      float(references.std() * np.sqrt(1 + 1 / GAP_REFERENCES))))
    chosen = next((a[0] for a, b in zip(found, found[1:]) if a[3] >= b[3] - b[4]), found[-1][0])
    rows = [(*r, r[0] == chosen) for r in found]
    return spark.createDataFrame(rows, "k int, log_inertia double, log_reference double, gap double, s_k double, selected boolean")


@query("m45_stage_clusters")
def stage_clusters(spark, sf):
    """Clusters inside each funnel stage that tier D has, on features scaled within the stage."""
    users = population(spark, sf)
    features = [f for f in C.CLUSTER_FEATURES if f != "funnel_stage"]
    stages = [r.funnel_stage for r in users.select("funnel_stage").distinct().orderBy("funnel_stage").collect()]
    rows = materialize(B.vector_rows(MP.standardize(users, features), features, weights=[
        (F.col("funnel_stage") == s).cast("double") for s in stages]))
    spaces = []
    for m in B.moments(rows, list(range(len(stages)))):
        spread = np.sqrt(np.maximum(np.diag(m.cov), 0.0))
        spaces.append(np.diag(1.0 / np.where(spread > 1e-9, spread, 1.0)))
    cells = [G.Cell((s,), i, "kmeans", 3, i) for i, s in enumerate(stages)]
    solutions = G.fit_cells(rows, spaces, cells)
    names = [f"s{i}" for i in range(len(stages))]
    placed = B.place(rows, spaces, dict(zip(names, solutions))).withColumnRenamed("key", "USER_ID").drop("y")
    joined = materialize(users.select("USER_ID", "persist_median", "persistence_c", "funnel_stage").join(placed, "USER_ID"))
    own = F.coalesce(*[F.when(F.col("funnel_stage") == s, F.col(n)) for s, n in zip(stages, names)])
    return E.persistence_overlay(joined.withColumn("cluster", own), ["funnel_stage", "cluster"])


@query("m48_country_groups")
def country_groups(spark, sf):
    """Countries grouped by their mean behaviour on all cluster features."""
    features = C.CLUSTER_FEATURES
    means = I.tracked(I.users_labelled(spark, sf)).groupBy("COUNTRY").agg(
        F.count("*").alias("n"), *[F.avg(MP.filled(f)).alias(f) for f in features])
    means = materialize(means)
    rows = materialize(B.vector_rows(MP.standardize(means, features).withColumn("y", F.lit(0)), features, "y", "COUNTRY"))
    best = B.best_of(B.kmeans(rows, [np.eye(len(features))], [B.KMeansFit(0, 4, start=i) for i in range(G.RESTARTS)]))[(0, 4, None)]
    placed = B.place(rows, [np.eye(len(features))], {"cluster": B.Solution.of(best)})
    return placed.withColumnRenamed("key", "COUNTRY").drop("y").join(means.select("COUNTRY", "n"), "COUNTRY").select("COUNTRY", "n", "cluster")
