"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from cohortry.plans import inputs
from cohortry.plans.catalog import QUERIES
from cohortry.session import local_session

HEADLINE = [
    "s1_users_raw", "flagship_segment_persistence", "a10_milestone_sequences",
    "j7_sequence_write_back", "a6_persistence_cuts", "a9_feature_summary", "a17_data_health",
    "a25_top_share", "w3_percentile_ranks", "j2_users_enriched", "j5_enrichment",
    "j9_country_crosswalk", "e1_w4_stratified_draws", "e7_bootstrap_weights",
    "m7_partial_correlations", "m8_curve_fits", "m20_auc", "m27_silhouette_squared",
    "m28_davies_bouldin", "m41_kruskal_wallis", "m13_pca_loadings", "m15_factor_loadings",
    "m24_kmeans_overlay", "m37_contextual_tiers", "m21_subsample_blocks",
    "m19_forest_importance", "m36_named_solutions", "m32_bootstrap_stability",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        try:
            run()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # a failed query must not hide the others
            print(f"{name}: {error}", file=sys.stderr)

    timed("layer_users_raw", lambda: inputs.users_raw(spark, sf_dir))
    timed("layer_features_and_labels", lambda: inputs.users_labelled(spark, sf_dir))
    timed("layer_enrichment", lambda: inputs.enrichment(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).collect())
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus}))


if __name__ == "__main__":
    main()
