"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # relational
    "sales_by_customer", "sales_by_state", "sales_densified_category_customer", "cross_top_report", "sales_cube",
    "overall_likes", "friends_of_friends_likes", "weighted_recommend", "points_table", "beaten_only_by_leaders",
    # time, geometry, selection
    "level_stats", "traffic_share", "modelling_grid", "special_event_flags", "cumulative_segment_pct", "select_chain_segments",
    "path_bridge", "entity_timeline", "segments_near_point",
    # text
    "top_kmers", "tokenize_documents", "relative_popularity", "ppmi", "tfidf", "multinomial_nb", "bernoulli_nb", "text_shape",
    # profiling and layout
    "profile_text", "tail_quantiles", "order_price_cdf", "label_encode", "pivot_profile", "zscore",
    # linear algebra, neighbours, evaluation
    "nan_covariance", "project_residuals", "overlap_significance", "box_count_dimension", "nearest_in_space", "cosine_neighbours",
    "knn_euclidean", "metrics_by_cluster", "stratified_folds", "least_squares",
    # models and clusters
    "gaussian_generative", "gaussian_nb", "decision_tree", "kmeans_inertia", "cluster_density", "cluster_profiles",
    # more neighbours, streaming
    "closest_pairs", "knn_manhattan", "spectral_order", "stream_scoreboard", "stream_time_buckets",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from sparkloom.plans.catalog import load
    from sparkloom.plans.registry import Tables
    from sparkloom.runtime import clear_scratch
    from sparkloom.session import get_spark

    spark = get_spark("bench", f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                      **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    catalog = load()
    tables = Tables(spark, folder, spread=int(cpus) if cpus.isdigit() else None)  # each table here is one file
    tables.lineitem.count()  # start-up is not part of any query
    times = {}
    only = sys.argv[1:]
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        catalog[name].run(tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder).replace("sf", "")}))


if __name__ == "__main__":
    main()
