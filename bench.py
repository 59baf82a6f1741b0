"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores, BENCH_QUERIES an optional
comma-separated list of queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "block_class_counts",
    "label_balance",
    "block_distance_profiles",
    "distance_quantiles_by_fold",
    "snake_fold_assignment",
    "fold_calibration",
    "weighted_pool_draw",
    "dataset_report",
    "tile_gather",
    "multi_year_assembly",
    "neighbourhood_feature_table",
    "distance_to_development",
    "local_density",
    "pixels_in_polygons",
    "tiles_near_polygons",
    "score_curves",
    "rank_metrics",
    "reliability_table",
    "decile_precision_recall",
    "exact_silhouette",
    "squared_silhouette",
    "wide_feature_table",
    "swap_fold_acceptance",
    "boosted_tree_fold",
    "out_of_fold_predictions",
    "block_clusters",
    "cluster_report",
    "lineitem_price_quantiles",
    "partitioned_sink_roundtrip",
]


def main() -> None:
    from terrashift.plans import catalog  # noqa: F401
    from terrashift.plans.registry import QUERIES
    from terrashift.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "terrashift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
