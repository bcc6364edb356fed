"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores. Every query is written in full
to the no-op sink, ``BENCH_RUNS`` times (fewer if it is long), and the median counts. Outside the clock: start of the session, CSV text,
documents and the two standardised spaces (cohort moments and z-scores of all rows), which are built before. The staging
layer, overrides and the canonical layer are landed first, as entries of their own. ``knn_tree_all`` is the search of every
entity over cohorts that span many leaves; it also reports how many of all (target, candidate) combinations were searched.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from stintworks.fixtures import adapter
from stintworks.fixtures.registry import QUERIES
from stintworks.operators.cohorts import COHORT
from stintworks.operators.similarity import neighbours, searched_share
from stintworks.workspace import scope

HEADLINE = [
    "canonical_resolved", "canonical_source_key", "intelligence_base", "season_analysis", "override_build",
    "explore_eligible_page", "resolve_requests", "suggestions", "profile", "cohort_moments", "zscores",
    "knn_euclidean", "knn_cosine", "metric_ranks", "candidate_diagnostic", "explain_euclidean", "similar_requests",
    "role_overlap", "season_csv_batches", "api_stats", "merge_update", "latest_document",
    "knn_manhattan", "knn_role", "knn_pooled_cohort", "embedding_knn", "explore_deep_page",
    "explain_requests", "constraint_fk", "cascade_delete",
]
# Rows of a chunk at which the pooled cohorts of the bench tables span many leaves.
TREE_CHUNK = 512
# Seconds after which a query is not run again.
LONG = 6


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()  # start-up is not part of any query
    seconds: dict[str, float] = {}

    def timed(name: str, work, runs: int = 1) -> None:
        took = []
        while len(took) < runs and sum(took) < LONG:
            start = time.perf_counter()
            work()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)

    timed("staging", lambda: adapter.stints(spark, sf_dir))
    timed("overrides", lambda: adapter.overrides(spark, sf_dir))
    timed("canonical_layer", lambda: adapter.canonical_layer(spark, sf_dir))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    adapter.season_csv_source(spark, sf_dir)
    adapter.api_documents(spark, sf_dir)
    for cohort in (COHORT, ("position_group",)):
        adapter.similarity_space(spark, sf_dir, cohort)
    with scope(spark):
        pooled = adapter.similarity_space(spark, sf_dir, ("position_group",))
        timed("knn_tree_all", lambda: neighbours(pooled, k=10, chunk_rows=TREE_CHUNK).write.format("noop").mode("overwrite").save())
        share = searched_share(pooled, 10, TREE_CHUNK)
    for name in HEADLINE:
        with scope(spark):
            timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save(), runs)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "knn_tree_searched_share": share,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
