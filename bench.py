"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local threads. Each query
is run whole (all output rows are produced and dropped). Stored tables that queries
read, such as the lexical index, are written first and timed on their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shortlist.storage import SETTINGS  # noqa: E402
from shortlist.plans.jobs import prefetch  # noqa: E402
from workload import QUERIES  # noqa: E402
from workload.views import tables  # noqa: E402

#: tables that queries read from storage, in the order they build on each other
STORED = [
    "positives",
    "queries",
    "postings",
    "doc_stats",
    "blocks",
    "vocabulary",
    "word_vectors",
    "index",
    "candidates",
    "feature_tables",
]

HEADLINE = [
    "build_postings",
    "bm25_search",
    "evaluate_bm25",
    "hierarchical_encoder",
    "dense_prefetch",
    "generate_candidates",
    "evaluate_prefetch",
    "knn",
    "knn_grid",
    "knn_int8",
    "encode_sequences",
    "training_samples",
    "triplet_loss",
    "rerank",
    "evaluate_rerank",
    "evaluate_two_stage",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    tables_of = tables(spark, folder)
    for name in STORED:
        started = time.perf_counter()
        getattr(tables_of, name)
        seconds[f"store_{name}"] = round(time.perf_counter() - started, 3)
        print(f"store_{name}", seconds[f"store_{name}"], file=sys.stderr, flush=True)
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    if len(sys.argv) == 1:
        # throughput: every conversation turn as a query, lists of 2000
        started = time.perf_counter()
        found = prefetch(tables_of.turns, tables_of.dense, 2000)
        found.write.format("noop").mode("overwrite").save()
        seconds["turns_top_2000"] = round(time.perf_counter() - started, 3)
        n_turns = tables_of.turns.count()
        per_query = round(1000 * seconds["turns_top_2000"] / max(n_turns, 1), 3)
        print(f"{n_turns} turns, {per_query} ms each", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
