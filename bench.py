"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line.

Each query is built and run into a no-op sink: one warm-up, then the median of BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revtide.plans.registry import QUERIES  # noqa: E402
from revtide.session import build_session  # noqa: E402

HEADLINE = [
    "article_features",
    "user_article_features",
    "talk_volume_features",
    "editor_features",
    "page_metrics",
    "daily_activity",
    "page_user_counts",
    "directed_features",
    "undirected_features",
    "reliability_templates",
    "talk_utterances",
    "politeness_markers",
    "html_to_text",
    "feature_correlations",
    "roc_auc",
    "logreg_scores",
    "graph_propagate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in chosen:
        samples = []
        for attempt in range(runs + 1):
            begun = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                samples.append(time.time() - begun)
        times[name] = round(statistics.median(samples), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
