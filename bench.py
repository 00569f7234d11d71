"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is executed in full through the noop sink; the time includes planning.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.plans import QUERIES  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "signal_ordinals",
    "window_time_features",
    "window_frequency_features",
    "feature_table",
    "sampling_facts",
    "dataset_validation",
    "feature_summary",
    "state_effects",
    "windowing_comparison",
    "interpolated_channel",
    "measurement_index",
    "document_chunks",
    "word_vectors",
    "vector_topk",
    "evidence_without_near_copies",
    "retrieval_metrics",
    "html_blocks",
    "pair_annotation",
    "paired_difference_audit",
    "row_validation",
    "group_split",
    "binary_metrics",
    "forest_metrics",
    "diagnosed_runs",
    "final_reports",
    "memory_records",
    "memory_context",
    "event_contract",
    "stream_append",
    "stream_run_states",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "OFF",
        },
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
