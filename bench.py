"""Bench: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds.

Each query is executed in full with the ``noop`` sink (no collect), once,
after a warm-up pass over the sf0.01 tables ($BENCH_WARM_DIR); the time includes planning
and any eager materialisation (checkpoints, size checks) the query does.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "build_prompts_train", "build_prompts_test", "ehrsql_prompts_train", "schema_strings", "normalize_sql",
    "clean_questions", "tokenize_codepoints", "pad_left", "length_profile", "completion_labels", "step_entropy",
    "step_entropy_long", "truncate_scores", "confidence", "last_by_id", "batch_ids", "chat_render",
    "generate_standin", "stream_prompts_test", "train_tokens", "src_pauq",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from sqlkiln.plans.registry import QUERIES
    from sqlkiln.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="sqlkiln-bench")
    # Warm the JVM (code generation, JIT) and the Python workers by running
    # every timed query once on small tables.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
