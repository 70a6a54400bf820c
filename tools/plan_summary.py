"""Shuffles and broadcasts per registered query, read from the executed
(AQE final) plan.  Materialised sides (checkpoints) count separately, as
their own jobs, and are not included.

    python tools/plan_summary.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summary(df) -> dict:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", final)),
        "broadcasts": final.count("BroadcastExchange"),
        "python": int(any(k in final for k in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython"))),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from sqlkiln.plans.registry import QUERIES
    from sqlkiln.session import local_session

    spark = local_session()
    print("| query | shuffles | broadcasts | Python |")
    print("|---|---|---|---|")
    for name in sorted(QUERIES):
        if name == "stream_prompts_test":
            continue
        s = summary(QUERIES[name](spark, sf_dir))
        print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {'yes' if s['python'] else 'no'} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
