"""Times the headline queries: BENCH_SF_DIR (default sf0.1), local[BENCH_CPUS]. Prints one JSON line.

Queries under five seconds: the median of BENCH_RUNS runs after a warm-up; slower ones run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from convspark.queries import registry
from convspark.session import local

HEADLINE = [
    "tokenize_text",
    "recall_tokens",
    "injection_flags",
    "recency_briefs",
    "semantic_segments",
    "hybrid_briefs",
    "rerank_segments",
    "request_validation",
    "idempotent_insert",
    "declarative_decisions",
    "action_statuses",
    "vote_outcomes",
    "policy_correctness",
    "identity_hints",
    "cache_lookup_per_customer",
    "load_summary",
    "payload_strings",
    "python_rule_decisions",
    "all_strategy_briefs",
    "cache_lookup_per_tenant",
]


QUICK = 5.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local("bench", cpus, shuffle=int(cpus) if cpus.isdigit() else 8)
    queries = registry.queries()
    queries["count_by_tenant"](spark, sf_dir).collect()  # start-up is not part of any query
    times = {}
    for name in names:
        taken = []
        # quick queries: a warm-up that does not count, then the median; slow ones are dominated by their work
        while len(taken) < (runs + 1 if taken and taken[0] < QUICK else 1):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        taken = taken[1:] or taken
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()
