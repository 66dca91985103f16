"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, as one JSON line.

Reading is inside the measured time; results go to Spark's ``noop`` sink, so every row and
column is computed.
"""

from __future__ import annotations

import json
import os
import time

from vacancylake.checks.queries import QUERIES
from vacancylake.session import local_session

HEADLINES = [
    "count_per_source",
    "not_yet_processed",
    "clean_descriptions",
    "rule_salaries",
    "dictionary_matches",
    "token_patterns",
    "full_records",
    "overview",
    "category_mentions",
    "keyword_combinations",
    "company_stats",
    "cards_topcv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=4 * cpus)
    postings = QUERIES["count_per_source"](spark, sf_dir).groupBy().sum("n").first()[0]
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "postings": postings,
                "enriched_postings_per_sec": round(postings / seconds["full_records"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
