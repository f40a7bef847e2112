"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
Each query runs in full: its result goes to a sink that discards it.  One
untimed run of the first query starts the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cantiga.session import local_session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "royalties_by_artist_period",
    "royalties_by_origin_type",
    "royalties_by_label",
    "royalty_fact",
    "dsu_detail_all_keys",
    "ledger_revenue_cost",
    "track_and_code",
    "works_by_composer",
    "royalties_by_channel",
    "contracts_latest_with_calendar",
    "status_change_counts",
    "booking_quality",
    "missed_opportunities",
    "match_coverage",
    "key_uniqueness",
    "digest_preview",
    "folded_documents",
    "routing_mix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "cantiga-bench")
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
