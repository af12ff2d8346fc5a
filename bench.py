"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned from the parquet files and fully executed with a
``noop`` write; the reported time per query is the median of
$BENCH_RUNS warm runs (after one warm-up).  BENCH_QUERIES=all times every
registered query instead of the headline set.  The load step that an
application does once (deriving users, sessionizing events into events
and sessions, joining plays, all written as Parquet) is timed on its own as ``load_product_tables`` and is part of
the total.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from listenflow import build_session  # noqa: E402
from listenflow.plans.registry import QUERIES  # noqa: E402
from listenflow.operators.ranking import release_held  # noqa: E402
from listenflow.session import materialize  # noqa: E402
from listenflow.sources.product import (derive_events, derive_plays, derive_sessions, derive_users,  # noqa: E402
                                       sessionized_events)
from listenflow.sources.raw import read_raw  # noqa: E402


def load_step(spark, sf_dir):
    """The once-per-application load step, done afresh: derive users,
    sessionize the event stream into events and sessions and join the plays,
    each written as Parquet (what the analyses of an application share)."""
    materialize(derive_users(read_raw(spark, sf_dir, "customer"), read_raw(spark, sf_dir, "nation")))
    events = materialize(derive_events(sessionized_events(read_raw(spark, sf_dir, "events"), keep="cache")))
    release_held()
    materialize(derive_sessions(events, ts="event_ts"))
    materialize(derive_plays(read_raw(spark, sf_dir, "lineitem"), read_raw(spark, sf_dir, "orders")))

HEADLINE = ("funnel_overall", "funnel_by_device", "cohort_retention", "user_day7_features",
            "free_user_tiers", "conversion_by_quartile", "premium_churn_users", "churn_distribution",
            "genre_by_plan", "audio_profile_by_type", "upgrade_click_conversion", "engagement_qcut_segments")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    times = {}
    samples = []
    for i in range(runs + 1):
        t0 = time.perf_counter()
        load_step(spark, sf_dir)
        if i:
            samples.append(time.perf_counter() - t0)
    times["load_product_tables"] = round(statistics.median(samples), 3)
    for name in names:
        fn = QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:                       # first run warms the JVM and file cache
                samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
