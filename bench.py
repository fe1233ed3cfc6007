"""Time the headline queries and print one JSON line.

The thirteen tables and the input of the changes are derived from the test tables and written to a
new folder first ("load" in the output), as a warehouse would hold them. Each query is then planned
and run in full against them: once to warm up, then three times, of which the median counts. What a
run stages is deleted after it.

    BENCH_SF_DIR  test tables, default /root/testdata/sf0.1
    BENCH_CPUS    threads, default 8
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from samples.queries import QUERIES
from samples.views import INPUTS, Samples
from tertulia import SCHEMAS, load_tables
from tertulia.plans.session import local_session
from tertulia.plans.staging import staging
from tertulia.sources import write_snapshot

HEADLINE = [
    "engagement_summary", "top_participants", "top_participants_one_area", "top_participants_area", "popular_courses",
    "runs_per_course", "completion_rates", "session_attendance_pct", "invite_recommendations",
    "class_attendance", "session_funnel", "course_funnel", "session_invitees", "course_registrants",
    "session_no_shows", "course_not_registered", "member_courses", "member_missed_sessions",
    "member_missed_courses", "course_labels", "email_reply_all", "unknown_emails", "resolve_members",
    "add_members_minimal", "add_courses", "register_session_invitees", "register_course_registrants",
    "register_class_attendance_dedupe", "update_members", "update_members_changed", "set_registrant_status",
    "set_registrant_status_changed", "replace_course_sessions", "member_dependents", "delete_members",
]
RUNS = 3


def run(spark, query, samples: Samples) -> float:
    with staging(spark):
        start = time.perf_counter()
        query(samples).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("BENCH_TMP"))

    start = time.perf_counter()
    derived = Samples(spark, sf_dir)
    for name in [*SCHEMAS, *INPUTS]:
        write_snapshot(derived.view(name), f"{folder}/{name}")
    load = time.perf_counter() - start

    samples = Samples(spark, sf_dir, load_tables(spark, folder), folder)
    seconds = {}
    for name in HEADLINE:
        run(spark, QUERIES[name], samples)
        seconds[name] = round(statistics.median(run(spark, QUERIES[name], samples) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "load": round(load, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
