"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_QUERIES (comma list).
Every query is written to the noop sink, so all rows and columns are computed. The time is the better
of two runs after a warm-up of the session.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from homestream.plans.queries import QUERIES  # noqa: E402
from homestream.session import local_session  # noqa: E402

HEADLINE = (
    "temp_window_avg temperature_first_wins temperature_docs_last_wins led_changes fan_changes door_changes "
    "fan_state lock_state control_log nearest_match confirm_runs carry_forward parse_commands route_commands "
    "latest_per_feed validate_uploads wire_round_trip_fan event_time_parse"
).split()


def run(query, spark, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS"), app="bench")
    run(QUERIES["temp_clean"], spark, sf_dir)
    times = {n: round(min(run(QUERIES[n], spark, sf_dir) for _ in range(2)), 3) for n in names}
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
