"""Headline queries, one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feed_page_newest", "feed_page_salary", "feed_totals", "facets_default", "facets_family_country",
    "snapshot_shapes", "quiet_facets", "close_vanished", "merge_and_close", "lifecycle_replay",
    "repost_events", "board_health", "exclusion_tally", "tally_two_speed", "classify_role", "specialization",
    "country_infer", "salary_parse", "saturation_score", "source_greenhouse", "archive_boards",
    "html_to_text", "experience_months", "interleave",
]


def main() -> None:
    from boardwalk.session import local_session
    from checks import load_all
    from checks.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    load_all()
    names = sys.argv[1:] or HEADLINE
    QUERIES["in_scope_total"](spark, sf_dir).collect()  # warm the session
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
