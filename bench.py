"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import fixtures  # noqa: E402
from checks.registry import QUERIES  # noqa: E402
from mailloom.session import build_session  # noqa: E402

HEADLINES = [
    "flagship_clean_chunk",
    "c19_clean_table",
    "c19_clean_pages",
    "c17_repeated_lines",
    "i2_mime_parse",
    "i10_keep_first",
    "i11_insert_absent",
    "i15_fixed_batches",
    "i16_run_counters",
    "v5_point_ids",
    "v9_ingest_job",
    "s5_insert_if_absent",
    "s6_update_bodies",
    "s8_upsert_points",
    "s8_point_table",
    "c19_clean_in_place",
    "f4_newest_per_thread",
    "t1_recent",
    "e4_events",
    "e6_resume",
    "e14_step_inputs",
    "r1_import_stream",
    "r2_vectorize_stream",
    "r4_resume_stream",
    "e8_plan_stream",
    "v8_nearest_points",
]


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINES
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    # Start the JIT and the Python workers outside the timed part.
    timed(lambda: fixtures.emails(spark, sf_dir))
    timed(lambda: QUERIES["i3_header_words"](spark, sf_dir))
    seconds = {name: min(timed(lambda n=name: QUERIES[n](spark, sf_dir)) for _ in range(repeats)) for name in wanted}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(s, 3) for name, s in seconds.items()},
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
