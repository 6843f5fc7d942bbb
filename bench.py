"""Headline queries, one JSON line: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``.

``BENCH_ALL=1`` times every registered query; ``BENCH_RUNS`` sets the timed runs (default 3, best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queries import QUERIES  # noqa: E402
from tabulens.session import build_session  # noqa: E402

HEADLINE = (
    "c03_numeric_ratio", "p02_missing_counts", "p03_duplicate_count", "p04_distinct_counts", "p07_top_values",
    "p10_describe_numeric", "p11_quality_score", "p14_profile_text", "p16_language_tally", "p23_profile_columns",
    "k02_dedupe", "k03_fill_median", "k05_fill_mode", "k08_forward_fill", "k09_iqr_clip", "k10_iqr_drop",
    "k14_clean_text", "k24_parse_dates", "k31_apply_plan", "a01_growth", "a02_correlation", "a09_compare_groups",
    "a11_distribution", "a16_samples_per_group", "a17_crosstab", "a22_pct_change", "a27_top_entities",
    "v03_histogram", "v06_box", "t01_word_freq", "t06_intent_scored", "t10_diversify", "t11_extract_questions",
    "f01_forecast", "x01_nearest_l2", "s04_read_json_lines", "s07_chunk_text_recursive", "s08_chunk_text_fixed",
)


def run(spark, fn, sf: str) -> float:
    start = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        run(spark, QUERIES[name], sf)
        times[name] = round(min(run(spark, QUERIES[name], sf) for _ in range(runs)), 4)
    print(
        json.dumps(
            {"metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
