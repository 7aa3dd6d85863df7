"""Headline queries, timed. Prints one JSON line; reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import time

from veil.plans import catalog
from veil.session import build_session

HEADLINE = ("s5_sanitize", "d1_findings_summary", "s6_exit_check", "b5_page_context", "a8_scan_pages",
            "e1_number_placeholders", "c5_match_memory", "c1_match_terms", "e4_table_shape",
            "e6_dedupe_rects", "r1_hide_columns", "e10_chunk_text", "t2_session_gate")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("veil-bench", f"local[{cpus}]", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus,
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
