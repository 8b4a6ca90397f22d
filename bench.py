"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from sensorloom.operators import both_in_blocks, lines_of_both
from sensorloom.plans import QUERIES
from sensorloom.session import build_session
from sensorloom.sources import read_text_events
from sensorloom.sources.generator import event_lines, generate_events

HEADLINE = ["tumbling_stats", "sliding_percentiles", "sliding_from_panes", "sliding_counted", "rendered_lines", "rendered_from_panes", "all_windows_union", "tumbling_stats_hourly", "sliding_percentiles_hourly", "sliding_percentiles_daily", "parse_roundtrip"]


def timed(action, repeats: int = 3) -> float:
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        action()
        took.append(time.perf_counter() - began)
    return statistics.median(took)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    rows = int(os.environ.get("BENCH_EVENTS", "10000000"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run = lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        times[name] = round(timed(run), 3)
    extra = {}
    if rows:
        with tempfile.TemporaryDirectory() as folder:
            event_lines(generate_events(spark, rows, partitions=int(cpus))).write.text(f"{folder}/in")

            def full() -> None:
                events = read_text_events(spark, f"{folder}/in")
                lines_of_both(both_in_blocks(events)).write.mode("overwrite").text(f"{folder}/out")

            took, warm = timed(full, 1), timed(full)
        extra = {"text_to_text_events": rows, "text_to_text_sec": round(took, 2), "text_to_text_events_per_sec": round(rows / took), "text_to_text_warm_sec": round(warm, 2)}
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")} | extra))
    spark.stop()


if __name__ == "__main__":
    main()
