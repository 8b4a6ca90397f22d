import random

from pyspark.sql import functions as F
from test_windows import dense, written

from sensorloom import operators as O
from sensorloom.sources import ParseMetrics, parse_lines, write_with_manifest

GOOD = [f"2025-01-01T00:00:{i:02d}Z,s{i % 3},{i}.50" for i in range(40)]
BAD = {"not_three_fields": ["", "a,b", "1,2,3,4", ",,"], "no_instant": ["2025-01-01,s,1", "x,s,y"], "no_number": ["2025-01-01T00:00:00Z,s,NaN", "2025-01-01T00:00:00Z,s,x"]}


def mixed_lines():
    rows = GOOD + [x for v in BAD.values() for x in v]
    random.Random(1).shuffle(rows)
    return rows


def want():
    return {"lines": len(mixed_lines()), "events": len(GOOD)} | {k: len(v) for k, v in BAD.items()}


def slow(rows):
    """Counts by splitting; the lines above have no odd zones or numbers."""
    out = dict.fromkeys(want(), 0)
    for x in rows:
        parts = x.rstrip(",").split(",")
        out["lines"] += 1
        kind = "not_three_fields" if len(parts) != 3 else "no_instant" if "T" not in parts[0] else "no_number" if not parts[2].replace(".", "").isdigit() else "events"
        out[kind] += 1
    return out



def test_counts_come_with_the_parse(spark, tmp_path):
    """The same counts as a slow count, from one scan, and twice read, once counted."""
    written(tmp_path / "in", "a.txt", mixed_lines())
    metrics = ParseMetrics()
    windows = O.tumbling_stats(parse_lines(spark.read.text(str(tmp_path / "in")), metrics=metrics))
    assert windows._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert windows.agg(F.sum("cnt")).first()[0] == len(GOOD)
    assert metrics.counts() == want() == slow(mixed_lines())


def test_counts_of_a_stream(spark, tmp_path):
    written(tmp_path / "in", "a.txt", mixed_lines())
    lines = spark.readStream.text(str(tmp_path / "in"))
    query = parse_lines(lines, metrics="parse").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    told = {}
    for p in query.recentProgress:
        for name, row in (p["observedMetrics"] if isinstance(p, dict) else p.observedMetrics).items():
            told |= {name: row if isinstance(row, dict) else row.asDict()}
    assert told["parse_lines"] | told["parse_events"] == want()


def test_files_are_one_text_in_the_manifests_order(spark, tmp_path):
    df = dense(spark)
    windows = O.all_windows(O.tumbling_stats(df), O.sliding_in_blocks(df))
    rows = [r.asDict() for r in windows.withColumn("line", O.line_of(windows)).collect()]
    text = "".join(r["line"] + "\n" for r in sorted(rows, key=lambda r: (r["window_type"], r["window_start_ms"], r["sensor_id"]))).encode()
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_with_manifest(O.lines_in_order(O.ordered(windows)), path).orderBy("offset").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 2
    joined = bytearray()
    for r in manifest:
        part = (tmp_path / "out" / r["file"]).read_bytes()
        assert (r["offset"], r["length"]) == (len(joined), len(part))
        joined += part
    assert bytes(joined) == text
    offsets = O.numbered(windows.withColumn("line", O.line_of(windows)), F.octet_length("line") + 1)
    for r in offsets.collect():
        assert text[r["offset"] :].startswith(r["line"].encode() + b"\n")
