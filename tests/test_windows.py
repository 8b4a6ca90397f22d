import math
import random
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sensorloom import operators as O
from sensorloom.functions import nearest_rank, sorted_values
from sensorloom.sources import generate_events, parse_lines, read_text_events, write_lines
from sensorloom.sources.generator import event_lines
from sensorloom.streaming import final_state, run_to_end, stream_windows

SCHEMA = "ts timestamp, sensor_id string, value decimal(18,2)"


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def events(spark, rows):
    return spark.createDataFrame([(at(t), s, Decimal(v)) for t, s, v in rows], SCHEMA)


def dense(spark, n=600):
    r = random.Random(3)
    return events(spark, [(f"2025-01-01T00:{r.randrange(10):02d}:{r.randrange(60):02d}", f"s{r.randrange(3)}", f"{r.gauss(0, 9):.2f}") for _ in range(n)])


def lines(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 99, 100, 101, 200, 250])
def test_nearest_rank(spark, n):
    values = [Decimal(i * 7 % 251) for i in range(n)]
    got = spark.createDataFrame([(v,) for v in values], "v decimal(18,2)").agg(sorted_values("v").alias("a")).select(nearest_rank(F.col("a"), 50), nearest_rank(F.col("a"), 99)).first()
    assert list(got) == [sorted(values)[max(math.ceil(p * n / 100) - 1, 0)] for p in (50, 99)]


def test_all_sliding_forms_agree(spark):
    df = dense(spark)
    want = sorted(map(tuple, O.sliding_percentiles(df).collect()))
    for other in (O.sliding_in_blocks(df), O.sliding_percentiles_disc(df), O.sliding_from_panes(O.panes(df)), O.sliding_counted(df), O.sliding_percentiles(df.repartition(7))):
        assert sorted(map(tuple, other.collect())) == want
    assert O.same_rows(O.sliding_percentiles(df), O.sliding_counted(df))


@pytest.mark.parametrize("kind", ["decimal(18,2)", "decimal(18,3)", "decimal(18,0)", "decimal(18,18)", "double"])
def test_panes_keep_values_exact(spark, kind):
    numbers = ["0.1", "-0.2", "0.005", "-0.00", "0.999"] + (["9999999999999999", "-9999999999999999"] if "18,18" not in kind and "18,3" not in kind else [])
    df = spark.createDataFrame([(at("2025-01-01T00:00:00"), f"s{i % 2}", v) for i, v in enumerate(numbers)], "ts timestamp, sensor_id string, value string").withColumn("value", F.col("value").cast(kind))
    want = O.sliding_percentiles(df)
    got = O.sliding_from_panes(O.panes(df))
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    both = O.both_from_panes(O.panes(df)).select("window_start_ms", "sensor_id", "p50", "p99")
    assert O.same_rows(both, want.select(both.columns))


def test_each_event_is_in_five_windows(spark):
    df = dense(spark)
    total = lambda d: sum(r["cnt"] for r in d.collect())
    assert total(O.sliding_percentiles(df)) == 5 * total(O.tumbling_stats(df)) == 5 * 600
    assert O.assign_windows(df).count() == 3000


def test_rounding_and_zero(spark):
    df = events(spark, [("2025-01-01T00:00:00", "a", "0.00"), ("2025-01-01T00:00:01", "a", "0.05"), ("2025-01-01T00:00:00", "b", "0.00"), ("2025-01-01T00:00:01", "b", "-0.05"), ("2025-01-01T00:00:01", "c", "-0.00")])
    got = lines(O.tumbling_lines(O.tumbling_stats(df)))
    ms = 1735689600000
    assert got == [f"tumbling,{ms},a,2,0.05,0.00,0.05,0.03,new", f"tumbling,{ms},b,2,-0.05,-0.05,0.00,-0.03,new", f"tumbling,{ms},c,1,0.00,0.00,0.00,0.00,new"]


def test_single_event_and_midnight(spark):
    df = events(spark, [("2024-12-31T23:55:00", "a", "1.00"), ("2025-01-01T00:02:00", "b", "2.00")])
    rows = O.sliding_percentiles(df.where("sensor_id = 'a'")).collect()
    assert sorted(r["window_start_ms"] for r in rows) == [at("2024-12-31T23:55:00").timestamp() * 1000 - k * 60_000 for k in (4, 3, 2, 1, 0)]
    assert {r["window_start_ms"] for r in O.tumbling_stats(df).collect()} == {at(t).timestamp() * 1000 for t in ("2024-12-31T23:55:00", "2025-01-01T00:02:00")}


def test_boundaries_are_half_open(spark):
    df = events(spark, [("2025-01-01T00:05:00", "a", "1.00"), ("2025-01-01T00:04:59.999", "a", "2.00")])
    got = {(r["window_start_ms"], r["cnt"]) for r in O.tumbling_stats(df).collect()}
    assert got == {(1735689900000, 1), (1735689840000, 1)}


def test_empty(spark):
    df = events(spark, [])
    assert O.to_lines(O.tumbling_stats(df), O.sliding_percentiles(df)).collect() == []
    assert O.sliding_counted(df).collect() == []


def test_malformed_lines(spark):
    good = ["2025-01-01T00:00:00Z,s,1.00", "2025-01-01T00:00:00+01:00,s,2", "2025-01-01T00:00:00.5Z,s,3.005,", "2025-01-01T00:00:00Z,s,4.00\r"]
    bad = ["", ",,", "a,b", "2025-01-01T00:00:00Z,s", "2025-01-01T00:00:00Z,s,1,x", "2025-01-01,s,1", "2025-01-01T00:00:00,s,1", "2025-01-01T00:00:00+0100,s,1", "2025-13-01T00:00:00Z,s,1", "2025-01-01T00:00:00Z,s,NaN", "2025-01-01T00:00:00Z,s,", " 025-01-01T00:00:00Z,s,1", "2025-01-01T00:00: 0Z,s,1", "2025-1a-01T00:00:00Z,s,1", "+025-01-01T00:00:00Z,s,1", "2025-01-01 00:00:00Z,s,1", "2025-02-30T00:00:00Z,s,1", "2025-01-01T24:00:01Z,s,1", "2025-01-01T23:58:60Z,s,1", "2025-01-01T25:00:00Z,s,1"]
    rows = parse_lines(spark.createDataFrame([(x,) for x in good + bad], "value string")).collect()
    assert sorted(r["value"] for r in rows) == [Decimal("1.00"), Decimal("2.00"), Decimal("3.01"), Decimal("4.00")]


def test_instants_at_the_edges(spark):
    """Either case, the end of a day, the leap second, fractions with and without digits, offsets."""
    texts = {
        "2025-01-01T24:00:00Z": "2025-01-02T00:00:00", "2025-12-31t24:00:00.000z": "2026-01-01T00:00:00", "2025-01-01T24:00:00+01:00": "2025-01-01T23:00:00", "2024-12-31T23:59:60Z": "2024-12-31T23:59:59",
        "2025-01-01t00:00:05z": "2025-01-01T00:00:05", "2025-01-01T00:00:05.Z": "2025-01-01T00:00:05", "2025-01-01T00:00:05.25Z": "2025-01-01T00:00:05.250", "2025-01-01T00:00:05-02:00": "2025-01-01T02:00:05",
    }
    got = parse_lines(spark.createDataFrame([(f"{t},{i},1",) for i, t in enumerate(texts)], "value string")).select("sensor_id", F.unix_millis("ts")).collect()
    assert {int(i): ms for i, ms in got} == {i: round(at(w).timestamp() * 1000) for i, w in enumerate(texts.values())}


def test_text_files_and_horizon(spark, tmp_path):
    made = generate_events(spark, 2000, sensors=1200, partitions=4)
    event_lines(made).write.text(str(tmp_path / "in"))
    back = read_text_events(spark, str(tmp_path / "in"))
    assert O.same_rows(back, made)
    assert O.within_horizon(back, "2025-01-01T00:00:00Z", 60).count() < 2000
    write_lines(O.to_lines(O.tumbling_stats(back), O.sliding_percentiles(back)), str(tmp_path / "out"), ordered=True)
    read = lambda name: [x for f in sorted((tmp_path / name).glob("part-*")) for x in f.read_text().splitlines()]
    text = read("out")
    assert len(text) > 2000 and all(x.endswith(",new") for x in text) and text == sorted(text)
    both = O.all_windows(O.tumbling_stats(back), O.sliding_percentiles(back))
    write_lines(O.lines_in_order(O.ordered(both)), str(tmp_path / "blocks"))
    blocks = read("blocks")
    assert sorted(blocks) == text and blocks == sorted(blocks, key=lambda x: (x.split(",")[0], int(x.split(",")[1]), x.split(",")[2]))
    places = [tuple(r) for r in O.numbered(both).orderBy("position").select("window_type", "window_start_ms", "sensor_id", "position").collect()]
    assert places == [(*p[:3], i) for i, p in enumerate(sorted(places), 1)]


@pytest.mark.parametrize("kind", ["double", "decimal(18,3)"])
def test_forms_agree_on_other_values(spark, kind):
    """Doubles with NaN and infinities, and three decimals: all forms and the lines say the same."""
    numbers = ["0.1251", "-0.2", "3.0055", "-0.00", "12345.678"] + (["NaN", "Infinity"] if kind == "double" else [])
    rows = [f"2025-01-01T00:0{i % 7}:00Z,s{i % 2},{v}" for i, v in enumerate(numbers * 3)]
    options = {"lenient": True} if kind == "double" else {"scale": 3}
    df = parse_lines(spark.createDataFrame([(x,) for x in rows], "value string"), **options)
    assert df.schema["value"].dataType.simpleString() == kind and df.count() == len(rows)
    forms = [O.sliding_percentiles(df), O.sliding_in_blocks(df), O.sliding_from_panes(O.panes(df))] + [O.sliding_percentiles_disc(df), O.sliding_counted(df)]
    want = lines(O.sliding_lines(forms[0]))
    assert all(lines(O.sliding_lines(f)) == want for f in forms)
    both = want + lines(O.tumbling_lines(O.tumbling_stats(df)))
    assert lines(O.lines_of_both(O.both_in_blocks(df))) == lines(O.lines_of_both(O.both_from_panes(O.panes(df)))) == sorted(both)
    assert O.same_rows(O.union_of_both(O.both_in_blocks(df)), O.all_windows(O.tumbling_stats(df), forms[0]))
    assert O.tumbling_stats(df).where("avg_value IS NULL").count() == 0
    assert kind != "double" or any("NaN" in x for x in both)


def test_before_the_epoch(spark):
    df = events(spark, [("1970-01-01T00:00:30", "a", "1.00"), ("1969-12-31T23:59:30", "b", "2.00")])
    starts = lambda d: sorted(r["window_start_ms"] for r in d.collect())
    assert starts(O.sliding_percentiles(df)) == starts(O.sliding_from_panes(O.panes(df))) == starts(O.both_in_blocks(df)) == sorted([-k * 60_000 for k in range(5)] + [-k * 60_000 for k in range(1, 6)])
    assert starts(O.from_epoch(O.sliding_percentiles(df))) == [0] and starts(O.from_epoch(O.tumbling_stats(df))) == [0]


def test_blocks_move_events_once(spark):
    plan = O.both_in_blocks(generate_events(spark, 100, partitions=2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stream_equals_batch_with_late_data(spark, tmp_path):
    r = random.Random(5)
    parts = []
    for i in range(3):
        rows = [f"2025-01-01T00:{max(0, i * 10 + r.randrange(10) - (r.random() < 0.1) * 8):02d}:{r.randrange(60):02d}Z,s{r.randrange(2)},{r.gauss(5, 9):.2f}" for _ in range(150)]
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.txt").write_text("\n".join(rows) + "\n")
        parts += rows
    source = parse_lines(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")))
    batch = parse_lines(spark.createDataFrame([(x,) for x in parts], "value string"))
    for windows in (O.tumbling_stats, O.sliding_percentiles):
        got, want = run_to_end(source, windows), windows(batch)
        assert O.same_rows(got.drop("flag").select(sorted(set(want.columns) - {"flag"})), want.drop("flag").select(sorted(set(want.columns) - {"flag"})))
        assert {x[0] for x in got.select("flag").distinct().collect()} == {"new", "updated"}


def written(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(rows) + "\n")


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Three runs with one checkpoint; states are merged on the way; what is later than the watermark is dropped."""
    log, checkpoint, source = str(tmp_path / "log"), str(tmp_path / "offsets"), tmp_path / "in"
    parts = [[f"2025-01-01T{h:02d}:{m:02d}:10Z,s{m % 2},{m}.25" for m in range(0, 60, 7)] for h in (1, 2, 3)]
    parts[1] += ["2025-01-01T01:57:00Z,s1,9.00"]
    too_late = ["2025-01-01T01:00:30Z,s0,99.00"]
    for i, rows in enumerate([parts[0], parts[1], parts[2] + too_late]):
        written(source, f"{i}.txt", rows)
        for every in (2, 2):  # the second finds nothing new
            lines_in = parse_lines(spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)))
            stream_windows(lines_in, O.tumbling_stats, log, checkpoint, compact_every=every).awaitTermination()
        got = {(r["window_start_ms"], r["sensor_id"]): (r["cnt"], r["flag"]) for r in final_state(spark, log).collect()}
        batch = O.tumbling_stats(parse_lines(spark.createDataFrame([(x,) for p in parts[: i + 1] for x in p], "value string"))).collect()
        assert {k: v[0] for k, v in got.items()} == {(r["window_start_ms"], r["sensor_id"]): r["cnt"] for r in batch}
    assert (tmp_path / "log" / "states").exists() and len(list((tmp_path / "log" / "states").iterdir())) > 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    written(tmp_path / "in", "0.txt", ["2025-01-01T00:00:00Z,a,1.00"])
    source = lambda: parse_lines(spark.readStream.text(str(tmp_path / "in")))
    for offsets in ("one", "two"):  # lost offsets: the batch with number 0 runs again
        stream_windows(source(), O.tumbling_stats, log, str(tmp_path / offsets)).awaitTermination()
    (row,) = final_state(spark, log).collect()
    assert (row["cnt"], row["flag"]) == (1, "new")


def test_a_half_written_state_is_not_read(spark, tmp_path):
    """What a crash leaves of a state is passed over for the one before it and the changes since; what no reader needs is removed."""
    log, source = tmp_path / "log", tmp_path / "in"
    for i in range(6):
        written(source, f"{i}.txt", [f"2025-01-01T00:00:{i:02d}Z,a,{i}.00"])
        stream_windows(parse_lines(spark.readStream.text(str(source))), O.tumbling_stats, str(log), str(tmp_path / "offsets"), compact_every=2).awaitTermination()
    numbers = lambda kind: sorted(int(x.name.split("=")[1]) for x in (log / kind).iterdir() if "=" in x.name)
    *older, last = numbers("states")
    (log / "states" / f"state={last}" / "_SUCCESS").unlink()
    for part in list((log / "states" / f"state={last}").glob("*.parquet"))[1:]:
        part.unlink()
    (row,) = final_state(spark, str(log)).collect()
    assert (row["cnt"], row["flag"]) == (6, "updated")
    assert older == [-1, last - 2] and min(numbers("changes")) == last - 1
