import random

import pytest
from pyspark.sql import functions as F
from test_windows import events

from sensorloom import operators as O
from sensorloom.streaming import PaneLog, changelog, closed_windows, corrected_windows, current_windows, last_batch, run_panes, state_rows
from sensorloom.streaming.panelog import exists, take

HOUR = 3_600_000


def minutes(spark, first, last, n, seed, sensors=3):
    """Events of these minutes of a day, few values, so that some windows don't change."""
    r = random.Random(seed)
    return events(spark, [(f"2025-01-01T{m // 60:02d}:{m % 60:02d}:{r.randrange(60):02d}", f"s{r.randrange(sensors)}", f"{r.choice([1, 2, 2, 2, 70])}.50") for m in (r.randrange(first, last) for _ in range(n))])


def whole(parts):
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return O.all_windows(O.tumbling_stats(rows), O.sliding_in_blocks(rows)).drop("flag")


def same(got, want):
    return O.same_rows(got.select(sorted(want.columns)), want.select(sorted(want.columns)))


def test_in_order_and_late(spark):
    """Runs over parts, the last far too late: closed windows stay as they were, the correction has all rows."""
    parts = [minutes(spark, 0, 60, 200, 1), minutes(spark, 40, 120, 200, 2), minutes(spark, 100, 240, 200, 3), minutes(spark, 0, 30, 60, 4), minutes(spark, 225, 300, 90, 5)]
    log = run_panes(parts[:3], lateness_ms=30 * 60_000)
    assert same(current_windows(spark, log), whole(parts[:3]))
    log = run_panes(parts, lateness_ms=30 * 60_000)
    early = closed_windows(spark, log).where(F.col("window_start_ms") < 1735689600000 + HOUR // 2)
    assert not same(current_windows(spark, log), whole(parts)) and same(corrected_windows(spark, log), whole(parts))
    before = whole([parts[0], parts[1], parts[2]]).where(F.col("window_start_ms") < 1735689600000 + HOUR // 2)
    assert same(early, before)
    open_panes = 30 + 5 + 1
    assert state_rows(spark, log).select("pane").distinct().count() <= open_panes
    assert not exists(spark, log.path("rows", 0)) and not exists(spark, log.path("clock", 1)) and exists(spark, log.path("archive", 1))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """Each batch runs twice, the second time after its clock or before it is written."""
    log = PaneLog(str(tmp_path / "log"), lateness_ms=10 * 60_000, merge_every=2)
    parts = [minutes(spark, 30 * i, 30 * i + 40, 80, i) for i in range(5)]
    for i, p in enumerate(parts):
        for _ in range(2):
            take(p, i, log)
    assert same(corrected_windows(spark, log), whole(parts))
    assert changelog(spark, log).groupBy("batch", "window_type", "window_start_ms", "sensor_id").count().where("count > 1").isEmpty()
    assert last_batch(spark, log)["number"] == 4


def test_changes_have_both_sides(spark):
    """A row only where values differ; the same values again change the tumbling counts and not the ranks; nothing, nothing."""
    a = events(spark, [("2025-01-01T00:00:01", "a", "1.00"), ("2025-01-01T00:00:02", "b", "2.00")])
    b = events(spark, [("2025-01-01T00:00:03", "a", "1.00")])
    c = events(spark, [("2025-01-01T00:00:04", "b", "9.00")])
    rows = changelog(spark, run_panes([a, b, c])).collect()
    told = {(r["batch"], r["window_type"], r["sensor_id"], r["flag"]) for r in rows}
    assert told == {(0, t, s, "new") for t in ("tumbling", "sliding") for s in "ab"} | {(1, "tumbling", "a", "updated"), (2, "tumbling", "b", "updated"), (2, "sliding", "b", "updated")}
    (one,) = [r for r in rows if r["batch"] == 1]
    assert (one["before"]["cnt"], one["after"]["cnt"], str(one["before"]["sum_value"]), str(one["after"]["sum_value"])) == (1, 2, "1.00", "2.00")
    assert len([r for r in rows if r["batch"] == 2 and r["window_type"] == "sliding"]) == 5


def test_empty_batches_and_doubles(spark, tmp_path):
    log = PaneLog(str(tmp_path / "log"), merge_every=1)
    empty = minutes(spark, 0, 9, 0, 1).withColumn("value", F.col("value").cast("double"))
    some = minutes(spark, 0, 50, 100, 2).withColumn("value", F.col("value").cast("double") / 4)
    for i, p in enumerate([empty, some, empty]):
        take(p, i, log)
    assert same(current_windows(spark, log), whole([some])) and changelog(spark, log).where("batch <> 1").isEmpty()


@pytest.mark.parametrize("merge_every", [3])
def test_work_does_not_grow_with_the_streams_age(spark, tmp_path, merge_every):
    """What is kept and read depends on the open panes: files and state after nine batches are as after six."""
    log, seen = PaneLog(str(tmp_path / "log"), lateness_ms=60_000, merge_every=merge_every), []
    for i in range(9):
        take(minutes(spark, 20 * i, 20 * i + 20, 40, i), i, log)
        seen.append((state_rows(spark, log).select("pane").distinct().count(), len(list((tmp_path / "log" / "rows").iterdir())), len(list((tmp_path / "log" / "clock").iterdir()))))
    assert max(seen[6:]) <= max(seen[:6]) and seen[-1][0] <= 7


def test_a_batch_makes_each_window_once(spark, tmp_path):
    """A window that a batch changes and closes is one row, whose ranks come from no list; a late row with NaN or infinity is counted."""
    log = PaneLog(str(tmp_path / "log"), lateness_ms=0)
    part = minutes(spark, 0, 90, 150, 1)
    take(part, 0, log)
    rows = spark.read.parquet(log.path("windows", 0))
    assert rows.groupBy("window_type", "window_start_ms", "sensor_id").count().where("count > 1").isEmpty()
    assert rows.where("closed AND flag = 'new'").count() > 300 and rows.count() == changelog(spark, log).count()
    assert sorted(x.name for x in (tmp_path / "log").iterdir()) == ["clock", "rows", "windows"]
    assert "collect_list" not in current_windows(spark, log)._jdf.queryExecution().optimizedPlan().toString()
    odd = PaneLog(str(tmp_path / "odd"), lateness_ms=0)
    parts = [part.withColumn("value", F.col("value").cast("double")), minutes(spark, 0, 90, 40, 2).withColumn("value", F.expr("IF(second(ts) % 2 = 0, double('NaN'), double('Infinity'))"))]
    for i, p in enumerate(parts):
        take(p, i, odd)
    assert same(corrected_windows(spark, odd), whole(parts))
