import random

from pyspark.sql import functions as F
from test_windows import events

from sensorloom import operators as O


def mixed_heat(spark, n=3000):
    """A sensor with a third of all rows and few values, and a hundred others."""
    r = random.Random(5)
    return events(spark, [(f"2025-01-01T00:{r.randrange(9):02d}:{r.randrange(60):02d}", "hot" if i % 3 == 0 else f"s{r.randrange(100)}", f"{r.randrange(40)}.25") for i in range(n)])


def test_equal_to_blocks(spark):
    df = mixed_heat(spark)
    want = O.union_of_both(O.both_in_blocks(df))
    for share in (0.3, 0.01, 0.9):  # one hot sensor, some of the others too, none
        assert O.same_rows(O.windows_by_heat(df, share=share).select(want.columns), want)
    assert O.windows_by_heat(df.limit(0)).collect() == []


def test_hot_sensors_are_those_of_the_share(spark):
    df = mixed_heat(spark)
    counts = {r["sensor_id"]: r["count"] for r in df.groupBy("sensor_id").count().collect()}
    for share in (0.3, 0.008):
        assert {r["sensor_id"]: r["n"] for r in O.hot_sensors(df, share).collect()} == {k: c for k, c in counts.items() if c >= 3000 * share}


def test_no_task_gets_the_hot_sensors_rows(spark):
    """Blocks hold less than the share of all rows; the hot sensor's counts are a row for each value of a pane."""
    df = mixed_heat(spark)
    hot, rest = O.split_by_heat(df, 0.1)
    assert rest.groupBy("sensor_id").count().agg(F.max("count")).first()[0] < 300 and hot.select("sensor_id").distinct().count() == 1
    counted = hot.groupBy(F.window("ts", "1 minute"), "sensor_id", "value").count()
    assert counted.groupBy("window", "sensor_id").count().agg(F.max("count")).first()[0] <= 40
    sliding = O.sliding_counted(hot)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in sliding
