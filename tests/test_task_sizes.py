"""Shuffles that follow a count have as many partitions as the rows need, whatever the session's number."""

from pyspark.sql import functions as F
from test_windows import dense

from sensorloom import operators as O


def largest(rows):
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_counted_windows_are_dealt_by_their_number(spark, monkeypatch):
    df = dense(spark)
    whole = O.sliding_counted(df)
    assert whole.rdd.getNumPartitions() <= 8
    monkeypatch.setattr("sensorloom.session.PER_TASK", 50)
    many = O.sliding_counted(df)
    assert many.rdd.getNumPartitions() > 40 and O.same_rows(many, whole)


def test_numbered_in_ranges_of_bounded_size(spark, monkeypatch):
    df = dense(spark)
    windows = O.all_windows(O.tumbling_stats(df), O.sliding_in_blocks(df))
    whole = O.numbered(windows, F.length("sensor_id"))
    monkeypatch.setattr("sensorloom.session.PER_TASK", 4)
    many = O.numbered(windows, F.length("sensor_id"))
    assert windows.count() > 60 and many.rdd.getNumPartitions() > 15 and largest(many) <= 12 and O.same_rows(many, whole)
