"""Windowed aggregates of streams, kept as a log of changes by (type, start, sensor).

A micro-batch in update mode emits the windows that it changed. Each goes to the log with the batch's
number, in a folder of that number, which a replayed batch overwrites; so replays change nothing. Every
some batches the last state and the changes since are merged to a new state, so that reading costs what
there are keys and some batches, not the whole log; what is in the state before the last is removed. The state of a key is its last row; it is `new` if it
was emitted once and `updated` otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.session import exists, fresh_path, remove

#: Covers lateness of up to ten minutes and jitter.
ALLOWED_LATENESS = "15 minutes"
KEY = ("window_type", "window_start_ms", "sensor_id")


def stream_windows(events: DataFrame, windows: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, lateness: str = ALLOWED_LATENESS, compact_every: int = 20, **trigger):
    """Start the query that appends changed windows to the log. Events of windows that ended before the watermark are dropped."""
    rows = windows(events.withWatermark("ts", lateness)).drop("flag")  # it follows from how often a key was emitted
    first = events.sparkSession.createDataFrame([], rows.schema).withColumns({"batch": F.lit(-1).cast("long"), "times": F.lit(0).cast("long")})
    first.write.mode("ignore").parquet(f"{log}/states/state=-1")

    def upsert(batch: DataFrame, number: int) -> None:
        batch.withColumn("times", F.lit(1).cast("long")).write.mode("overwrite").parquet(f"{log}/changes/batch={number}")
        if number % compact_every == compact_every - 1:
            merged(batch.sparkSession, log, number).write.mode("overwrite").parquet(f"{log}/states/state={number}")
            forget(batch.sparkSession, log, number, compact_every)

    return rows.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def finished(spark: SparkSession, log: str, upto: int) -> list[int]:
    """Numbers of the states before this batch whose writing has ended, the last first."""
    there = spark.read.parquet(f"{log}/states").where(F.col("state") < upto).select("state").distinct().collect()  # of the last two, and -1
    return sorted({-1} | {r[0] for r in there if exists(spark, f"{log}/states/state={r[0]}/_SUCCESS")}, reverse=True)


def merged(spark: SparkSession, log: str, upto: int) -> DataFrame:
    """The last row of each key, with its batch and how often it was emitted, after this batch: from the last state before it."""
    last = finished(spark, log, upto)[0]
    before = spark.read.parquet(f"{log}/states/state={last}")
    since = spark.read.schema(before.schema).parquet(f"{log}/changes").where((F.col("batch") > last) & (F.col("batch") <= upto))
    rest = [c for c in before.columns if c not in (*KEY, "times", "batch")]
    # column by column: numbers are kept in a hash table, where a struct would have to be sorted for
    rows = before.unionByName(since).groupBy(*KEY).agg(*[F.max_by(c, "batch").alias(c) for c in rest], F.max("batch").alias("batch"), F.sum("times").alias("times"))
    return rows.select(*before.columns)


def forget(spark: SparkSession, log: str, number: int, compact_every: int) -> None:
    """Removes what no reader needs: changes that are in the state before the last, and states before that one."""
    before = number - compact_every
    if before >= 0:
        for batch in range(before - compact_every + 1, before + 1):
            remove(spark, f"{log}/changes/batch={batch}")
        if before - compact_every >= 0:
            remove(spark, f"{log}/states/state={before - compact_every}")


def final_state(spark: SparkSession, log: str) -> DataFrame:
    """Last row of each key with its flag."""
    rows = merged(spark, log, (1 << 62))
    return rows.withColumn("flag", F.when(F.col("times") == 1, "new").otherwise("updated")).drop("times", "batch")


def run_to_end(events: DataFrame, windows: Callable[[DataFrame], DataFrame], lateness: str = ALLOWED_LATENESS) -> DataFrame:
    """All that the source has now, and the state after it. Update mode: append would hold back open windows."""
    spark = events.sparkSession
    log, checkpoint = fresh_path(spark, "window-log"), fresh_path(spark, "window-offsets")
    stream_windows(events, windows, log, checkpoint, lateness).awaitTermination()
    return final_state(spark, log)
