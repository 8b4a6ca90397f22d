"""Both window kinds together, their order, and comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.operators.difference import difference
from sensorloom.session import parts_for, written

#: Sliding before tumbling, then by start and sensor.
ORDER = ("window_type", "window_start_ms", "sensor_id")


def all_windows(tumbling: DataFrame, sliding: DataFrame) -> DataFrame:
    """Typed union; columns of the other kind are null."""
    return sliding.drop("cnt").unionByName(tumbling, allowMissingColumns=True)


def union_of_both(rows: DataFrame) -> DataFrame:
    """The same typed union from the rows of both_from_panes: a row becomes one or two, and nothing is read again."""
    stats = [f.name for f in rows.schema["tumbling"].dataType.fields]
    kinds = {f.name: f.dataType for f in rows.schema["tumbling"].dataType.fields} | {c: rows.schema[c].dataType for c in ("p50", "p99")}
    none = {c: F.lit(None).cast(t) for c, t in kinds.items()}
    struct = lambda kind, own: F.struct(F.lit(kind).alias("window_type"), *[own.get(c, none[c]).alias(c) for c in ("p50", "p99", *stats)])
    sliding = struct("sliding", {c: F.col(c) for c in ("p50", "p99")})
    tumbling = F.when(F.col("tumbling").isNotNull(), struct("tumbling", {c: F.col(f"tumbling.{c}") for c in stats}))
    each = rows.select("window_start_ms", "sensor_id", F.explode(F.array_compact(F.array(sliding, tumbling))).alias("w"))
    return each.select("w.window_type", "window_start_ms", "sensor_id", "w.p50", "w.p99", F.lit("new").alias("flag"), *[f"w.{c}" for c in stats])


def ordered(windows: DataFrame) -> DataFrame:
    """Sliding before tumbling, then by start and sensor: a range shuffle."""
    return windows.orderBy(*ORDER)


def numbered(windows: DataFrame, weight: Column | None = None, name: str = "offset") -> DataFrame:
    """The windows with `position`, from 1, in this order; with a weight, also the sum of those before, from 0, as `name`.

    Ranges of the order are written with their number; each sums up for itself and begins after those before it. There are as many
    as the rows need, and each is numbered in a task of its own, so a task's memory doesn't grow with the rows.
    """
    spark, names = windows.sparkSession, windows.columns
    rows = written(windows, "windows")  # made once; their number says how many ranges there are
    ranges = parts_for(spark, rows.count())
    numbered_ranges = written(rows.repartitionByRange(ranges, *ORDER).withColumn("range", F.spark_partition_id()), "window-ranges")
    weighed = numbered_ranges if weight is None else numbered_ranges.withColumn("weight", weight)
    sums = {"position": F.count("*")} | ({} if weight is None else {name: F.sum("weight")})
    whole = weighed.groupBy("range").agg(*[x.alias(f"{c}_own") for c, x in sums.items()])
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = whole.select("range", *[F.coalesce(F.sum(f"{c}_own").over(before), F.lit(0)).alias(f"{c}_before") for c in sums])  # a row for each range
    own = W.partitionBy("range").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    placed = weighed.repartitionByRange(ranges, "range").join(F.broadcast(starts), "range").withColumn("position", F.col("position_before") + F.count("*").over(own))
    if weight is not None:
        placed = placed.withColumn(name, F.col(f"{name}_before") + F.sum("weight").over(own) - F.col("weight"))
    return placed.select(*names, "position", *([] if weight is None else [name]))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether both hold the same rows as often; columns are matched by name. Only sums of hashes move, unless there is a difference."""
    return sorted(left.columns) == sorted(right.columns) and difference(left, right, [left.columns[0]]).isEmpty()
