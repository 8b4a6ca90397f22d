"""Event-time windows over (ts, sensor_id, value).

Windows are half-open and aligned to the epoch; windows without events don't appear, and partial
windows at either end do. Before the epoch they go on in the same steps, with negative starts; `from_epoch`
leaves them out. Values are decimals, whose scale means and ranks keep, or doubles, whose means are not rounded
and where NaN is the largest. Every function works on batch and streaming frames unless it says otherwise.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import exact_avg, nearest_rank, rounded_mean, scale_of, sorted_values
from sensorloom.operators.selection import MOST, ranked_counts
from sensorloom.session import parts_for, written

MINUTE, FIVE = "1 minute", "5 minutes"


def start_ms(window: Column) -> Column:
    return F.unix_millis(window["start"])


def _packed(value: Column, scale: int | None) -> Column:
    """Whole units of the last decimal: arrays of longs are sorted and joined as primitives."""
    return value if scale is None else (value * 10**scale).cast("long")


def _unpacked(units: Column, scale: int | None) -> Column:
    return units if scale is None else (units.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(18,{scale})")


def _unit_sums(scale: int | None) -> list[Column]:
    """Statistics of `units`, whole numbers: sums in two halves of longs, which are added faster than decimals and can't overflow."""
    if scale is None:
        return [F.count("*").alias("cnt"), F.sum("units").alias("sum_value"), F.min("units").alias("min_value"), F.max("units").alias("max_value")]
    upper, lower = F.shiftright("units", 32), F.col("units").bitwiseAND(F.lit((1 << 32) - 1))
    return [F.count("*").alias("cnt"), F.sum(upper).alias("upper"), F.sum(lower).alias("lower"), F.min("units").alias("min_value"), F.max("units").alias("max_value")]


def _with_stats(rows: DataFrame, scale: int | None) -> DataFrame:
    """sum_value, min_value and max_value as decimals again."""
    if scale is None:
        return rows
    total = (F.col("upper").cast("decimal(19,0)") * F.lit(Decimal(1 << 32)) + F.col("lower").cast("decimal(19,0)")) * F.lit(Decimal(1).scaleb(-scale))
    return rows.withColumns({"sum_value": total.cast(f"decimal(28,{scale})"), "min_value": _unpacked(F.col("min_value"), scale), "max_value": _unpacked(F.col("max_value"), scale)}).drop("upper", "lower")


def assign_windows(events: DataFrame, size: str = FIVE, slide: str = MINUTE) -> DataFrame:
    """A row for each event and window that holds it."""
    return events.withColumn("w", F.window("ts", size, slide)).withColumn("window_start_ms", start_ms(F.col("w"))).drop("w")


def from_epoch(windows: DataFrame) -> DataFrame:
    """The windows that don't begin before the epoch."""
    return windows.where("window_start_ms >= 0")


def within_horizon(events: DataFrame, base: str, minutes: int = 1500) -> DataFrame:
    """Events from `base` on, for so many minutes; a filter that reaches the scan."""
    low = F.to_timestamp(F.lit(base))
    return events.where((F.col("ts") >= low) & (F.col("ts") < low + F.expr(f"INTERVAL {int(minutes)} MINUTES")))


def tumbling_stats(events: DataFrame, size: str = MINUTE) -> DataFrame:
    """Count, sum, min, max and mean of each sensor and window; partial sums are made before the shuffle."""
    return (
        events.groupBy(F.window("ts", size).alias("w"), "sensor_id")
        .agg(F.count("*").alias("cnt"), F.sum("value").alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), exact_avg(F.col("value"), scale_of(events, "value")).alias("avg_value"))
        .select(F.lit("tumbling").alias("window_type"), start_ms(F.col("w")).alias("window_start_ms"), "sensor_id", "cnt", "sum_value", "min_value", "max_value", "avg_value", F.lit("new").alias("flag"))
    )


def _ranked(grouped: DataFrame, start: Column, ordered: Column, scale: int | None = None) -> DataFrame:
    rank = lambda p: _unpacked(nearest_rank(ordered, p), scale)
    return grouped.select(F.lit("sliding").alias("window_type"), start.alias("window_start_ms"), "sensor_id", rank(50).alias("p50"), rank(99).alias("p99"), F.size(ordered).cast("long").alias("cnt"), F.lit("new").alias("flag"))


def sliding_percentiles(events: DataFrame, size: str = FIVE, slide: str = MINUTE) -> DataFrame:
    """Exact nearest-rank p50 and p99: events are dealt to their windows, then one sorted array is indexed twice.

    For small or sparse data and streams: every event moves once for each of its windows, and a window's values of one
    sensor are held in memory. sliding_in_blocks moves an event about once; for hot sensors use windows_by_heat.
    """
    grouped = events.groupBy(F.window("ts", size, slide).alias("w"), "sensor_id").agg(sorted_values(F.col("value")).alias("v"))
    return _ranked(grouped, start_ms(F.col("w")), F.col("v"))


def sliding_percentiles_disc(events: DataFrame, size: str = FIVE, slide: str = MINUTE) -> DataFrame:
    """The same by Spark's own percentile_disc: slower, an independent check. It reckons in doubles, so with 15 digits."""
    scale = scale_of(events, "value")
    kind = "DOUBLE" if scale is None else f"DECIMAL(18,{scale})"
    rank = lambda p: F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY value) AS {kind})")
    grouped = events.groupBy(F.window("ts", size, slide).alias("w"), "sensor_id").agg(rank(0.5).alias("p50"), rank(0.99).alias("p99"), F.count("*").alias("cnt"))
    return grouped.select(F.lit("sliding").alias("window_type"), start_ms(F.col("w")).alias("window_start_ms"), "sensor_id", "p50", "p99", "cnt", F.lit("new").alias("flag"))


def panes(events: DataFrame, slide: str = MINUTE) -> DataFrame:
    """One row for each sensor and pane: count, sum, min, max and the values. Both window kinds can be made from it.

    pane_values has decimals as whole units of their last place (1.25 as 125), doubles as they are.
    """
    scale = scale_of(events, "value")
    units = events.select("ts", "sensor_id", _packed(F.col("value"), scale).alias("units"))
    return (
        _with_stats(units.groupBy(F.window("ts", slide).alias("w"), "sensor_id").agg(*_unit_sums(scale), F.collect_list("units").alias("pane_values")), scale)
        .select(start_ms(F.col("w")).alias("pane_ms"), "sensor_id", "cnt", "sum_value", "min_value", "max_value", "pane_values")
    )


def sliding_from_panes(pane_rows: DataFrame, n: int = 5, slide_ms: int = 60_000) -> DataFrame:
    """Sliding percentiles from panes (batch): a pane's values move once as a list to each of its n windows.

    Pays on dense data, where a pane has many values; on sparse data sliding_percentiles is faster.
    """
    scale = scale_of(pane_rows, "min_value")
    dealt = pane_rows.select("sensor_id", "pane_values", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), "pane_ms")
    grouped = dealt.groupBy((F.col("pane_ms") - F.col("k") * slide_ms).alias("start"), "sensor_id").agg(F.sort_array(F.flatten(F.collect_list("pane_values"))).alias("v"))
    return _ranked(grouped, F.col("start"), F.col("v"), scale)


def _own_stats(k: Column) -> Column:
    return F.when(k == 0, F.struct("cnt", "sum_value", "min_value", "max_value"))


def _both(grouped: DataFrame, start: Column, scale: int | None) -> DataFrame:
    """grouped: sensor_id, v (sorted values) and own, the statistics of the window's first pane."""
    mean = rounded_mean(F.col("own.sum_value"), F.col("own.cnt"), scale)
    rank = lambda p: _unpacked(nearest_rank(F.col("v"), p), scale)
    return grouped.select(start.alias("window_start_ms"), "sensor_id", rank(50).alias("p50"), rank(99).alias("p99"), F.when(F.col("own").isNotNull(), F.struct("own.*", mean.alias("avg_value"))).alias("tumbling"))


def both_from_panes(pane_rows: DataFrame, n: int = 5, slide_ms: int = 60_000) -> DataFrame:
    """Sliding percentiles and, as the struct `tumbling`, the statistics of the pane that starts with the window; null if none does.

    One pass gives both window kinds: the pane's statistics travel with its values to the first of its windows (batch).
    For panes that are there already; from events, both_in_blocks needs one shuffle less.
    """
    dealt = pane_rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select((F.col("pane_ms") - F.col("k") * slide_ms).alias("start"), "sensor_id", "pane_values", _own_stats(F.col("k")).alias("own"))
    grouped = dealt.groupBy("start", "sensor_id").agg(F.sort_array(F.flatten(F.collect_list("pane_values"))).alias("v"), F.max("own").alias("own"))
    return _both(grouped, F.col("start"), scale_of(pane_rows, "min_value"))


def _grouped_in_blocks(events: DataFrame, n: int, slide_ms: int, span: int) -> DataFrame:
    """sensor_id, block, start (in slides), v (a window's sorted values) and own, the statistics of its first pane; one shuffle."""
    scale = scale_of(events, "value")
    pane = F.floor(F.unix_millis("ts") / slide_ms)
    block = lambda x: F.floor(x / span)
    units = events.select("sensor_id", _packed(F.col("value"), scale).alias("units"), pane.alias("pane"))
    # a number of its own: adaptive execution would merge small shuffles of events, though n times their rows follow in the same stage
    shuffles = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.withColumn("block", F.explode(F.sequence(block(F.col("pane") - (n - 1)), block(F.col("pane"))))).repartition(shuffles, "sensor_id", "block")
    made = _with_stats(dealt.groupBy("sensor_id", "block", "pane").agg(*_unit_sums(scale), F.collect_list("units").alias("pane_values")), scale)
    starts = made.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("start", F.col("pane") - F.col("k")).where(block(F.col("start")) == F.col("block"))
    return starts.groupBy("sensor_id", "block", "start").agg(F.sort_array(F.flatten(F.collect_list("pane_values"))).alias("v"), F.max(_own_stats(F.col("k"))).alias("own"))


def both_in_blocks(events: DataFrame, n: int = 5, slide_ms: int = 60_000, span: int = 60) -> DataFrame:
    """The rows of both_from_panes from events, with one shuffle (batch).

    Events are dealt to blocks of `span` windows of a sensor, the first n - 1 panes of a block to the one before too:
    1 + (n - 1) / span copies move. Panes and windows are then made where a block's events are. A hot sensor is as
    many groups as it has blocks; a block's values are held by one task, so for sensors with more use windows_by_heat.
    """
    return _both(_grouped_in_blocks(events, n, slide_ms, span), F.col("start") * slide_ms, scale_of(events, "value"))


def sliding_in_blocks(events: DataFrame, n: int = 5, slide_ms: int = 60_000, span: int = 60) -> DataFrame:
    """The rows of sliding_percentiles, moved as both_in_blocks moves them: about once instead of n times (batch)."""
    return _ranked(_grouped_in_blocks(events, n, slide_ms, span).drop("own"), F.col("start") * slide_ms, F.col("v"), scale_of(events, "value"))


def sliding_counted(events: DataFrame, n: int = 5, slide: str = MINUTE, slide_ms: int = 60_000) -> DataFrame:
    """Sliding percentiles from counts of distinct values (batch), for hot sensors.

    Counts of (sensor, pane, value) combine before the shuffle, so what moves and what a window holds
    grows with the distinct values only. The rank comes from running counts, never from a list. The counts are written once;
    their number says into how many partitions windows are dealt.
    """
    pane = F.floor(F.unix_millis("ts") / slide_ms).alias("pane")
    counted = written(events.groupBy("sensor_id", pane, "value").agg(F.count("*").alias("c")), "pane-counts")
    size = counted.groupBy("sensor_id", "pane").count().agg(F.max("count").alias("widest"), F.sum("count").alias("rows")).first()  # widest: distinct values of a pane; windows have n times that at most
    dealt = counted.select("sensor_id", "value", "c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), "pane").select("sensor_id", "value", "c", ((F.col("pane") - F.col("k")) * slide_ms).alias("window_start_ms"))
    grouped = ranked_counts(dealt, ["window_start_ms", "sensor_id"], few_values=n * (size["widest"] or 0) <= MOST, parts=parts_for(events.sparkSession, n * (size["rows"] or 0)))
    return grouped.select(F.lit("sliding").alias("window_type"), "window_start_ms", "sensor_id", "p50", "p99", "cnt", F.lit("new").alias("flag"))


def pane_states(events: DataFrame, slide: str = MINUTE) -> DataFrame:
    """Panes with their sorted values as text."""
    joined = F.concat_ws(" ", F.transform(F.sort_array("pane_values"), lambda v: _unpacked(v, scale_of(events, "value")).cast("string")))
    return panes(events, slide).select("pane_ms", "sensor_id", "cnt", "sum_value", "min_value", "max_value", joined.alias("sorted_values"))


def key_domain(events: DataFrame) -> DataFrame:
    """First and last minute, sensors and events."""
    minute = F.unix_millis(F.date_trunc("minute", "ts"))
    return events.agg(F.min(minute).alias("min_minute_ms"), F.max(minute).alias("max_minute_ms"), F.countDistinct("sensor_id").alias("sensors"), F.count("*").alias("events"))
