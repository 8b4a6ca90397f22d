"""Hot sensors apart from the rest, so that no task gets the values of one that holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.combine import all_windows, union_of_both
from sensorloom.operators.windows import both_in_blocks, sliding_counted, tumbling_stats

#: Items that the sketch keeps at most. Its error is 3.5 / TRACKED of all rows, so no sensor of SHARE is missed.
TRACKED = 65_536
SHARE = 1 / 1000


def hot_sensors(events: DataFrame, share: float = SHARE) -> DataFrame:
    """sensor_id and n, its rows, of the sensors with at least this share of all rows: at most 1 / share, whatever the data.

    A frequent-items sketch of bounded size finds who might be one; these are counted. Both combine before they move.
    """
    if share < 4 / TRACKED * 3.5:
        raise ValueError("the sketch is too small for this share")
    most = int(1 / share)
    found = events.agg(F.expr(f"approx_top_k(sensor_id, {2 * most}, {TRACKED})").alias("top"), F.count("*").alias("all"))
    might = found.select(F.explode("top").alias("t"), "all").select("t.item", "all")
    counted = events.join(F.broadcast(might), events.sensor_id == might.item, "left_semi").groupBy("sensor_id").agg(F.count("*").alias("n"))
    total = events.agg(F.count("*").alias("all"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("all") * share).select("sensor_id", "n")


def split_by_heat(events: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """The events of hot sensors, and the others. The hot ones are at most 1 / share names, which the driver gets."""
    names = [r[0] for r in hot_sensors(events, share).select("sensor_id").collect()]
    is_hot = F.col("sensor_id").isin(names) if names else F.lit(False)
    return events.where(is_hot), events.where(~is_hot)


def windows_by_heat(events: DataFrame, n: int = 5, slide_ms: int = 60_000, share: float = SHARE) -> DataFrame:
    """Both window kinds, as from union_of_both: hot sensors by counts of their values, which combine before the shuffle, the
    others in blocks with one shuffle (batch). A block's values are held by one task, but are less than `share` of all rows.
    """
    hot, rest = split_by_heat(events, share)
    slide = f"{slide_ms} milliseconds"
    counted = all_windows(tumbling_stats(hot, slide), sliding_counted(hot, n, slide, slide_ms))
    return union_of_both(both_in_blocks(rest, n, slide_ms)).unionByName(counted)
