"""Seeded synthetic events, made in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import sensor_name
from sensorloom.session import utc

#: Named sizes of the generator.
SIZES = {"10m": 10_000_000, "50m": 50_000_000, "100m": 100_000_000, "200m": 200_000_000}


def event_count(size: str | int) -> int:
    return SIZES.get(str(size).lower()) or int(size)


def generate_events(spark: SparkSession, size: str | int, sensors: int = 1000, seed: int = 42, late: float = 0.05, day: str = "2025-01-01T00:00:00Z", partitions: int | None = None, numbered: bool = False) -> DataFrame:
    """Events spread over one day with 15 s of jitter, a share of them 1 to 10 whole minutes late.

    Values are normal with mean 20 and deviation 10, at two decimals. Rows depend on seed and partitions.
    numbered: with `event_id`, which rises with the time before jitter and lateness.
    """
    n = event_count(size)
    ids = utc(spark).range(0, n, 1, partitions) if partitions else utc(spark).range(n)
    placed = F.floor(F.col("id") * 86_400.0 / max(n, 1) + F.randn(seed) * 15)
    second = F.least(F.greatest(placed, F.lit(0)), F.lit(86_399))
    drawn = ids.select(
        F.col("id").alias("event_id"),
        second.cast("long").alias("second"),
        (F.rand(seed + 1) < late).alias("is_late"),
        (F.floor(F.rand(seed + 2) * 10) + 1).alias("back"),
        F.floor(F.rand(seed + 3) * sensors).alias("sensor"),
        (F.randn(seed + 4) * 10 + 20).cast("decimal(18,2)").alias("value"),
    )
    start = F.unix_seconds(F.to_timestamp(F.lit(day)))
    shift = F.when(F.col("is_late"), F.col("back") * 60).otherwise(0)
    own = ["event_id"] if numbered else []
    return drawn.select(*own, F.timestamp_seconds(start + F.col("second") - shift).alias("ts"), sensor_name(F.col("sensor")).alias("sensor_id"), "value")


def event_lines(events: DataFrame) -> DataFrame:
    """Text lines that parse_lines reads back."""
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.select(F.concat_ws(",", when, "sensor_id", F.col("value").cast("string")).alias("value"))
