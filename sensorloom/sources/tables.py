"""Parquet tables as event streams: ts TIMESTAMP, sensor_id STRING, value DECIMAL(18,2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import sensor_name
from sensorloom.session import utc


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_events(df: DataFrame, key: str = "user_id", scale: int | None = 2) -> DataFrame:
    """Event columns from a table with ts, value and a key; rows without time, key or value go.

    `key`: user_id becomes a sensor name, any other column is taken as text. `scale`: decimals; None: doubles.
    """
    sensor = sensor_name(F.col(key)) if key == "user_id" else F.col(key).cast("string")
    return df.select(
        F.col("ts").cast("timestamp").alias("ts"),
        sensor.alias("sensor_id"),
        F.col("value").cast("double" if scale is None else f"decimal(18,{scale})").alias("value"),
    ).where("ts IS NOT NULL AND sensor_id IS NOT NULL AND value IS NOT NULL")


def read_events(spark: SparkSession, sf_dir: str, key: str = "user_id", scale: int | None = 2) -> DataFrame:
    return as_events(read_table(utc(spark), sf_dir, "events"), key, scale)


def stream_events(spark: SparkSession, sf_dir: str, key: str = "user_id", name: str = "events.parquet") -> DataFrame:
    """The same table as a stream of files."""
    schema = read_table(utc(spark), sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(sf_dir)
    return as_events(source, key)
