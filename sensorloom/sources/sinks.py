"""Text output of rendered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, ordered: bool = False) -> None:
    """One text file for each partition; `ordered` sorts the lines over all files (a range shuffle)."""
    out = lines.select("line")
    (out.orderBy("line") if ordered else out).write.mode("overwrite").text(path)


def write_with_manifest(lines: DataFrame, path: str) -> DataFrame:
    """Lines that have an order (orderBy) as several files that are one text: file, offset and length of each, also below `_manifest`.

    Files are written at once, a range of the order each, and their names sort as the ranges do. Lengths come from the file system;
    an offset is the sum of those before, a row for each file.
    """
    spark = lines.sparkSession
    lines.select("line").write.mode("overwrite").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    before = F.sum("length").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    made = files.select("file", F.coalesce(before, F.lit(0)).alias("offset"), "length")
    made.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")
