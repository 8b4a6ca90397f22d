"""Result rows as text lines, with the decimals of their columns, two for doubles.

tumbling,<startMs>,<sensor>,<count>,<sum>,<min>,<max>,<avg>,<flag>
sliding,<startMs>,<sensor>,<p50>,<p99>,<flag>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import scale_of, text_of

STATS, RANKS = ("sum_value", "min_value", "max_value", "avg_value"), ("p50", "p99")


def _joined(kind: str, *parts: Column) -> Column:
    return F.concat_ws(",", F.lit(kind), F.col("window_start_ms").cast("string"), "sensor_id", *parts)


def _texts(rows: DataFrame, *columns: str) -> list[Column]:
    return [text_of(F.col(c), scale_of(rows, c)) for c in columns]


def _sliding(rows: DataFrame, flag: Column) -> Column:
    return _joined("sliding", *_texts(rows, *RANKS), flag)


def _tumbling(rows: DataFrame, flag: Column, prefix: str = "") -> Column:
    return _joined("tumbling", F.col(f"{prefix}cnt").cast("string"), *_texts(rows, *(prefix + c for c in STATS)), flag)


def lines_of_both(rows: DataFrame) -> DataFrame:
    """Lines of both kinds from the rows of both_from_panes."""
    new = F.lit("new")
    tumbling = F.when(F.col("tumbling").isNotNull(), _tumbling(rows, new, "tumbling."))
    return rows.select(F.explode(F.array_compact(F.array(_sliding(rows, new), tumbling))).alias("line"))


def tumbling_lines(rows: DataFrame) -> DataFrame:
    return rows.select(_tumbling(rows, F.col("flag")).alias("line"))


def sliding_lines(rows: DataFrame) -> DataFrame:
    return rows.select(_sliding(rows, F.col("flag")).alias("line"))


def to_lines(tumbling: DataFrame, sliding: DataFrame) -> DataFrame:
    return sliding_lines(sliding).union(tumbling_lines(tumbling))


def line_of(windows: DataFrame) -> Column:
    """The line of a row of all_windows."""
    flag = F.col("flag")
    return F.when(F.col("window_type") == "sliding", _sliding(windows, flag)).otherwise(_tumbling(windows, flag))


def lines_in_order(windows: DataFrame) -> DataFrame:
    """Lines of the rows of all_windows, in their order."""
    return windows.select(line_of(windows).alias("line"))
