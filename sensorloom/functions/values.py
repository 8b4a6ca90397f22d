"""Scalar column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType


def sensor_name(number: Column) -> Column:
    """`sensor_0042`; numbers of more than four digits keep them all."""
    digits = number.cast("long").cast("string")
    return F.concat(F.lit("sensor_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def scale_of(rows: DataFrame | StructType, column: str) -> int | None:
    """Decimals of a column, `outer.inner` for a field of a struct; None if it isn't a decimal."""
    kind = rows if isinstance(rows, StructType) else rows.schema
    for name in column.split("."):
        kind = kind[name].dataType
    return kind.scale if isinstance(kind, DecimalType) else None


def text_of(value: Column, scale: int | None = 2) -> Column:
    """`[-]I.FF`, half up; a zero has no sign. None: two decimals, of a double; NaN and infinities as words."""
    return F.coalesce(value.try_cast(f"decimal(38,{2 if scale is None else scale})").cast("string"), value.cast("string"))
