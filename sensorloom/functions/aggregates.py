"""Column builders for exact aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_mean(total: Column, count: Column, scale: int | None = 2) -> Column:
    """total / count, rounded once to `scale` decimals, half away from zero; None: a double, not rounded."""
    return total / count if scale is None else F.round(total / count, scale).cast(f"decimal(18,{scale})")


def exact_avg(value: Column, scale: int | None = 2) -> Column:
    """Mean of decimals, rounded once: avg() would round twice. scale None: of doubles, NaN and infinities included."""
    return rounded_mean(F.sum(value), F.count(value), scale)


def sorted_values(value: Column) -> Column:
    return F.sort_array(F.collect_list(value))


def nearest_rank(ordered: Column, percent: int) -> Column:
    """Element ceil(percent/100 * n) of a sorted array, counted from 1, in integer arithmetic."""
    n = F.size(ordered)
    return F.element_at(ordered, F.greatest(((n * percent + 99) / 100).cast("int"), F.lit(1)))
