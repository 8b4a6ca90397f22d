"""Sums of doubles that don't depend on the order of addition.

Each double is a whole number times a power of two. Numbers whose exponents share a bin of 32 are added as whole numbers in a
DECIMAL(38), which can't round; a group has 67 bins at most, which combine before they move. The bins of a group are then added
exactly and rounded once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.ordering import magnitude_bits

BIN = 32
#: The exponent of the smallest double's unit.
LOWEST = -1074


def _split(x: Column) -> tuple[Column, Column]:
    """Bin and whole number of a finite double: x = number * 2^(BIN * bin + LOWEST)."""
    bits = magnitude_bits(x)
    exponent = F.shiftright(bits, 52)
    mantissa = bits.bitwiseAND(F.lit((1 << 52) - 1)) + F.when(exponent > 0, F.lit(1 << 52)).otherwise(F.lit(0))
    up = F.greatest(exponent - 1, F.lit(0))
    power = F.element_at(F.array(*[F.lit(1 << i).cast("decimal(10,0)") for i in range(BIN)]), (up % BIN + 1).cast("int"))
    number = (mantissa.cast("decimal(16,0)") * power).cast("decimal(27,0)")
    return F.floor(up / BIN).cast("int"), F.when(x < 0, -number).otherwise(number)


def _rounded(bins: list, numbers: list, count: int) -> float:
    """The sum of the bins over count, to the nearest double, ties to even."""
    total = sum(int(n) << (BIN * int(b)) for b, n in zip(bins, numbers))
    try:
        return total / (count << -LOWEST)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


@F.pandas_udf(T.StructType([T.StructField("sum_value", T.DoubleType()), T.StructField("avg_value", T.DoubleType())]))
def _total_and_mean(bins: pd.Series, numbers: pd.Series, count: pd.Series) -> pd.DataFrame:
    rows = [(_rounded(b, n, 1), _rounded(b, n, int(c))) for b, n, c in zip(bins, numbers, count)]
    return pd.DataFrame(rows, columns=["sum_value", "avg_value"])


def exact_sums(rows: DataFrame, keys: list[Column], value: str = "value") -> DataFrame:
    """keys, cnt, sum_value and avg_value of each group's doubles: exact, rounded once, whatever the partitions or the order.

    Nulls don't count. NaN, or infinities of both signs, give NaN; infinities of one sign themselves. A group of null values only
    isn't there. A sum beyond the largest double is infinite, though its mean may not be. The keys need names.
    """
    x = F.col(value).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    at, number = _split(F.when(finite, x).otherwise(0.0))
    named = rows.where(x.isNotNull()).select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], x.alias("x"), at.alias("bin"), number.alias("number"))
    by = [f"k{i}" for i in range(len(keys))]
    flags = [F.count_if(F.isnan("x")).alias("nans"), F.count_if(F.col("x") == float("inf")).alias("ups"), F.count_if(F.col("x") == float("-inf")).alias("downs")]
    binned = named.groupBy(*by, "bin").agg(F.sum("number").cast("decimal(38,0)").alias("number"), F.count("*").alias("n"), *flags)
    grouped = binned.groupBy(*by).agg(F.collect_list("bin").alias("bins"), F.collect_list(F.col("number").cast("string")).alias("numbers"), F.sum("n").alias("cnt"), *[F.sum(c).alias(c) for c in ("nans", "ups", "downs")])
    odd = F.when((F.col("nans") > 0) | (F.col("ups") > 0) & (F.col("downs") > 0), float("nan")).when(F.col("ups") > 0, float("inf")).when(F.col("downs") > 0, float("-inf"))
    made = grouped.withColumn("r", _total_and_mean("bins", "numbers", "cnt"))
    names = [rows.select(k).columns[0] for k in keys]
    return made.select(*[F.col(b).alias(n) for b, n in zip(by, names)], "cnt", F.coalesce(odd, "r.sum_value").alias("sum_value"), F.coalesce(odd, "r.avg_value").alias("avg_value"))
