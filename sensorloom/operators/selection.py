"""Exact nearest ranks by selection: values become order-preserving whole numbers, and each rank is narrowed down to a
few of them by their leading bits, level by level. Whatever the range of the values, a task gets at most about `most`
cells, or `most` distinct values, of a group; never a list of all its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sensorloom.functions import scale_of
from sensorloom.functions.ordering import order_key
from sensorloom.session import written

#: Cells of a level, and distinct values that are ranked one by one.
MOST = 4096
#: So many rows of a few numbers each may be broadcast.
FEW = 100_000


def _key_of(counted: DataFrame) -> Column:
    kind = counted.schema["value"].dataType
    return F.col("value").cast("long") if isinstance(kind, IntegralType) else order_key(F.col("value"), scale_of(counted, "value"))


def keyed(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, c and _key, a row for each distinct value of a group. The counts combine before they move."""
    return counted.groupBy(*keys, "value").agg(F.sum("c").alias("c")).withColumn("_key", _key_of(counted))


def _open(rows: DataFrame, keys: list[str], percents: tuple[int, ...], most: int) -> DataFrame:
    """For each group of over `most` values and each percent: the rank, from 1, and the range of keys that holds it."""
    sizes = rows.groupBy(*keys).agg(F.sum("c").alias("total"), F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).where(F.col("n") > most)
    return sizes.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).withColumn("need", F.expr("(total * p + 99) DIV 100"))


def _within(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is in a range of their group. Groups share no task by force: adaptive execution may split them."""
    return rows.join(F.broadcast(state) if state.count() <= FEW else state, keys).where(F.col("_key").between(F.col("lo"), F.col("hi")))


def cells_of(rows: DataFrame, state: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """Counts by the leading bits of the keys within each range: at most about `most` cells of a range."""
    bits = F.ceil(F.log2(F.col("hi").cast("double") - F.col("lo").cast("double") + 1)).cast("int")
    shifted = _within(rows, state.withColumn("shift", F.greatest(bits - (most.bit_length() - 1), F.lit(0))), keys).withColumn("cell", F.expr("shiftright(_key, shift)"))
    return shifted.groupBy(*keys, "p", "need", "total", "cell").agg(F.sum("c").alias("own"), F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))


def narrowed(rows: DataFrame, keys: list[str], percents: tuple[int, ...] = (50, 99), most: int = MOST) -> DataFrame:
    """keys, p, need, total, lo, hi, n of the groups of over `most` values: ranges of at most `most` values that hold the ranks."""
    columns = [*keys, "p", "need", "total", "lo", "hi", "n"]
    state = written(_open(rows, keys, percents, most).select(columns), "rank-ranges")
    while not (todo := state.where(F.col("n") > most)).isEmpty():  # at most seven times: each level takes off the leading bits
        upto = F.sum("own").over(W.partitionBy(*keys, "p").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
        holds = (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("own") < F.col("need"))
        next_ = cells_of(rows, todo, keys, most).withColumn("upto", upto).where(holds).withColumn("need", F.col("need") - F.col("upto") + F.col("own"))
        state = written(next_.select(columns).union(state.where(F.col("n") <= most)), "rank-ranges")
    return state


def _least(condition: Column) -> Column:
    """The first value in order; NaN is the largest here too."""
    return F.min(F.when(condition, F.col("value")))


def _counted_through(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ranks of groups that have few distinct values, by running counts over these."""
    running = W.partitionBy(*keys).orderBy("_key").rowsBetween(W.unboundedPreceding, 0)
    upto = rows.select("*", F.sum("c").over(running).alias("upto"), F.sum("c").over(W.partitionBy(*keys)).alias("total"))
    at = lambda p: _least(F.col("upto") * 100 >= F.col("total") * p)
    return upto.groupBy(*keys).agg(at(50).alias("p50"), at(99).alias("p99"), F.max("total").alias("cnt"))


def ranked_counts(counted: DataFrame, keys: list[str], most: int = MOST, few_values: bool = False, parts: int | None = None) -> DataFrame:
    """Nearest-rank p50 and p99, and cnt, of each group of `keys` from rows of keys, value and c, how often it occurs (batch).

    The values may repeat; they are decimals, whole numbers or doubles, of which NaN is the largest. Groups of up to `most`
    distinct values are counted through at once; larger ones are narrowed first, for which the distinct values are written once.
    few_values: the caller has counted that no group has more. Repeated values then aren't merged: they move once, into `parts`
    partitions if it says how many.
    """
    if few_values:
        rows = counted.withColumn("_key", _key_of(counted))
        return _counted_through(rows.repartition(parts, *keys) if parts else rows, keys)
    rows = written(keyed(counted, keys), "rank-values")
    ranges = narrowed(rows, keys, (50, 99), most)
    if ranges.isEmpty():
        return _counted_through(rows, keys)
    large = ranges.select(*keys).distinct()
    small = rows.join(F.broadcast(large) if large.count() <= FEW else large, keys, "left_anti")
    running = W.partitionBy(*keys, "p").orderBy("_key").rowsBetween(W.unboundedPreceding, 0)
    upto = _within(rows, ranges, keys).withColumn("upto", F.sum("c").over(running))
    at = lambda p: _least((F.col("p") == p) & (F.col("upto") >= F.col("need")))
    return _counted_through(small, keys).unionByName(upto.groupBy(*keys).agg(at(50).alias("p50"), at(99).alias("p99"), F.max("total").alias("cnt")))
