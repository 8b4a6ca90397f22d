import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from sensorloom import operators as O
from sensorloom.functions import exact_sums

MAX = 1.7976931348623157e308


def nearest(x: Fraction) -> float:
    try:
        return x.numerator / x.denominator
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def test_sums_are_exact_in_any_order(spark):
    """Cancellation, all magnitudes, subnormals, overflow, one value; NaN and infinities; the same bits under any partitioning."""
    r = random.Random(3)
    groups = {
        "cancel": [1e16, 1.0, -1e16, 1e-300, 3.5, -1e300, 1e300],
        "magnitudes": [r.choice([-1, 1]) * 10.0 ** r.uniform(-320, 300) for _ in range(400)],
        "tiny": [5e-324] * 7 + [-5e-324] * 2,
        "large": [MAX] * 5,
        "tenths": [0.1] * 1000,
        "tie": [1.0, 2.0**-53, 2.0**-53 * 3],
        "one": [-0.3],
        "zero": [0.0, -0.0],
    }
    odd = {"nan": [1.0, math.nan], "both": [math.inf, -math.inf, 1.0], "up": [math.inf, 2.0], "down": [-math.inf, -2.0]}
    rows = [(k, x) for k, v in (groups | odd).items() for x in v] + [("one", None), ("null", None)]
    want = {k: (len(v), nearest(sum(map(Fraction, v))), nearest(sum(map(Fraction, v)) / len(v))) for k, v in groups.items()}
    want |= {"nan": (2, "nan", "nan"), "both": (3, "nan", "nan"), "up": (2, math.inf, math.inf), "down": (2, -math.inf, -math.inf)}
    for seed, parts in ((1, 1), (2, 7)):
        random.Random(seed).shuffle(rows)
        got = exact_sums(spark.createDataFrame(rows, "k string, value double").repartition(parts), [F.col("k")]).collect()
        plain = lambda x: "nan" if x != x else x
        assert {r["k"]: (r["cnt"], plain(r["sum_value"]), plain(r["avg_value"])) for r in got} == want


def test_difference_of_a_million_rows(spark):
    """One changed, one doubled, one missing row of a million: found, and only their leaves are opened."""
    left = spark.range(1_000_000).select("id", (F.col("id") % 97).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("w"))
    right = left.where("id <> 700001").withColumn("v", F.when(F.col("id") == 1234, -1).otherwise(F.col("v"))).union(left.where("id = 99"))
    found = O.differing_leaves(left, right, ["id"])
    assert len(found) == 3
    got = {(r["id"], r["v"], r["side"], r["times"]) for r in O.difference(left, right.select("w", "id", "v"), ["id"]).collect()}
    assert got == {(700001, 700001 % 97, "left", 1), (1234, 1234 % 97, "left", 1), (1234, -1, "right", 1), (99, 2, "right", 1)}
    opened = left.where(F.expr("shiftrightunsigned(xxhash64(id), 48)").cast("int").isin(found)).count()
    assert opened < 200
    assert O.same_rows(left, left.repartition(3)) and not O.same_rows(left, right)
    assert O.same_rows(left.limit(0), left.limit(0)) and not O.same_rows(left.limit(0), left.limit(1))
