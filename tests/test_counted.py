import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.ordering import order_key
from sensorloom.operators import cells_of, keyed, narrowed, ranked_counts
from sensorloom.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["global_percentiles", *(f"{q}_{g}" for q in ("sliding_percentiles", "sliding_p50", "all_windows_union", "rendered_lines") for g in ("hourly", "daily"))])
def test_no_list_of_a_types_values(spark, name):
    assert "collect_list" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def bits(x):
    import struct

    b = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return (1 << 63) - 1 if x != x else -b if x < 0 else b


def test_keys_sort_as_doubles(spark):
    """Every exponent, with the doubles next to each power of two, zeros, infinities and NaN: the bits themselves."""
    r = random.Random(1)
    xs = [0.0, -0.0, math.inf, -math.inf, math.nan, 1.7976931348623157e308]
    for e in range(-1074, 1024):
        p = math.ldexp(1.0, e)
        xs += [p, math.nextafter(p, 0), math.nextafter(p, math.inf), -p, -p * r.random()]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", order_key(F.col("x"), None).alias("k")).collect()
    assert all(row["k"] == bits(row["x"]) for row in got)


def ranks(rows, of):
    """p50, p99 and count by sorting; NaN last."""
    v = sorted((x for k, x, c in rows if k == of for _ in range(c)), key=lambda x: (x != x, x))
    return (*(v[(len(v) * p + 99) // 100 - 1] for p in (50, 99)), len(v))


def test_ranks_from_counts(spark):
    """Repeated, negative and hot values, against sorted lists."""
    r = random.Random(1)
    rows = [(k, f"{r.choice([0, 1, 90, 5000]) * r.uniform(-1, 1):.2f}", r.randrange(1, 9)) for k in "abc" for _ in range(400)] + [("d", "7.00", 3), ("e", "-64.00", 1), ("e", "64.00", 1), ("a", "3.00", 5000)]
    df = spark.createDataFrame(rows, "k string, v string, c long").selectExpr("k", "CAST(v AS DECIMAL(18,2)) AS value", "c")
    want = {k: ranks([(k, Decimal(x), c) for k, x, c in rows], k) for k in "abcde"}
    for most in (4096, 64):
        assert {g["k"]: (g["p50"], g["p99"], g["cnt"]) for g in ranked_counts(df, ["k"], most).collect()} == want


@pytest.mark.parametrize("most", [64])
def test_any_range_in_bounded_cells(spark, most):
    """[0, 1), up to 10^12, all magnitudes, neighbours and far ones, NaN and infinities: right, in few cells."""
    r = random.Random(2)
    groups = {
        "unit": [r.random() for _ in range(700)],
        "wide": [r.uniform(0, 1e12) for _ in range(500)],
        "magnitudes": [r.choice([-1, 1]) * 10.0 ** r.uniform(-320, 308) for _ in range(500)],
        "close": [math.nextafter(1.0, 2) + i * 2.0**-52 for i in range(300)] + [-1e300, 1e300],
        "odd": [math.nan] * 40 + [math.inf] * 30 + [-math.inf] * 200 + [0.0, -0.0] + [r.gauss(0, 1) for _ in range(300)],
        "nan": [math.nan] * 9,
    }
    rows = [(k, v, r.randrange(1, 4)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, value double, c long")
    got = {g["k"]: (g["p50"], g["p99"], g["cnt"]) for g in ranked_counts(df, ["k"], most).collect()}
    assert {k: str(v) for k, v in got.items()} == {k: str(ranks(rows, k)) for k in groups}
    values = keyed(df, ["k"]).cache()
    state = narrowed(values, ["k"], (50, 99), most)
    assert {x["k"] for x in state.select("k").distinct().collect()} == {"unit", "wide", "magnitudes", "close", "odd"}
    assert state.agg(F.max("n")).first()[0] <= most
    whole = values.groupBy("k").agg(F.sum("c").alias("total"), F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).withColumns({"p": F.lit(50), "need": F.lit(1)})
    assert cells_of(values, whole, ["k"], most).groupBy("k").count().agg(F.max("count")).first()[0] <= 2 * most + 1
    values.unpersist()


def test_whole_numbers_and_no_rows(spark):
    df = spark.createDataFrame([("a", 2**62 + i, 1) for i in range(40)], "k string, value long, c long")
    assert [tuple(x) for x in ranked_counts(df, ["k"], 4).collect()] == [("a", 2**62 + 19, 2**62 + 39, 40)]
    assert ranked_counts(df.limit(0), ["k"]).collect() == []
