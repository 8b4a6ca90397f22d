"""What differs between two large results, by a two-level tree of multiset hashes.

Rows are dealt to leaves by a hash of their key, and leaves to branches. A leaf has its rows' number and the sum of their hashes,
which any order and partitioning gives alike and which combine before they move. Branches that agree are closed at once; only rows
of leaves that differ are read again and compared, so what is shuffled follows the difference, not the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the key's hash for branches and for leaves: at most 65,536 leaves of four numbers each.
BRANCH, LEAF = 8, 16


def _leaf(key: list[str]) -> Column:
    return F.expr(f"shiftrightunsigned(xxhash64({', '.join(f'`{k}`' for k in key)}), {64 - LEAF})").cast("int")


def leaves(rows: DataFrame, key: list[str]) -> DataFrame:
    """leaf, n, and two sums of the rows' hashes with different seeds, as decimals, which don't overflow."""
    columns = [F.col(c) for c in sorted(rows.columns)]
    hashes = (F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns))
    return rows.groupBy(_leaf(key).alias("leaf")).agg(F.count("*").alias("n"), *[F.sum(h.cast("decimal(20,0)")).alias(f"h{i}") for i, h in enumerate(hashes)])


def differing_leaves(left: DataFrame, right: DataFrame, key: list[str]) -> list[int]:
    """Leaves that differ, of branches that do; at most 2^LEAF numbers, and none if the tables hold the same rows."""
    sums = ("n", "h0", "h1")
    signed = leaves(left, key).unionByName(leaves(right, key).select("leaf", *[(-F.col(c)).alias(c) for c in sums]))
    leaf = signed.groupBy("leaf").agg(*[F.sum(c).alias(c) for c in sums])
    apart = lambda df: df.where(" OR ".join(f"{c} <> 0" for c in sums))
    differ = apart(leaf).withColumn("branch", F.shiftright("leaf", LEAF - BRANCH))
    return sorted(x for r in differ.groupBy("branch").agg(F.collect_list("leaf").alias("leaves")).collect() for x in r["leaves"])


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows that one side has more often, with `side` (left or right) and `times`, how much more often.

    key: columns that deal out the rows; equal rows have equal keys. Nulls are equal to each other. Columns are matched by name;
    those of the right side are taken in the left side's types.
    """
    right = right.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in left.schema])
    found = differing_leaves(left, right, key)
    opened = lambda df, sign: df.where(_leaf(key).isin(found) if found else F.lit(False)).withColumn("times", F.lit(sign).cast("long"))
    net = opened(left, 1).unionByName(opened(right, -1)).groupBy(*left.columns).agg(F.sum("times").alias("times")).where("times <> 0")
    return net.withColumns({"side": F.when(F.col("times") > 0, "left").otherwise("right"), "times": F.abs("times")})
