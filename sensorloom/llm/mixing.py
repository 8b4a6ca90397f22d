"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

A tree domain - language - source gets a token budget at its root. Each node's budget goes to its
children by weight; a child that can't use its part (its tokens times max_epochs) takes what it can,
and the rest goes to its siblings. A node can use what its children can, so a shortage moves to the
node's own siblings only when all below it is used up. Each leaf then takes whole epochs and the
prefix of one more, in an order that seed and epoch shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.llm.common import free_name, save

LEVELS = ("domain", "language", "origin")
WORD = r"[^\x20\x09-\x0D]+"


#: Stands in for a domain where documents have none: a numbered source belongs to one by its number's remainder by four.
BY_SOURCE = r"element_at(array('books', 'code', 'news', 'web'), coalesce(try_cast(regexp_extract(coalesce(source, ''), '(\\d{1,9})$', 1) AS INT), 3) % 4 + 1)"


@dataclass
class Mix:
    """Weights are whole numbers by name, `other` for names not listed; share is a fraction of all tokens.

    domain, language, origin: the levels of the tree, as SQL expressions over the documents' columns; null is a
    name of its own, the empty one. most_leaves: the plan, one row for a leaf, is broadcast up to this many rows
    and joined by a shuffle beyond.
    """

    domain_weights: dict[str, int] = field(default_factory=lambda: {"books": 3, "code": 2, "news": 2, "web": 3})
    language_weights: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 2})
    origin_weights: dict[str, int] = field(default_factory=dict)
    other: int = 1
    share: tuple[int, int] = (3, 5)
    max_epochs: int = 2
    seed: int = 17
    most_leaves: int = 50_000
    domain: str = BY_SOURCE
    language: str = "coalesce(lang, 'und')"
    origin: str = "source"


def leaf_columns(mix: Mix) -> list[Column]:
    return [F.coalesce(F.expr(x).cast("string"), F.lit("")).alias(name) for name, x in zip(LEVELS, (mix.domain, mix.language, mix.origin))]


def weight(names: dict[str, int], column: str, other: int) -> Column:
    out = F.lit(other)
    for name, w in names.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def shared_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents, name, weight, capacity, budget of the parent) with `given`, in whole tokens.

    In the order of capacity by weight, a child is full if its capacity is no more than its part of what
    the fuller ones before it leave. What the full ones leave is divided among the others by weight.
    """
    dec = lambda c: c.cast("decimal(18,0)")
    group = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    before = group.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(W.unboundedPreceding, -1)
    taken, weighed = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("capacity", "weight"))
    seen = nodes.where("weight > 0").withColumns({"_left": F.col("budget") - taken, "_weights": F.sum("weight").over(group) - weighed})
    full = seen.withColumn("_full", dec(F.col("capacity")) * dec(F.col("_weights")) <= dec(F.col("_left")) * dec(F.col("weight")))
    rest = full.withColumns({"_rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0)), "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group)})
    part = F.expr("(cast(_rest AS decimal(18,0)) * cast(weight AS decimal(18,0))) div cast(_open AS decimal(18,0))")
    return rest.withColumn("given", F.when(F.col("_full"), F.col("capacity")).otherwise(part).cast("long")).drop("_left", "_weights", "_full", "_rest", "_open")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, language, origin, tokens) with `given` tokens: three levels, each a window over nodes."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    weights = (mix.domain_weights, mix.language_weights, mix.origin_weights)
    budget = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * mix.share[0]).alias("t")).select(F.expr(f"t div {mix.share[1]}").alias("budget"))
    for depth, name in enumerate(LEVELS):
        above, keys = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", weight(weights[depth], name, mix.other))
        nodes = nodes.join(budget, above) if above else nodes.join(F.broadcast(budget))
        given = shared_out(nodes, above, name)
        budget = given.select(*keys, F.col("given").alias("budget"))
    return given.select(*LEVELS, "tokens", "given")


def order_key(epoch: Column, seed: int) -> Column:
    """A document's place in an epoch: 32 hex digits and its id."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"), key)), F.lit(":"), key)


def plan(sizes: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf: whole epochs, and the last key of the prefix in the next.

    sizes: doc_id, leaf columns, n_tokens. A leaf's order is cut into 4,096 ranges of keys, so a leaf of
    any size is many groups; only the range where its budget ends is sorted.
    """
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    given = save(budgets(leaves, mix).where("tokens > 0 AND given > 0").selectExpr(*LEVELS, "tokens", "given", "cast(given div tokens AS int) AS epochs", "given % tokens AS rest"), "mix-budgets")
    keyed = placed(sizes, given.where("rest > 0"), mix).select(*LEVELS, "rest", "n_tokens", order_key(F.col("epochs"), mix.seed).alias("key")).withColumn("bucket", F.substring("key", 1, 3))
    bucket_sums = keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("t"))
    run = F.sum("t").over(W.partitionBy(*LEVELS).orderBy("bucket"))
    ends = save(bucket_sums.withColumn("upto", run).where("upto > rest AND upto - t <= rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("b")).selectExpr(*LEVELS, "b.bucket AS bucket", "b.before AS before"), "mix-ends")
    inside = keyed.join(hinted(ends, mix), [*LEVELS, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(W.partitionBy(*LEVELS).orderBy("key")))
    last = inside.where("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cut = ends.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "bucket").alias("cut"))
    return save(given.join(cut, list(LEVELS), "left").select(*LEVELS, "given", "epochs", "cut"), "mix-plan")


def hinted(rows: DataFrame, mix: Mix) -> DataFrame:
    """Broadcast a table of leaves if it is small: counted, not guessed."""
    return F.broadcast(rows) if rows.limit(mix.most_leaves + 1).count() <= mix.most_leaves else rows


def placed(docs: DataFrame, leaf_rows: DataFrame, mix: Mix) -> DataFrame:
    return docs.join(hinted(leaf_rows, mix), list(LEVELS))


def chosen(docs: DataFrame, leaf_plan: DataFrame, mix: Mix) -> DataFrame:
    """The docs (with doc_id and leaf columns) of the plan, once for each epoch that takes them: `epoch` from 0."""
    rows = placed(docs, leaf_plan, mix)
    taken = F.col("cut").isNotNull() & (order_key(F.col("epochs"), mix.seed) <= F.col("cut"))
    times = F.col("epochs") + F.when(taken, 1).otherwise(0)
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where(times >= F.col("epoch")).withColumn("epoch", F.col("epoch") - 1).drop("epochs", "cut")


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, leaf and tokens of each document; null text has none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaf_columns(mix), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def report(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """doc_id, domain, language, origin, epoch, n_tokens and leaf_budget: a row for each document and epoch taken.

    Null lang is `und`, null source is empty and in domain `web`; null text has no tokens. A leaf never goes over
    its budget; a leaf without tokens takes nothing. Rows of the same doc_id, and those without, share their place
    in a leaf, and go together. Other columns of docs don't matter. An empty table gives no rows.
    """
    mix = mix or Mix()
    rows = save(sized(docs, mix), "mix-sizes")
    return chosen(rows, plan(rows, mix), mix).select("doc_id", *LEVELS, "epoch", "n_tokens", F.col("given").alias("leaf_budget"))


def mixed_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The documents of the plan with all their columns and, as the last one, `epoch` (with underscores in front if docs has one).

    They don't move but for a plan that is too large to broadcast. Odd rows are treated as in the report.
    """
    mix = mix or Mix()
    leaf_plan = plan(save(sized(docs, mix), "mix-sizes"), mix)
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), *leaf_columns(mix))
    return chosen(rows, leaf_plan, mix).select(*[f"c{i}" for i in range(len(own))], "epoch").toDF(*docs.columns, free_name(docs, "epoch"))


def sql(mix: Mix | None = None) -> str:
    """The report in DuckDB's SQL."""
    mix = mix or Mix()
    case = lambda names, c: f"CASE {c} {' '.join(f"WHEN '{n}' THEN {w}" for n, w in names.items())} ELSE {mix.other} END" if names else str(mix.other)
    weights = (mix.domain_weights, mix.language_weights, mix.origin_weights)
    parts, above = [], "SELECT sum(tokens)::HUGEINT * {0} // {1} AS budget FROM leaves".format(*mix.share)
    for depth, name in enumerate(LEVELS):
        keys, parents = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        part = f"PARTITION BY {parents}" if parents else ""
        join = f"JOIN b{depth} USING ({parents})" if depth else f"CROSS JOIN ({above}) b"
        parts.append(f"""n{depth} AS (SELECT * FROM (SELECT {keys}, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {mix.max_epochs} AS capacity, {case(weights[depth], name)}::HUGEINT AS weight FROM leaves GROUP BY {keys}) {join} WHERE weight > 0),
s{depth} AS (SELECT *, budget - coalesce(sum(capacity) OVER w, 0) AS l, sum(weight) OVER ({part}) - coalesce(sum(weight) OVER w, 0) AS ws FROM n{depth} WINDOW w AS ({part} ORDER BY capacity::DOUBLE / weight::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{depth} AS (SELECT *, capacity * ws <= l * weight AS is_full FROM s{depth}),
g{depth} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE ((budget - coalesce(sum(capacity) FILTER (is_full) OVER ({part}), 0))::HUGEINT * weight) // (sum(weight) FILTER (NOT is_full) OVER ({part}))::HUGEINT END AS given FROM f{depth}),
b{depth + 1} AS (SELECT {keys}, given::HUGEINT AS budget FROM g{depth})""")
    leaf = ", ".join(LEVELS)
    return f"""WITH d AS (SELECT doc_id, ['books', 'code', 'news', 'web'][(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 3) % 4 + 1)] AS domain, coalesce(lang, 'und') AS language, coalesce(source, '') AS origin,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT {leaf}, sum(n_tokens) AS tokens FROM d GROUP BY {leaf}),
{", ".join(parts)},
p AS (SELECT {leaf}, given::BIGINT AS given, (given // tokens)::BIGINT AS epochs, (given % tokens)::BIGINT AS rest FROM g2 WHERE tokens > 0 AND given > 0),
k AS (SELECT d.*, given, epochs, rest, md5('{mix.seed}-' || epochs || '-' || coalesce(doc_id::VARCHAR, '')) || ':' || coalesce(doc_id::VARCHAR, '') AS key FROM d JOIN p USING ({leaf})),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY key) AS upto FROM k),
t AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM c)
SELECT doc_id, {leaf}, e::INTEGER AS epoch, n_tokens, given AS leaf_budget FROM (SELECT *, unnest(range(times)) AS e FROM t)"""
