"""A trie of conversation prefixes, from chained digests.

A conversation of n turns has n + 1 prefixes; each one's digest is that of the prefix before it and of its last turn, so
equal (depth, digest) means equal turns from the first on, and grouping by them gives the nodes. A node is known by its
depth and its smallest member. The prefixes of a conversation are also all ancestors of the nodes that it names; so what
a node adds to the sums of its subtree's tops goes to every prefix of the conversation that names it, with the nodes of one
conversation added up before they move.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.llm.common import crc32_sql, save

ROOT = sha256(b"").digest()


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1, by turn, null first, then by digest), digest and chars (code points of the text) of each row.

    The digest is of role and text, so no text moves. Null roles and texts are empty; rows without conv_id have no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return rows.withColumn("i", F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest"))).drop("turn")


def heads(conv: Column) -> Column:
    """How many first turns a conversation takes from that of the last hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, part, i, digest and chars: for every conversation a row without digest, then its turns in the order of part and i.

    The first h turns are those of conversation conv_id - conv_id % 100, of which at most five are wanted, by at most 200 conversations.
    """
    convs = turns.where("i = 1").select("conv_id", heads(F.col("conv_id")).alias("h"))
    marks = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("i"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    first = turns.where("conv_id % 100 = 0 AND i <= 5").withColumnRenamed("conv_id", "base")
    taken = convs.join(first, (F.col("conv_id") - F.col("conv_id") % 100 == F.col("base")) & (F.col("i") <= F.col("h"))).select("conv_id", F.lit(1).alias("part"), "i", "digest", "chars")
    own = turns.where(F.col("i") > heads(F.col("conv_id"))).select("conv_id", F.lit(2).alias("part"), "i", "digest", "chars")
    return marks.unionByName(taken).unionByName(own)


PREFIX = "conv_id long, depth int, node binary, chars long, last boolean"


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: its depth, chained digest, the code points of its last turn, and whether it is the whole.

    turns: conv_id, part, i, digest (null: the conversation begins), chars. Sorted rows stream through a task, which holds one digest.
    """
    names = [f.split()[0] for f in PREFIX.split(", ")]

    def run(batches):
        waiting = None  # the last prefix, until the next row says whether it is the whole
        for batch in batches:
            out = []
            for conv, digest, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "chars"))):
                if waiting is not None:
                    out.append((*waiting, digest is None))
                waiting = (conv, 0, ROOT, 0) if digest is None else (conv, waiting[1] + 1, sha256(waiting[2] + digest).digest(), chars)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()))], names=names)
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*waiting, True), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()))], names=names)

    return turns.select("conv_id", "part", "i", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "part", "i").mapInArrow(run, PREFIX)


def id_digests(rows: DataFrame, keys: list[str], most: int = 4096) -> DataFrame:
    """keys and sha, the SHA-256 of each group's conv_ids in decimal, ascending, joined by commas.

    Ranges of the order make texts of up to `most` ids first; then a group's texts, a row for many ids, stream through one task.
    """

    def packed(batches):
        for batch in batches:
            t, n = batch.to_pydict(), batch.num_rows
            key = list(zip(*(t[k] for k in keys)))
            cut = [i for i in range(1, n) if key[i] != key[i - 1]]
            spans = [(s, min(s + most, b)) for a, b in zip([0, *cut], [*cut, n]) for s in range(a, b, most)] if n else []
            if spans:
                columns = [pa.array([t[k][a] for a, _ in spans], pa.int64()) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([t["conv_id"][a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, t["conv_id"][a:b])) for a, b in spans])], names=[*keys, "conv_id", "ids"])

    def joined(batches):
        now, state = None, None
        for batch in batches:
            t, out = batch.to_pydict(), []
            for *key, ids in zip(*(t[k] for k in keys), t["ids"]):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, sha256()
                state.update(ids.encode())
            if out:
                yield made(out)
        if now is not None:
            yield made([(*now, state.hexdigest())])

    def made(rows):
        *columns, sha = zip(*rows)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(sha)], names=[*keys, "sha"])

    longs = ", ".join(f"{k} long" for k in keys)
    ranged = rows.select(*(F.col(k).cast("long").alias(k) for k in keys), "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    texts = ranged.mapInArrow(packed, f"{longs}, conv_id long, ids string")
    return texts.repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(joined, f"{longs}, sha string")


def trie(found: DataFrame) -> DataFrame:
    """The nodes of the trie over `found`, the prefixes of all conversations.

    Gives conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves and
    saved_tokens of the subtree, and ends_sha256. The work grows with the prefixes; the sums that reach a node are one row
    for each conversation that names a node below it, and combine before they move. No conversations, no nodes.
    """
    nodes = save(found.groupBy("depth", "node").agg(F.min("conv_id").alias("name"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends")), "trie-nodes")
    # all conversations share the root, one row; shallow nodes with many members are left to adaptive execution's split of skewed joins
    root = F.broadcast(nodes.where("depth = 0").drop("depth", "node"))
    named = found.where("depth = 0").drop("node").join(root).unionByName(found.where("depth > 0").join(nodes.where("depth > 0"), ["depth", "node"]).drop("node"))
    named = save(named.select("conv_id", "depth", "name", "n_convs", "n_ends", "chars", "last"), "trie-named")
    down = W.partitionBy("conv_id").orderBy(F.desc("depth"))
    own = F.col("name") == F.col("conv_id")
    sums = lambda x: F.sum(F.when(own, x).otherwise(0)).over(down.rowsBetween(W.unboundedPreceding, 0))
    added = named.select(
        "depth",
        F.col("name").alias("conv_id"),
        own.alias("own"),
        "n_convs",
        F.lead("name").over(down).alias("parent_conv_id"),
        F.coalesce(F.lag(own.cast("long")).over(down), F.lit(0)).alias("children"),
        sums((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaves"),
        sums((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    ).where("own OR children > 0 OR leaves > 0 OR saved > 0")
    mine = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    summed = added.groupBy("depth", "conv_id").agg(mine("parent_conv_id"), mine("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = id_digests(named.where("last").select("depth", "name", "conv_id"), ["depth", "name"]).select(F.col("depth").cast("int").alias("depth"), F.col("name").alias("conv_id"), "sha")
    return summed.join(ends, ["depth", "conv_id"], "left").select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def report(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: first turns from that of the last hundred, then their own.

    turns: conv_id, turn, role, text; other columns don't matter. Rows are ordered by turn, null first; rows of one turn by the
    digest of role and text; repeated rows are turns each. Null role or text is empty. Rows without conv_id are no conversation.
    An empty table gives no nodes, not even a root. One conversation's digests depend on each other, so they are made in one task,
    which streams them.
    """
    return trie(save(prefixes(rebuilt(save(ordered_turns(turns), "trie-turns"))), "trie-prefixes"))


SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS i FROM c),
ids AS (SELECT conv_id, {crc32_sql('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM c)),
b AS (SELECT ids.conv_id, 1 AS part, i, r, t FROM ids JOIN o ON o.conv_id = ids.conv_id - ids.conv_id % 100 AND o.i <= h UNION ALL SELECT o.conv_id, 2, i, r, t FROM ids JOIN o USING (conv_id) WHERE i > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, list({{'r': r, 't': t}}) OVER w AS k, length(t) AS chars FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
  UNION ALL SELECT conv_id, 0, [], 0 FROM ids),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, count(*) FILTER (ends) = count(*) AS leaf, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM e GROUP BY depth, k),
q AS (SELECT p.conv_id AS member, n.* FROM p JOIN n USING (depth, k)),
up AS (SELECT n.conv_id, n.depth, n.saved, n.leaf, q.conv_id AS a, q.depth AS d FROM n JOIN q ON q.member = n.conv_id AND q.depth <= n.depth)
SELECT n.conv_id, n.depth, max(q.conv_id) AS parent_conv_id, any_value(n.n_convs) AS n_convs, any_value(s.n_children)::BIGINT AS n_children, any_value(s.n_leaves)::BIGINT AS n_leaves, any_value(s.saved)::BIGINT AS saved_tokens, sha256(coalesce(any_value(n.ids), '')) AS ends_sha256
FROM n LEFT JOIN q ON q.member = n.conv_id AND q.depth = n.depth - 1
JOIN (SELECT a, d, count(*) FILTER (depth = d + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM up GROUP BY a, d) s ON s.a = n.conv_id AND s.d = n.depth GROUP BY n.conv_id, n.depth"""
