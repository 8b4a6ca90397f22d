"""A Merkle manifest of a dataset: proofs for every row from a broadcast upper tree.

Rows become leaves; the leaves of a group (a source) are numbered in their order and cut into blocks of `arity ** levels`,
each reduced to one node where its leaves are. Rounds of this go on until at most `top` nodes are left, over all groups.
These alone go to the driver, which builds the rest of the tree; each node's path up to the root goes back by broadcast,
and the executors finish proofs and fold every row's leaf up to the root.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.llm.common import crc32_sql, save


@dataclass(frozen=True)
class Shape:
    """arity: nodes of a run. levels: a block has at most arity ** levels leaves. top: most nodes that the driver gets."""

    arity: int = 3
    levels: int = 6
    top: int = 20_000


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "grp string, pos long, total long, digest binary, id long, other binary, below string"
BLOCK = "grp string, block long, blocks long, digest binary, ids array<long>, belows array<string>, digests binary, others binary"
PATH = "grp string, pos long, path binary, subroot binary, root binary"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values.values()]), 256))


def digest_of(parts: Iterable[bytes]) -> bytes:
    """SHA-256 of digests, joined as lower-case hex text."""
    return sha256(b"".join(parts).hex().encode()).digest()


def tree(nodes: list[bytes], arity: int, most: int | None) -> list[list[bytes]]:
    """Levels from these nodes upwards, until one is left, or for `most` levels exactly."""
    levels = [nodes]
    while len(levels[-1]) > 1 if most is None else len(levels) <= most:
        last = levels[-1]
        levels.append([digest_of(last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def path_in(levels: list[list[bytes]], at: int, arity: int) -> bytes:
    """Siblings of node `at` on its way up: for each level how many are on the left, how many on the right, and these."""
    out = bytearray()
    for level in levels[:-1]:
        first = at - at % arity
        left, right = level[first:at], level[at + 1 : first + arity]
        out += bytes((len(left), len(right))) + b"".join(left) + b"".join(right)
        at //= arity
    return bytes(out)


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    i = 0
    while i < len(path):
        left, right = path[i], path[i + 1]
        i += 2
        yield path[i : i + 32 * left], path[i + 32 * left : i + 32 * (left + right)]
        i += 32 * (left + right)


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a node and the siblings on its path give."""
    for left, right in steps(path):
        node = sha256((left + node + right).hex().encode()).digest()
    return node


def proof(path: bytes) -> bytes:
    """SHA-256 of all siblings, level by level, left to right."""
    return digest_of(left + right for left, right in steps(path))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `pos`, from 0, in `order` within each grp, and `total`, the grp's rows. No task sorts a whole group.

    A range shuffle deals out ranges of the order; each range counts its own rows of a group, and begins after
    those of the ranges before it.
    """
    ranged = save(rows.repartitionByRange("grp", *order).withColumn("range", F.spark_partition_id()), f"{name}-ranges")
    sizes = ranged.groupBy("grp", "range").agg(F.count("*").alias("own"))
    key = W.partitionBy("grp")
    starts = save(sizes.select("grp", "range", (F.sum("own").over(key.orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("own")).alias("first"), F.sum("own").over(key).alias("total")), f"{name}-starts")
    small = starts.count() <= 100_000  # a row for each group and one more for each range: small only if the groups are few
    own = F.row_number().over(W.partitionBy("grp", "range").orderBy(*order)) - 1
    return ranged.withColumn("own", own).join(F.broadcast(starts) if small else starts, ["grp", "range"]).withColumn("pos", F.col("first") + F.col("own")).drop("range", "own", "first")


def blocks_of(nodes: DataFrame, shape: Shape) -> DataFrame:
    """One row for each block of consecutive nodes of a group, with their digest and what is needed to go down again.

    A block that is its whole group is reduced to one node; others by `levels` levels exactly, even where one node is left.
    """
    size = shape.arity**shape.levels

    def reduced(t: pa.Table) -> dict:
        digests, total = t["digest"].to_pylist(), t["total"][0].as_py()
        top = tree(digests, shape.arity, None if total <= size else shape.levels)[-1]
        return {"grp": t["grp"][0].as_py(), "block": t["block"][0].as_py(), "blocks": -(-total // size), "digest": top[0], "ids": t["id"].to_pylist(), "belows": t["below"].to_pylist(), "digests": b"".join(digests), "others": b"".join(x or b"" for x in t["other"].to_pylist())}

    schema = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("digest", pa.binary()), ("ids", pa.list_(pa.int64())), ("belows", pa.list_(pa.string())), ("digests", pa.binary()), ("others", pa.binary())])

    def run(batches):
        """Rows come sorted by block; a block may lie across batches."""
        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t]).combine_chunks()
            if not len(t):
                continue
            change = pc.or_(pc.not_equal(t["grp"][1:], t["grp"][:-1]), pc.not_equal(t["block"][1:], t["block"][:-1]))
            edges = [0, *(i + 1 for i in pc.indices_nonzero(change.combine_chunks() if len(t) > 1 else pa.array([], pa.bool_())).to_pylist())]
            if len(edges) > 1:
                yield pa.RecordBatch.from_pylist([reduced(t.slice(a, b - a)) for a, b in zip(edges, edges[1:])], schema)
            kept = t.slice(edges[-1])
        if kept is not None and len(kept):
            yield pa.RecordBatch.from_pylist([reduced(kept)], schema)

    dealt = nodes.withColumn("block", F.floor(F.col("pos") / size)).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    return dealt.select("grp", "block", "total", "digest", "id", "other", "below").mapInArrow(run, BLOCK)


def suffixes(tops: list[tuple], arity: int, rooted: bool) -> Iterator[tuple]:
    """Paths of the top nodes (grp, pos, digest) to the root, their groups' subroots and the root. rooted: they are one group already."""
    groups: dict[str, list[bytes]] = {}
    for grp, _, digest in sorted(tops, key=lambda r: (r[0].encode(), r[1])):
        groups.setdefault(grp, []).append(digest)
    own = {g: tree(nodes, arity, None) for g, nodes in groups.items()}
    upper = tree([levels[-1][0] for levels in own.values()], arity, None)
    for i, (grp, levels) in enumerate(own.items()):
        rest = b"" if rooted else path_in(upper, i, arity)
        for pos in range(len(levels[0])):
            yield grp, pos, path_in(levels, pos, arity) + rest, None if rooted else levels[-1][0], upper[-1][0]


def down(blocks: DataFrame, paths: DataFrame, few: bool, shape: Shape, out: str, made) -> DataFrame:
    """Every node of every block with its whole path: made(id, below, digest, other, path, subroot, root) gives a row."""
    size = shape.arity**shape.levels

    def run(batches):
        names = [f.split()[0] for f in out.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                d, o = r["digests"], r["others"]
                digests = [d[i : i + 32] for i in range(0, len(d), 32)]
                others = [o[i : i + 32] for i in range(0, len(o), 32)] or digests
                levels = tree(digests, shape.arity, None if r["blocks"] == 1 and len(digests) <= size else shape.levels)
                rows = [made(i, below, x, y, path_in(levels, at, shape.arity) + r["path"], r["subroot"], r["root"]) for at, (i, below, x, y) in enumerate(zip(r["ids"], r["belows"], digests, others))]
                yield pa.RecordBatch.from_arrays([pa.array(c) if any(x is not None for x in c) else pa.nulls(len(c), KINDS[t]) for c, t in zip(zip(*rows), (f.split()[1] for f in out.split(", ")))], names=names)

    joined = blocks.withColumnRenamed("block", "pos").join(F.broadcast(paths) if few else paths, ["grp", "pos"])
    return joined.select("grp", "pos", "blocks", "ids", "belows", "digests", "others", "path", "subroot", "root").mapInArrow(run, out)


KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verified(i, below, x, y, path, subroot, root) -> tuple:
    back = fold(y, path)
    return i, x.hex(), subroot.hex(), root.hex(), proof(path).hex(), back.hex(), back == root


def manifest(leaves: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf, digests as lower-case hex.

    leaves: grp (never null), id, digest and other, the digest that is folded along the original path and held against the
    root. Groups are ordered bytewise; leaves of a group by id, nulls first, then digest. Repeated leaves are leaves each.
    No rows give no rows. A group of any size is many blocks; the driver never gets more than `top` nodes: should there be
    more groups than that, their subroots are reduced in blocks as one more group.
    """
    spark, n, rooted, of_subroots = leaves.sparkSession, 0, False, False
    rows = save(leaves.withColumns({"tie": F.monotonically_increasing_id(), "below": F.lit(None).cast("string")}), "merkle-leaves")
    nodes = numbered(rows, ["id", "digest", "other", "tie"], "merkle")
    layers = []
    while True:
        layers.append((save(blocks_of(nodes.select("grp", "pos", "total", "digest", "id", "other", "below"), shape), f"merkle-blocks-{n}"), of_subroots))
        made = layers[-1][0].select("grp", F.col("block").alias("pos"), F.col("blocks").alias("total"), "digest")
        count, most = made.agg(F.count("*"), F.max("total")).first()
        if count <= shape.top:
            break
        n += 1
        of_subroots = most == 1
        if of_subroots:  # one node for each group, and too many groups: these are a group of their own
            subroots = save(made.select(F.lit("").alias("grp"), "digest", F.col("grp").alias("below"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("binary").alias("other")), "merkle-subroots")
            nodes, rooted = numbered(subroots, ["below"], "merkle-subroots"), True
        else:
            nodes = made.select("*", F.col("pos").alias("id"), F.lit(None).cast("binary").alias("other"), F.col("grp").alias("below"))
    tops = made.select("grp", "pos", "digest").toArrow().to_pydict()  # at most `top` rows
    found = list(suffixes(list(zip(tops["grp"], tops["pos"], tops["digest"])), shape.arity, rooted))
    paths, few = save(spark.createDataFrame(found, PATH), "merkle-top"), True
    for blocks, of_subroots in layers[:0:-1]:

        def passed(i, below, x, y, path, subroot, root, of_subroots=of_subroots):
            return below, i, path, x if of_subroots else subroot, root

        paths = save(down(blocks, paths, few, shape, PATH, passed), "merkle-paths")
        few = paths.count() <= shape.top
    return down(layers[0][0], paths, few, shape, RESULT, verified)


def report(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The manifest of documents: a leaf of doc_id, source, lang, n_chars and text of each row, a group for each source, null first.

    Where 2 divides the crc32 of the decimal doc_id, the folded leaf is that of the text without its line feeds; null texts
    stay. Null doc_ids come first in their source and are not tampered with. Other columns don't matter.
    """
    own = {c: F.col(c) for c in COLUMNS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.col("text").contains("\n")
    bare = leaf(own | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})
    grp = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    leaves = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf(own).alias("digest"), F.when(hit, bare).alias("other"))
    return manifest(leaves.withColumn("other", F.coalesce("other", "digest")), shape)


def _sql_field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"


def _siblings(row: str, level: str, at: str, source: str, joined: str) -> str:
    """Left and right siblings of each leaf's ancestors in one tree."""
    own, up = f"{at} // (3 ** b.l)::BIGINT", f"{at} // (3 ** (b.l + 1))::BIGINT"
    side = lambda sign, name: f"coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos {sign} {own}), '') AS {name}"
    return f"SELECT {row}, {level} AS l, {side('<', 'lefts')}, {side('>', 'rights')} FROM {source} b ON {joined}b.n > 1 AND b.pos // 3 = {up} GROUP BY {row}, b.l"


SQL = f"""WITH RECURSIVE x AS (SELECT row_number() OVER () AS row, doc_id, source, text, {' || '.join(_sql_field(c) for c in COLUMNS[:-1])} AS head, replace(text, chr(10), '') AS t FROM documents),
l0 AS (SELECT row, doc_id, source, sha256(head || {_sql_field('text')}) AS leaf, sha256(head || {_sql_field('t')}) AS bare FROM x),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l0),
low AS (SELECT 0 AS l, source, pos, leaf AS d, n FROM leaves
  UNION ALL SELECT l + 1, source, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY l, source, pos // 3, n),
subroots AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (SELECT 0 AS l, pos, subroot AS d, n FROM subroots
  UNION ALL SELECT l + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY l, pos // 3, n),
path AS ({_siblings('v.row', 'b.l', 'v.pos', 'leaves v JOIN low', 'b.source IS NOT DISTINCT FROM v.source AND ')}
  UNION ALL {_siblings('v.row', '1000 + b.l', 's.pos', 'leaves v JOIN subroots s ON s.source IS NOT DISTINCT FROM v.source JOIN top', '')}),
step AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY l) AS i FROM path),
folded AS (SELECT 0::BIGINT AS i, row, CASE WHEN {crc32_sql('doc_id')} % 2 = 0 THEN bare ELSE leaf END AS d FROM leaves
  UNION ALL SELECT f.i + 1, f.row, sha256(s.lefts || f.d || s.rights) FROM folded f JOIN step s ON s.row = f.row AND s.i = f.i + 1),
ends AS (SELECT row, max_by(d, i) AS d FROM folded GROUP BY row),
proofs AS (SELECT row, sha256(string_agg(lefts || rights, '' ORDER BY i)) AS p FROM step GROUP BY row)
SELECT v.doc_id, v.leaf, s.subroot, u.d AS root, coalesce(p.p, sha256('')) AS proof_sha256, e.d AS folded_root, e.d = u.d AS verified
FROM leaves v JOIN subroots s ON s.source IS NOT DISTINCT FROM v.source JOIN top u ON u.n = 1 JOIN ends e USING (row) LEFT JOIN proofs p USING (row)"""
