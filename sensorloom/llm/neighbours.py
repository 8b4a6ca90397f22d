"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

Branches wait in a priority queue by the cosine of the query and their centre; the best is opened next,
over all levels, until so many leaves have been visited as the calibration asks for.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.llm.common import sampled, save


@dataclass
class Settings:
    """sample_rows and sample_values (components) bound what the tree is fitted on, most_leaves the tree, calibrating the queries of the calibration.

    leaf_rows: rows that a leaf should have. block_rows: vectors that a task holds at once, of several leaves that lie
    side by side, or a part of those of a large leaf. Queries stream past a block; only beyond block_queries of
    them is it copied, so that others take a part. at_once: queries compared at once.
    """

    k: int = 5
    recall: float = 0.95
    sample_rows: int = 20_000
    sample_values: int = 8_000_000
    leaf_rows: int = 200
    most_leaves: int = 4_096
    branch: int = 8
    rounds: int = 8
    calibrating: int = 200
    block_rows: int = 2_048
    block_queries: int = 65_536
    at_once: int = 1_024
    seed: int = 9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """Nodes with unit centres; children of node i are those listed, a leaf has a number instead."""

    def __init__(self, sample: np.ndarray, leaf_size: int, s: Settings) -> None:
        self.centres, self.children, self.leaf_of, self.leaves = [np.zeros(sample.shape[1])], [[]], [-1], 0
        r = np.random.default_rng(s.seed)
        todo = [(0, sample)]
        while todo:
            node, x = todo.pop(0)
            groups = [] if len(x) <= leaf_size or self.leaves + len(todo) + s.branch > s.most_leaves else self._split(x, s, r)
            if len(groups) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            for centre, own in groups:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), own))
                self.centres.append(centre)
                self.children.append([])
                self.leaf_of.append(-1)
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(x: np.ndarray, s: Settings, r) -> list[tuple[np.ndarray, np.ndarray]]:
        """Spherical k-means; fewer groups if there are fewer distinct vectors."""
        distinct = np.unique(x, axis=0)
        centres = distinct[r.choice(len(distinct), min(s.branch, len(distinct)), replace=False)]
        for _ in range(s.rounds):
            near = (x @ centres.T).argmax(axis=1)
            total = np.stack([x[near == j].sum(axis=0) for j in range(len(centres))])
            size = np.linalg.norm(total, axis=1)
            centres = total[size > 1e-12] / size[size > 1e-12, None]
        near = (x @ centres.T).argmax(axis=1)
        return [(centres[j], x[near == j]) for j in range(len(centres)) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every level."""
        node, out = np.zeros(len(x), np.int64), np.full(len(x), -1, np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            for n in np.unique(node[open_]):
                own = open_[node[open_] == n]
                if self.leaf_of[n] >= 0:
                    out[own] = self.leaf_of[n]
                else:
                    kids = np.array(self.children[n])
                    node[own] = kids[(x[own] @ self.centres[kids].T).argmax(axis=1)]
            open_ = open_[out[open_] < 0]
        return out

    def visits(self, x: np.ndarray):
        """For each row a generator of leaves, best bin first."""
        for row in x @ self.centres.T:
            yield self._walk(row.tolist())

    def _walk(self, near: list[float]):
        queue = [(-2.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf_of[node] >= 0:
                yield self.leaf_of[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (-near[kid], kid))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose arrays all have the same length, each by the power of two that brings its largest component below one.

    Such a factor changes no bit of a cosine, but squares of very large or small components stay within range.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v of the vectors that take part: not null nor zero, all components finite, of the usual length.

    The usual length is the most frequent one, the smallest of several. Rows without vec_id take no part.
    """
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(column, lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & finite & some).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, visited: np.ndarray | None = None):
    """(query row, vector row, cosine) of the k nearest of each query: larger cosine, then smaller id. visited: which pairs count.

    A product of matrices finds the candidates; the cosines that count are then summed the same way for
    every pair, so that equal vectors tie whatever block they are in.
    """
    rough = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ unit(vectors).T
    rough[queries_own(own, ids)] = -np.inf
    if visited is not None:
        rough[~visited] = -np.inf
    kth = np.partition(rough, max(0, rough.shape[1] - k), axis=1)[:, max(0, rough.shape[1] - k)]
    q, v = np.nonzero((rough >= kth[:, None] - 1e-9) & np.isfinite(rough))
    score = np.empty(len(q))
    for a in range(0, len(q), 100_000):
        x, y = queries[q[a : a + 100_000]], vectors[v[a : a + 100_000]]
        score[a : a + 100_000] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], v[rank < k], score[rank < k]


def queries_own(own: np.ndarray, ids: np.ndarray):
    order = np.argsort(ids, kind="stable")
    lo, hi = np.searchsorted(ids[order], own), np.searchsorted(ids[order], own, side="right")
    rows = np.repeat(np.arange(len(own)), hi - lo)
    return rows, order[np.repeat(lo, hi - lo) + np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]


def indexed(rows: DataFrame, tree: Tree) -> DataFrame:
    """Every row with its leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.assign(unit(matrix(batch.column(1)))).astype(np.int32))], names=["vec_id", "v", "leaf"])

    return save(rows.mapInArrow(run, "vec_id long, v array<double>, leaf int"), "ann-index")


def exact(queries: pa.Table, index: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, leaf and score of the true k nearest of a few given queries (vec_id, v), from all rows."""
    shared = index.sparkSession.sparkContext.broadcast((queries.column("vec_id").to_numpy(), matrix(queries.column("v"))))

    def run(batches):
        ids, x = shared.value
        for batch in batches:
            if batch.num_rows:
                own, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                q, v, score = best(x, own, matrix(batch.column(1)), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[v]), pa.array(leaf[v]), pa.array(score)], names=["query_id", "vec_id", "leaf", "score"])

    return top(index.mapInArrow(run, "query_id long, vec_id long, leaf int, score double"), k)


def top(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def calibrated(tree: Tree, index: DataFrame, queries: DataFrame, s: Settings) -> int:
    """The fewest leaves whose visit finds the wanted share of the true neighbours of some queries."""
    some = sampled(queries, ["vec_id"], s.calibrating).orderBy("_hash").toArrow()
    truth = exact(some, index, s.k).collect() if some.num_rows else []
    if not truth:
        return tree.leaves
    order = {i: {leaf: n for n, leaf in enumerate(walk, 1)} for i, walk in zip(some.column("vec_id").to_pylist(), tree.visits(unit(matrix(some.column("v")))))}
    needed = sorted(order[r["query_id"]][r["leaf"]] for r in truth)
    return needed[min(len(needed) - 1, int(np.ceil(s.recall * len(needed))) - 1)]


def open_leaves(leaves: pa.Array, leaf: np.ndarray) -> np.ndarray:
    """For each query's list of leaves and each row's leaf: whether the list has it."""
    local, at = np.unique(leaf, return_inverse=True)
    lists = leaves.combine_chunks() if isinstance(leaves, pa.ChunkedArray) else leaves
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    place = np.minimum(np.searchsorted(local, flat), len(local) - 1)
    out = np.zeros((len(lists), len(local)), bool)
    here = local[place] == flat
    out[row[here], place[here]] = True
    return out[:, at]


def search(rows: DataFrame, is_query, settings: Settings | None = None, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest rows of each query, its own id left out.

    rows: vec_id, the vector and any other columns; is_query: a condition on vec_id. All rows are indexed and all
    queries answered; only the fit of the tree and the calibration use bounded samples. Leaves side by side make
    a shard; a query goes once to each block of a shard where it opens a leaf and gets at most k rows from it.
    A leaf of very many equal vectors is many blocks, so many tasks. Equal scores: the smaller vec_id first.
    Vectors null, zero, with null or non-finite components, or of another length than most (see `usable`), and rows
    without vec_id take no part; components of any finite size are fine. A vec_id given twice is two candidates, as a query the smaller of its vectors.
    An empty table gives no rows.
    """
    s = settings or Settings()
    spark = rows.sparkSession
    good = usable(rows, column)
    total = good.count()
    length = (good.select(F.size("v")).first() or [1])[0]
    sample = sampled(good, ["vec_id", "v"], max(1, min(s.sample_rows, s.sample_values // length))).orderBy("_hash").toArrow()
    x = unit(matrix(sample.column("v"))) if sample.num_rows else np.zeros((0, 1))
    tree = Tree(x, max(8, int(s.leaf_rows * len(x) / max(1, total))), s)
    index = indexed(good, tree)
    queries = save(index.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    visits = calibrated(tree, index, queries, s)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    shard = (np.cumsum(sizes) - sizes) // s.block_rows
    shared = spark.sparkContext.broadcast((tree, sizes, shard))

    def walked(batches):
        tree, sizes, shard = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, at, leaves = [], [], []
            for i, walk in enumerate(tree.visits(unit(matrix(batch.column(1))))):
                seen, held, opened = 0, 0, {}
                for n in walk:
                    seen, held = seen + 1, held + sizes[n]
                    if sizes[n]:
                        opened.setdefault(int(shard[n]), []).append(n)
                    if seen >= visits and held > s.k:
                        break
                row += [i] * len(opened)
                at += opened
                leaves += opened.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), batch.column(1).take(pa.array(row, pa.int32())), pa.array(at, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "q", "shard", "leaves"])

    dealt = queries.repartition(int(queries.count() // s.at_once) + 4, "vec_id")
    asked = save(dealt.mapInArrow(walked, "query_id long, q array<double>, shard long, leaves array<int>"), "ann-visits")
    loads = {r["shard"]: r["count"] for r in asked.groupBy("shard").count().collect()}
    rows_in = {int(x): int(sizes[shard == x].sum()) for x in np.unique(shard)}
    plan = {x: (-(-n // s.block_rows), -(-loads.get(x, 0) // s.block_queries)) for x, n in rows_in.items()}
    # both tables have at most most_leaves rows
    of_leaf = F.broadcast(spark.createDataFrame([(n, int(x), *plan[int(x)]) for n, x in enumerate(shard)], "leaf int, shard long, blocks int, groups int"))
    of_shard = F.broadcast(spark.createDataFrame([(x, *y) for x, y in plan.items()], "shard long, blocks int, groups int"))
    deal = lambda df, key, own, other: df.where("blocks > 0 AND groups > 0").withColumn(own[0], F.pmod(F.xxhash64(key), F.col(own[1])).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1))).drop("blocks", "groups")
    left = deal(index.join(of_leaf, "leaf"), "vec_id", ("b", "blocks"), ("g", "groups")).selectExpr("shard", "b", "g", "false AS asks", "vec_id AS id", "v", "array(leaf) AS leaves")
    right = deal(asked.join(of_shard, "shard"), "query_id", ("g", "groups"), ("b", "blocks")).selectExpr("shard", "b", "g", "true AS asks", "query_id AS id", "q AS v", "leaves")
    together = left.union(right).repartition("shard", "b", "g").sortWithinPartitions("shard", "b", "g", "asks", "id")
    return top(together.mapInArrow(_compared(s), "query_id long, vec_id long, score double"), s.k).select("query_id", "rank", "vec_id", "score")


def _compared(s: Settings):
    """Rows sorted by block, its vectors before the queries: one block is held while its queries stream by."""

    def run(batches):
        block, vectors, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip(np.append(0, edge), np.append(edge, len(keys))) if len(keys) else ():
                if block != tuple(keys[a, :3]):
                    block, vectors, held = tuple(keys[a, :3]), [], None
                part = batch.slice(a, b - a)
                if not keys[a, 3]:
                    vectors.append((part.column(4).to_numpy(), matrix(part.column(5)), part.column(6).flatten().to_numpy()))
                elif vectors:
                    held = held or tuple(np.concatenate(x) for x in zip(*vectors))
                    ids, x, leaf = held
                    for i in range(0, part.num_rows, s.at_once):
                        some = part.slice(i, s.at_once)
                        own = some.column(4).to_numpy()
                        q, v, score = best(matrix(some.column(5)), ids, x, own, s.k, open_leaves(some.column(6), leaf))
                        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[v]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run
