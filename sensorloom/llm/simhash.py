"""SimHash near-duplicates by covering locality-sensitive hashing.

Each fingerprint bit gets a vector of radius+1 bits; a table for each non-zero vector v of that length
masks the bits whose vectors have an odd product with v. The vectors of any `radius` differing bits span
too little to leave no v orthogonal to all, so every pair within the radius agrees under some mask: no
pair is missed, and candidates need no probability. Cf. Pagh, CoveringLSH.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import binary, save

BITS = 64


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is in over half of the shingles' XXH64. No words: 0; fewer than a shingle has: one of them all."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hashed(joined, seed)
    starts = list(accumulate(map((1).__add__, map(len, parts)), initial=0))
    h = np.array([hashed(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:])], dtype=">u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; null text counts as empty."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), binary()).mapInArrow(run, "doc_id long, fp long")


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """A mask for each non-zero vector; the positions get the vectors in turn, so each mask has about half of them."""
    vectors = 2 ** (radius + 1) - 1
    given = {p: 1 + i % vectors for i, p in enumerate(positions)}
    return [sum(1 << p for p, x in given.items() if (x & v).bit_count() % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fp: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Links that connect what can be connected in steps of at most `radius` bits: fewer than there are rows.

    Each row is compared with those not yet reached only, so a dense group costs little more than its size.
    """
    left, out = np.arange(len(fp)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[u]) <= radius
            if near.any():
                out.append((u, left[near]))
                front.extend(left[near])
                left = left[~near]
    return out


SCHEMA = "overflow boolean, m int, key long, fp long, a long, b long"


def _bucket_links(radius: int, limit: int | None):
    """Links within the buckets of rows sorted by (m, key); rows of a bucket beyond `limit` come back as overflow."""

    def run(batches):
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        over = None  # the bucket that is overflowing

        def rows(flag, m, key, fp, a, b):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, flag)), pa.array(np.asarray(m, np.int32)), pa.array(key), pa.array(fp), pa.array(a), pa.array(b)], names=["overflow", "m", "key", "fp", "a", "b"])

        def linked(m, key, fp, rep):
            edge = np.flatnonzero((m[1:] != m[:-1]) | (key[1:] != key[:-1])) + 1
            lo, hi = np.append(0, edge), np.append(edge, len(m))
            a, b, bits = [], [], fp.view(np.uint64)
            two = lo[(hi - lo) == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
            a.append(rep[two])
            b.append(rep[two + 1])
            for s, e in zip(*((x[(hi - lo) > 2]) for x in (lo, hi))):
                for u, near in forest(bits[s:e], radius):
                    a.append(np.full(len(near), rep[s + u]))
                    b.append(rep[s + near])
            a, b = np.concatenate(a), np.concatenate(b)
            zero = np.zeros(len(a), np.int64)
            return rows(False, zero, zero, zero, a, b)

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(new[0]):
                continue
            if over is not None:
                more = (new[0] == over[0]) & (new[1] == over[1])
                if more.any():
                    yield rows(True, new[0][more], new[1][more], new[2][more], new[3][more], new[3][more])
                    new = [x[~more] for x in new]
                if not len(new[0]):
                    continue
                over = None
            m, key, fp, rep = (np.concatenate(x) for x in zip(kept, new))
            start = int(np.flatnonzero((m != m[-1]) | (key != key[-1]))[-1]) + 1 if (m[0], key[0]) != (m[-1], key[-1]) else 0
            if start:
                sizes = None
                if limit:
                    edge = np.flatnonzero((m[1:start] != m[: start - 1]) | (key[1:start] != key[: start - 1])) + 1
                    lo, hi = np.append(0, edge), np.append(edge, start)
                    sizes = np.repeat(hi - lo, hi - lo) > limit
                    if sizes.any():
                        big = np.flatnonzero(sizes)
                        yield rows(True, m[big], key[big], fp[big], rep[big], rep[big])
                    own = np.flatnonzero(~sizes)
                    if len(own):
                        yield linked(m[own], key[own], fp[own], rep[own])
                else:
                    yield linked(m[:start], key[:start], fp[:start], rep[:start])
            kept = [x[start:] for x in (m, key, fp, rep)]
            if limit and len(kept[0]) > limit:
                over = (kept[0][0], kept[1][0])
                yield rows(True, *kept[:4], kept[3])
                kept = [np.zeros(0, np.int64)] * 4
        if len(kept[0]):
            yield linked(*kept)

    return run


def _tables(rows: DataFrame, masks: str) -> DataFrame:
    return rows.selectExpr("fp", "rep", f"posexplode({masks}) AS (m, mask)").selectExpr("m", "fp & mask AS key", "fp", "rep")


def _in_buckets(rows: DataFrame, radius: int, limit: int | None) -> DataFrame:
    """rows: m, key, fp, rep. Sorted buckets stream through each task; a bucket may lie across batches."""
    return rows.select(F.col("m").cast("long"), "key", "fp", "rep").repartition("m", "key").sortWithinPartitions("m", "key", "fp").mapInArrow(_bucket_links(radius, limit), SCHEMA)


def links(classes: DataFrame, radius: int = 4, limit: int = 20_000) -> DataFrame:
    """Pairs (a, b) of reps that connect all fp of `classes` (fp, rep; fp distinct) within the radius.

    A bucket of over `limit` fingerprints is dealt again by covering masks over the bits that its own
    mask leaves out. After that at most 18 bits are free, so that no bucket has over 262,144.
    """
    masks = covering_masks(list(range(BITS)), radius)
    literal = "array(" + ", ".join(f"{signed(x)}L" if signed(x) > -(1 << 63) else "shiftleft(1L, 63)" for x in masks) + ")"
    first = save(_in_buckets(_tables(classes, literal), radius, limit), "simhash-buckets")
    found, over = first.where("NOT overflow").select("a", "b"), first.where("overflow")
    if not over.isEmpty():
        again = []
        for mask in masks:
            free = [p for p in range(BITS) if not mask >> p & 1]
            again.append("array(" + ", ".join(f"{signed(x)}L" for x in covering_masks(free, radius)) + ")")
        dealt = over.selectExpr("m", "key AS first_key", "fp", "a AS rep", f"element_at(array({', '.join(again)}), m + 1) AS masks")
        dealt = dealt.selectExpr("m", "fp", "rep", "posexplode(masks) AS (s, mask)").selectExpr(f"m * {len(masks)} + s AS m", f"fp & (mask | element_at({literal}, m + 1)) AS key", "fp", "rep")
        found = found.union(save(_in_buckets(dealt, radius, None), "simhash-overflow").select("a", "b"))
    return found


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it can reach, for all nodes with an edge (a, b).

    Alternating large-star and small-star rounds (Kiveris et al.): the number of rounds grows with the
    logarithm of the size, each is a few joins, and each round's edges go to the shared folder.
    """
    now = save(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct(), "edges")
    mark = lambda df: tuple(df.selectExpr("count(*)", "bit_xor(xxhash64(u, v))").first())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").union(low.selectExpr("u", "m AS v")).where("u <> v").distinct()
        now = save(small, "edges")
        before, seen = seen, mark(now)
        if seen == before:
            break
    return now.selectExpr("u AS node", "v AS root")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by linked fingerprints.

    docs: doc_id and text, other columns don't matter. Null text is empty and has fingerprint zero, linked
    like any other. A row without doc_id keeps its fingerprint, has no component and links nothing. Rows
    with the same doc_id come back each. Copies share a fingerprint and are one class, so groups of copies
    of any size cost one row; no pairs of documents are made.
    """
    found = save(fingerprints(docs, words, seed), "fingerprints")
    classes = save(found.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(links(classes, radius))
    named = classes.join(roots, classes.rep == roots.node, "left").selectExpr("fp", "coalesce(root, rep) AS component_id")
    return found.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
