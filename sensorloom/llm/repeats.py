"""Removal of repeated passages by a compacted de Bruijn graph of the words of all documents.

An edge is a window of `size` consecutive words, a node the words that two windows share. Each window is dealt to a bucket by the
smallest hash of its short word grams, so neighbours mostly stay together and equal windows always meet (cf. BCALM 2). A bucket
gives each of its edges a source, the place in the smallest document that has it, and compacts edges whose sources follow each
other into one piece of a path: a path goes on while its node has one way on in the source, and ends at a branch, where the source
jumps. Pieces of different buckets are glued where both coordinates, in the document and in the source, go on in step; only then is
a long span one repeated passage. Spans then join their documents.

What many documents share is resolved before it moves: a batch of documents sends the first occurrence of a window only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.common import binary, chunks, free_name, mixed


@dataclass(frozen=True)
class Settings:
    """size: words of a window. gram: words of the grams that choose a bucket. batch_bytes: whole texts of about so many bytes are
    hashed at once. bucket_bytes: text for one bucket, of which there are `buckets` at least."""

    size: int = 13
    gram: int = 5
    batch_bytes: int = 6 << 20
    bucket_bytes: int = 8 << 20
    buckets: int = 256


class WordHashes(dict):
    """XXH64 of words, kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 11)
        return h


KNOWN = WordHashes()
STEP = 0x9E3779B97F4A7C15


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every `size` consecutive items, put together from those of powers of two."""
    out, have, block, n = None, 0, h, 1
    while n <= size:
        if size & n:
            if out is None:
                out = block
            else:
                rest = block[have : have + max(0, len(h) - have - n + 1)]
                out = out[: len(rest)] * np.uint64(pow(STEP, n, 1 << 64)) + rest
            have += n
        block = block[: max(0, len(block) - n)] * np.uint64(pow(STEP, n, 1 << 64)) + block[n:]
        n *= 2
    return mixed(out[: max(0, len(h) - size + 1)] + np.uint64(size))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    n = 1
    while 2 * n <= size:
        x = np.minimum(x[: max(0, len(x) - n)], x[n:])
        n *= 2
    rest = size - n
    return np.minimum(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


def windows(texts: Iterable[bytes], count: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place, hash and bucket hash of every window of the texts."""
    parts, lengths = [], np.zeros(count, np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        lengths[i] = len(words)
        parts.append(np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words)))
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    edges = rolled(h, s.size)
    least = sliding_min(rolled(h, s.gram), s.size - s.gram + 1)
    doc = np.repeat(np.arange(count, dtype=np.int32), lengths)[: len(edges)]
    place = np.arange(len(edges)) - (np.cumsum(lengths) - lengths)[doc]
    own = np.flatnonzero(place + s.size <= lengths[doc])
    return doc[own], place[own], edges[own], mixed(least[own])


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def lengths_of(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def first_of_each(edges: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window the index of the one that has its hash in the smallest document."""
    order = np.lexsort((docs, edges))
    at = starts_of(edges[order])
    out = np.empty(len(edges), np.int64)
    out[order] = np.repeat(order[at], lengths_of(at, len(edges)))
    return out


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers as differences, in as few bytes as the column needs, compressed."""
    out = [np.int64(len(columns[0])).tobytes()]
    for c in columns:
        d = np.diff(c, prepend=c.dtype.type(0)).view(np.int64)
        width = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not len(d) or (d.min() >= np.iinfo(t).min and d.max() <= np.iinfo(t).max))
        out += [np.dtype(width).char.encode(), d.astype(width).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    raw, out = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), []
    n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
    for _ in range(columns):
        kind = np.dtype(raw[at : at + 1].decode())
        out.append(np.cumsum(np.frombuffer(raw, kind, n, at + 1), dtype=np.int64))
        at += 1 + n * kind.itemsize
    return out


PIECE = ("doc_id", "h", "start", "n", "source", "source_start")


def pieces(doc, h, place, source, source_place) -> list[np.ndarray]:
    """Runs of repeated windows of a document whose sources follow each other."""
    step = np.arange(len(doc))
    at = starts_of(doc, h, place - step, source, source_place - step)
    return [doc[at], h[at], place[at], lengths_of(at, len(doc)), source[at], source_place[at]]


def _dealt(s: Settings, buckets: int):
    """Batches of documents to rows for the buckets: windows that are open, and pieces that the batch itself has resolved."""

    def run(batches):
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            _, once = np.unique(np.stack([ids, hashes]), axis=1, return_index=True)  # sorted by doc_id
            texts = batch.column(2).take(pa.array(once))
            for a, b in chunks([len(t.as_buffer()) for t in texts], s.batch_bytes):
                rows = dealt(ids[once[a:b]], hashes[once[a:b]], texts[a:b])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "pieces", "runs", "edges"])

    def dealt(ids, hashes, texts) -> list[tuple]:
        doc, place, edges, least = windows((t.as_py() for t in texts), len(texts), s)
        doc_id, h, rows = ids[doc], hashes[doc], []
        first = first_of_each(edges, doc_id)
        repeated = doc_id > doc_id[first]
        r, f = np.flatnonzero(repeated), first[repeated]
        if len(r):
            rows.append((int(mixed(edges[r[:1]])[0] % np.uint64(buckets)), packed(*pieces(doc_id[r], h[r], place[r], doc_id[f], place[f])), None, None))
        left = np.flatnonzero(~repeated)
        bucket = (least[left] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        left, bucket = left[order], bucket[order]
        run_at = starts_of(bucket, doc[left], place[left] - np.arange(len(left)))
        runs = [doc_id[left][run_at], h[left][run_at], place[left][run_at], lengths_of(run_at, len(left))]
        cut = starts_of(bucket[run_at])
        for a, b in zip(cut, [*cut[1:], len(run_at)]):
            i, j = run_at[a], run_at[b] if b < len(run_at) else len(left)
            rows.append((int(bucket[i]), None, packed(*(c[a:b] for c in runs)), edges[left[i:j]].tobytes()))
        return rows

    return run


def _resolved(batches):
    """Rows sorted by bucket to pieces; a bucket may lie across batches."""
    now, runs, edges = None, [], []

    def made(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(PIECE))

    def closed():
        doc, h, place, n = (np.concatenate(c) for c in zip(*(unpacked(x, 4) for x in runs)))
        e = np.frombuffer(b"".join(edges), np.uint64)
        own = np.repeat(np.arange(len(n)), n)
        doc, h, place = doc[own], h[own], place[own] + np.arange(len(e)) - (np.cumsum(n) - n)[own]
        first = first_of_each(e, doc)
        r = np.flatnonzero(doc > doc[first])
        return made(pieces(doc[r], h[r], place[r], doc[first[r]], place[first[r]]))

    for batch in batches:
        for bucket, done, run, edge in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and runs:
                yield closed()
                runs, edges = [], []
            now = bucket
            if done is not None:
                yield made(unpacked(done, len(PIECE)))
            else:
                runs.append(run)
                edges.append(edge)
    if runs:
        yield closed()


def repeated_pieces(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pieces of paths: n windows from `start` on of the document (doc_id, h) that also lie in `source`, a smaller doc_id."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(settings.buckets, -(-size // settings.bucket_bytes))
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), binary())
    dealt = rows.mapInArrow(_dealt(settings, buckets), "bucket int, pieces binary, runs binary, edges binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolved, ", ".join(f"{c} long" for c in PIECE))


def repeated_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Long spans: pieces glued where the coordinates in the document and in the source go on in step.

    doc_id, h (hash of its text), start and n (windows; the span has size - 1 words more), source and source_start. The source is a
    smaller document with the span, the smallest one among those that met first; several spans may overlap in a document.
    """
    row = W.partitionBy("doc_id", "h").orderBy("start", "source", "source_start")
    follows = lambda c, by: F.col(c) == F.lag(F.col(c) + by).over(row)
    on = follows("start", F.col("n")) & follows("source", F.lit(0)) & follows("source_start", F.col("n"))
    path = F.sum((~F.coalesce(on, F.lit(False))).cast("long")).over(row.rowsBetween(W.unboundedPreceding, 0))
    glued = repeated_pieces(docs, settings).withColumn("path", path).groupBy("doc_id", "h", "path")
    return glued.agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("source").alias("source"), F.min("source_start").alias("source_start")).drop("path")


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with n_words, n_removed and kept: the text without each word of a window that a smaller doc_id has too.

    Words are what lies between ASCII white space, unchanged; kept ones are joined by one space. What a document repeats of
    itself stays; so do repeated rows of the same doc_id, which have no smaller one. Null texts have no words and no kept text.
    Rows without doc_id stay whole and are no source. Texts of fewer words than a window stay. An empty table gives no rows.
    No column is lost: new names that docs has get underscores in front.
    """
    names = [free_name(docs, n) for n in ("n_words", "n_removed", "kept")]
    spans = repeated_spans(docs, settings).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("spans")).toDF("_own_id", "_own_h", "_spans")
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    joined = rows.join(spans, (F.col(key).cast("long") == F.col("_own_id")) & (F.xxhash64(text) == F.col("_own_h")), "left").select(*rows.columns, F.col("_spans").alias("spans"))
    own_columns, size = rows.columns, settings.size
    at = own_columns.index(text)

    def run(batches):
        for batch in batches:
            words, removed, kept = [], [], []
            spans = batch.column(len(own_columns))
            for t, own in zip(batch.column(at), spans):
                parts = t.as_py().encode().split() if t.is_valid else []
                words.append(len(parts))
                if own.is_valid:
                    change = np.zeros(len(parts) + 1, np.int64)
                    start, n = (own.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n + size - 1, -1)
                    stays = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    removed.append(len(parts) - len(stays))
                    parts = [parts[i] for i in stays.tolist()]
                else:
                    removed.append(0)
                kept.append(b" ".join(parts) if t.is_valid else None)
            columns = [*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*own_columns, "words", "removed", "kept"])

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("words long, removed long, kept string").fields])
    return joined.mapInArrow(run, schema).toDF(*docs.columns, *names)


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, that of the kept text, empty for null; see without_repeats."""
    done = without_repeats(docs.select("doc_id", "text"), settings)
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT row, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
k AS (SELECT row, doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM g),
m AS (SELECT gram, min(doc_id) AS least FROM k GROUP BY gram),
hit AS (SELECT DISTINCT row, i + j AS p FROM k JOIN m USING (gram), range(13) r(j) WHERE doc_id > least),
p AS (SELECT row, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY p) AS t FROM p ANTI JOIN hit USING (row, p) GROUP BY row)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM hit WHERE hit.row = d.row)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)"""
