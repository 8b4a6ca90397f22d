"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import Words, chunks, coded, in_fold, letter_words, numbered, sampled, save, scratch, sums, with_added

PREFIXES = (4, 5, 6, 7, 8)
#: Characters of sampled texts whose terms are held at once.
FIT_CHARS = 1_000_000
#: Uses of terms that are placed in a matrix at once.
PLACED = 500_000


@dataclass
class Settings:
    """sample_rows bounds the labelled texts, of any length, that the model is fitted on; terms, buckets and rank its size.

    A term gets weights if its share differs between the classes (least_z), or if it and another one say together
    what each alone does not (pair_z): all pairs of the `paired` most frequent words are tried, whatever they say alone.
    """

    sample_rows: int = 12_000
    buckets: int = 1 << 22
    terms: int = 2_048
    paired: int = 1_024
    pair_terms: int = 256
    rank: int = 4
    least_z: float = 3.0
    pair_z: float = 5.5
    least_docs: int = 5
    rounds: int = 250
    rate: float = 0.05
    decay: float = 3e-3
    seed: int = 11


def word_terms(words, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed terms of distinct words: each as a whole, and its beginnings."""
    w = Words(words)
    kinds = [(np.arange(w.n), w.whole()), *(w.prefix(n) for n in PREFIXES)]
    return [(own, ((h + np.uint64(7919 * k)) % np.uint64(buckets)).astype(np.int64)) for k, (own, h) in enumerate(kinds)]


def split_words(texts: list) -> tuple[list[str], np.ndarray]:
    found = [letter_words((t or "").lower()) for t in texts]
    return [w for x in found for w in x], np.fromiter(map(len, found), np.int64, len(found))


@dataclass
class FactorizationMachine:
    """score = bias + sum of w + sum over pairs of <v_i, v_j>, over a document's distinct words and their terms.

    The pair sum is (|sum v|^2 - sum |v|^2) / 2, so a word adds a vector of its own to a document's sums.
    """

    buckets: int
    bias: float
    keys: np.ndarray  # sorted buckets that have weights
    params: np.ndarray  # w, v, |v|^2

    def word_vectors(self, words) -> np.ndarray:
        out = np.zeros((len(words), self.params.shape[1]))
        if len(self.keys):
            for own, b in word_terms(words, self.buckets):
                at = np.minimum(np.searchsorted(self.keys, b), len(self.keys) - 1)
                hit = self.keys[at] == b
                np.add.at(out, own[hit], self.params[at[hit]])
        return out

    def scores(self, texts: list) -> np.ndarray:
        """A document's words are summed in the order of the words, so a score depends on its own text only."""
        words, lengths = split_words(texts)
        total = np.zeros((len(texts), self.params.shape[1]))
        if words:
            codes, distinct = numbered(words)
            vectors = self.word_vectors(distinct)
            heavy = np.flatnonzero(vectors.any(axis=1))
            heavy = heavy[np.argsort(distinct[heavy])]
            rank = np.full(len(distinct), -1, np.int64)
            rank[heavy] = np.arange(len(heavy))
            own, place = np.repeat(np.arange(len(texts)), lengths), rank[codes]
            pairs = np.unique(own[place >= 0] * max(1, len(heavy)) + place[place >= 0])
            if len(pairs):
                total = sums(vectors[heavy[pairs % len(heavy)]], np.bincount(pairs // len(heavy), minlength=len(texts)))
        hidden = sum(total[:, k] ** 2 for k in range(1, total.shape[1] - 1)) - total[:, -1]
        return 1 / (1 + np.exp(-np.clip(self.bias + total[:, 0] + 0.5 * hidden, -30, 30)))


def term_uses(texts: list, buckets: int):
    """For each kind of term the documents, buckets and times, and whether the terms are whole words."""
    codes, lengths, distinct = coded(texts)
    pairs = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(distinct) + codes) if len(codes) else np.zeros(0, np.int64)
    doc, code = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
    for kind, (own, b) in enumerate(word_terms(distinct, buckets)):
        of = np.full(len(distinct), -1, np.int64)
        of[own] = b
        found = of[code]
        key, times = np.unique(doc[found >= 0] * buckets + found[found >= 0], return_counts=True)
        yield kind == 0, key // buckets, key % buckets, times


def term_counts(texts: list, labels: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Bucket, documents, documents of class 1, and documents that have it as a whole word."""
    parts = [(b, np.ones(len(b)), labels[d], np.full(len(b), float(whole))) for whole, d, b, _ in term_uses(texts, buckets)]
    bucket, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return bucket, *(np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(bucket)).astype(np.int64) for i in (1, 2, 3))


def candidates(counts: tuple[np.ndarray, ...], toxic: int, clean: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that differ between the classes, the clearest first; and the most frequent words.

    In a sample of few labels no term can reach least_z; then four fifths of what a perfect one would reach will do.
    """
    bucket, n, a, whole = counts

    def clear(n, a):
        odds = np.log((a + 0.5) / (toxic + 1)) - np.log((n - a + 0.5) / (clean + 1))
        return np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (n - a + 0.5))

    z = clear(n, a)
    apart = np.flatnonzero((z >= min(s.least_z, 0.8 * clear(toxic, toxic))) & (n >= s.least_docs))
    often = np.flatnonzero(whole >= s.least_docs)
    return bucket[apart[np.argsort(-z[apart], kind="stable")[: s.terms]]], bucket[often[np.argsort(-whole[often], kind="stable")[: s.paired]]]


def pair_words(x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Columns of x (documents by words, 0 or 1) in a pair whose effect on the label is not the sum of theirs, the clearest first.

    The effect is the difference of log odds between the four cells of a pair, against its standard error.
    """
    n, t = (v.sum(axis=0, dtype=np.float64) for v in (x, x[y == 1]))
    best = np.zeros(x.shape[1])
    for a in range(0, x.shape[1], 128):
        block = x[:, a : a + 128].T
        both, toxic = (block @ x).astype(np.float64), ((block * y.astype(np.float32)) @ x).astype(np.float64)
        cells = [(both, toxic), (n[a : a + 128, None] - both, t[a : a + 128, None] - toxic), (n - both, t - toxic)]
        cells.append((len(y) - sum(c for c, _ in cells), y.sum() - sum(c for _, c in cells)))
        effect = error = 0.0
        for sign, (c, k) in zip((1, -1, -1, 1), cells):
            effect = effect + sign * np.log((k + 0.5) / (c - k + 0.5))
            error = error + 1 / (k + 0.5) + 1 / (c - k + 0.5)
        z = np.abs(effect) / np.sqrt(error)
        z[np.arange(len(z)), np.arange(a, a + len(z))] = 0
        best[a : a + 128] = z.max(axis=1, initial=0)
    good = np.flatnonzero(best >= s.pair_z)
    return good[np.argsort(-best[good], kind="stable")[: s.pair_terms]]


def matrix(rows: int, doc: np.ndarray, bucket: np.ndarray, times: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Documents by these buckets."""
    order = np.argsort(columns)
    ordered = columns[order]
    x = np.zeros((rows, len(columns)), np.float32)
    for a in range(0, len(doc) if len(columns) else 0, PLACED):
        d, b, t = (v[a : a + PLACED] for v in (doc, bucket, times))
        at = np.minimum(np.searchsorted(ordered, b), len(columns) - 1)
        use = ordered[at] == b
        np.add.at(x, (d[use], order[at[use]]), t[use])
    return x


def learned(doc: np.ndarray, bucket: np.ndarray, times: np.ndarray, y: np.ndarray, apart: np.ndarray, often: np.ndarray, s: Settings) -> FactorizationMachine:
    """Weights and factors by Adam, from the uses of the candidate terms in documents of labels y."""
    y = np.asarray(y, np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    bias = float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
    if not 0 < rate < 1:
        return FactorizationMachine(s.buckets, bias, np.zeros(0, np.int64), np.zeros((0, s.rank + 2)))
    x = matrix(len(y), doc, bucket, times, often)
    paired = often[pair_words(np.minimum(x, 1, out=x), y, s)]
    chosen = np.sort(np.append(paired, apart[~np.isin(apart, paired)][: s.terms - len(paired)]))
    del x
    x = matrix(len(y), doc, bucket, times, chosen)
    r = np.random.default_rng(s.seed)
    w = [np.array([bias]), np.zeros(len(chosen)), r.normal(0, 0.02, (len(chosen), s.rank))]
    m, v = [np.zeros_like(k) for k in w], [np.zeros_like(k) for k in w]
    for step in range(1, s.rounds + 1 if len(chosen) else 1):
        w1, w2 = w[1].astype(np.float32), w[2].astype(np.float32)
        hidden = x @ w2
        score = w[0] + x @ w1 + 0.5 * ((hidden**2).sum(axis=1) - x @ (w2**2).sum(axis=1))
        g = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(y)).astype(np.float32)
        xg = x.T @ g
        grads = [np.array([g.sum()]), xg + s.decay * w[1], x.T @ (g[:, None] * hidden) - w[2] * xg[:, None] + s.decay * w[2]]
        for i, k in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * k
            v[i] = 0.999 * v[i] + 0.001 * k**2
            w[i] = w[i] - s.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(s.buckets, float(w[0][0]), chosen, np.column_stack([w[1], w[2], (w[2] ** 2).sum(axis=1)]))


def fit(texts: list, labels: np.ndarray, s: Settings) -> FactorizationMachine:
    """The model of a few texts at hand."""
    y = np.asarray(labels, np.int64)
    apart, often = candidates(term_counts(texts, y, s.buckets), int(y.sum()), int(len(y) - y.sum()), s)
    doc, bucket, times = (np.concatenate(x) for x in zip(*((d, b, t) for _, d, b, t in term_uses(texts, s.buckets))))
    return learned(doc, bucket, times, y, apart, often, s)


def sample_of(docs: DataFrame, labels: DataFrame, s: Settings, held_out: tuple[int, int]) -> DataFrame:
    """_hash, text and label of at most sample_rows labelled documents. Of several labels of a document the largest counts.

    The labels' own sample, bounded by sample_rows, is broadcast; so the documents don't move.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), *held_out))
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return sampled(rows, ["doc_id", "text", "label"], s.sample_rows).select("_hash", "text", "label")


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, held_out: tuple[int, int] = (4, 2)) -> FactorizationMachine:
    """Fit on labelled documents outside the held-out fold, whole texts of any length.

    Tasks count the sampled texts' terms, which come to the driver summed by bucket, and then what each text
    has of the candidate terms: both are bounded by the settings, however long the texts are. Without labels,
    or with one class only, every score is that class's share.
    """
    with scratch(docs.sparkSession):
        s = settings or Settings()
        sample = save(sample_of(docs, labels, s, held_out), "toxicity-sample")

        def counted(batches):
            for batch in batches:
                texts, label = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for a, b in chunks(texts, FIT_CHARS):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in term_counts(texts[a:b], label[a:b], s.buckets)], names=["bucket", "n", "a", "whole"])

        total = sample.select("text", "label").mapInArrow(counted, "bucket long, n long, a long, whole long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("whole").alias("whole"))
        got = total.where(F.col("n") >= s.least_docs).toArrow()
        counts = [got.column(c).to_numpy() for c in ("bucket", "n", "a", "whole")]
        size, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        order = np.argsort(counts[0])
        apart, often = candidates(tuple(c[order] for c in counts), toxic, size - toxic, s)
        wanted = np.unique(np.concatenate([apart, often]))

        def used(batches):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in chunks(texts, FIT_CHARS):
                    kept = [(d[i], k[i], t[i]) for _, d, k, t in term_uses(texts[a:b], s.buckets) for i in [np.isin(k, wanted)]]
                    doc, bucket, times = (np.concatenate(x) for x in zip(*kept))
                    of = np.argsort(doc, kind="stable")
                    edge = pa.array(np.searchsorted(doc[of], np.arange(b - a + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(edge, pa.array(x[of].astype(np.int32))) for x in (bucket, times)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], *lists], names=["_hash", "label", "bucket", "times"])

        rows = sample.mapInArrow(used, "_hash long, label int, bucket array<int>, times array<int>").toArrow().sort_by("_hash")
        label, lists = rows.column("label").to_numpy(), rows.column("bucket").combine_chunks()
        doc = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())
        bucket, times = (x.flatten().to_numpy() for x in (lists, rows.column("times").combine_chunks()))
        del rows, lists
        return learned(doc, bucket, times, label, apart, often, s)


def with_scores(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """The docs with _score (0 to 1) and _predicted (1 at the threshold or above), the last columns; null text counts as empty.

    Where docs has these names already, its columns stay and the new ones get further underscores in front.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column):
        texts = column.to_pylist()
        score = np.concatenate([np.zeros(0), *(shared.value.scores(texts[a:b]) for a, b in chunks(texts))])
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return with_added(docs, "text", run, {"_score": "double", "_predicted": "int"})


def report(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; labels, lang and source are no inputs of a score.

    Null and empty texts get the score of a document without words. Equal texts get equal scores, bit by bit. A null
    doc_id is in no fold and never labelled. Other columns of docs don't matter. An empty table gives no rows.
    """
    model = train(docs, labels, settings)
    return with_scores(docs.select("doc_id", "text"), model).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
