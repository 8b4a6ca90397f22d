"""Quality by a weak-label model: heuristic labellers, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import MULTIPLIER, binary, chunks, mixed, numbered, sampled, save, scratch, sums

ABSTAIN, BAD, GOOD = 0, 1, 2
SYMBOLS = b"#$%&*|{}<>~^_=+\\@"
PUNCTUATED = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
#: Classes of bytes in word shapes: A, a, 0, and others as they are.
CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


@dataclass
class Settings:
    """sample_rows bounds the texts, of any length, that the scorer is fitted on; the labellers' accuracies come from all documents.

    features: buckets that get weights, those of the statistics and the ones that most of the sampled texts have.
    """

    sample_rows: int = 6_000
    buckets: int = 1 << 16
    features: int = 8_192
    rounds: int = 120
    rate: float = 0.05
    decay: float = 1e-5
    em_rounds: int = 200


def statistics(text: bytes) -> tuple[list[bytes], list[float]]:
    """Words, and: their number, mean length, shares of symbols, capitals, digits, words that repeat the one before, repeated lines,
    words of punctuation only, and exclamation or question marks."""
    words = text.split()
    n, size = len(words), max(1, sum(map(len, words)))
    gone = lambda chars: len(text) - len(text.translate(None, chars))
    upper = gone(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = upper + gone(b"abcdefghijklmnopqrstuvwxyz")
    lines = [x for x in text.split(b"\n") if x.strip()]
    return words, [n, size / max(1, n), gone(SYMBOLS) / size, upper / max(1, letters), gone(b"0123456789") / size, sum(map(bytes.__eq__, words, words[1:])) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), 1 - len(text.translate(None, PUNCTUATED).split()) / max(1, n), gone(b"!?") / size]


#: For each statistic, which values are bad and which good; what is neither abstains.
LABELLERS = (
    (lambda x: x < 5, lambda x: x >= 30),
    (lambda x: x > 12 or x < 2.5, lambda x: 3 <= x <= 7),
    (lambda x: x > 0.03, lambda x: x < 0.005),
    (lambda x: x > 0.2, lambda x: x < 0.06),
    (lambda x: x > 0.15, lambda x: x < 0.02),
    (lambda x: x > 0.1, lambda x: x < 0.02),
    (lambda x: x > 0.3, lambda x: x < 0.05),
    (lambda x: x > 0.1, lambda x: x < 0.01),
    (lambda x: x > 0.03, lambda x: x < 0.01),
)


def votes(stats: list[float]) -> int:
    """All votes as one number in base three."""
    out = 0
    for x, (bad, good) in zip(stats, LABELLERS):
        out = out * 3 + (BAD if bad(x) else GOOD if good(x) else ABSTAIN)
    return out


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Probability of good for each pattern of votes, from how often each occurs.

    Each labeller has, for bad and for good documents, its own probabilities to vote bad, good, or not.
    The start takes bad votes to be rare on good documents, which settles what is called good.
    """
    m = len(LABELLERS)
    cast = np.stack([patterns // 3 ** (m - 1 - j) % 3 for j in range(m)], axis=1)
    p = np.full((m, 2, 3), 0.0)
    p[:, 0], p[:, 1] = (0.3, 0.3, 0.4), (0.3, 0.02, 0.68)
    prior = np.array([0.3, 0.7])
    for _ in range(rounds):
        log = np.log(prior) + sum(np.log(p[j][:, cast[:, j]]).T for j in range(m))
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        w = post * counts[:, None]
        prior = (w.sum(axis=0) + 1) / (w.sum() + 2)
        for j in range(m):
            for v in range(3):
                p[j, :, v] = (w[cast[:, j] == v].sum(axis=0) + 1) / (w.sum(axis=0) + 3)
    return post[:, 1]


def word_buckets(words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each distinct word in lower case, and of its shape: first byte and last three, by class."""
    def hashed(keys: list[bytes], salt: int) -> np.ndarray:
        return np.fromiter((zlib.crc32(k, salt) for k in keys), np.uint64, len(keys)) % np.uint64(buckets)

    return hashed([w.lower() for w in words], 1).astype(np.int64), hashed([(s := w.translate(CLASSES))[:1] + s[-3:] for w in words], 2).astype(np.int64)


EDGES = np.array([0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.001, 2, 4, 6, 9, 14, 30, 100, 300, 1000])


def range_buckets(place: np.ndarray, buckets: int) -> np.ndarray:
    """place: for each statistic (column) the number of its range."""
    return (mixed(place.astype(np.uint64) + np.arange(place.shape[1], dtype=np.uint64) * np.uint64(64) + MULTIPLIER) % np.uint64(buckets)).astype(np.int64)


def stat_buckets(stats: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each statistic and its range."""
    return range_buckets(np.searchsorted(EDGES, stats, side="right"), buckets)


@dataclass
class Scorer:
    """Bias, mean weight of a document's words and their shapes, and the weights of its statistics' ranges."""

    buckets: int
    bias: float
    weights: np.ndarray

    def scores(self, words: list[list[bytes]], stats: list[list[float]]) -> np.ndarray:
        flat, lengths = [w for x in words for w in x], np.fromiter(map(len, words), np.int64, len(words))
        z = self.bias + self.weights[stat_buckets(np.array(stats), self.buckets)].sum(axis=1)
        if flat:
            codes, distinct = numbered(flat)
            a, b = word_buckets(distinct, self.buckets)
            z = z + sums((self.weights[a] + self.weights[b])[codes], lengths) / np.maximum(lengths, 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and value of all features of whole texts: the mean over words, and 1 for each statistic; and the votes."""
    read = [statistics(t) for t in texts]
    spots = stat_buckets(np.array([x for _, x in read]), buckets)
    doc, bucket, value = [np.repeat(np.arange(len(read)), spots.shape[1])], [spots.ravel()], [np.ones(spots.size)]
    lengths = np.array([len(w) for w, _ in read])
    flat = [w for x, _ in read for w in x]
    if flat:
        codes, distinct = numbered(flat)
        pair, times = np.unique(np.repeat(np.arange(len(read)), lengths) * len(distinct) + codes, return_counts=True)
        d, c = pair // len(distinct), pair % len(distinct)
        for b in word_buckets(distinct, buckets):
            doc.append(d)
            bucket.append(b[c])
            value.append(times / lengths[d])
    key, at = np.unique(np.concatenate(doc) * buckets + np.concatenate(bucket), return_inverse=True)
    return key // buckets, key % buckets, np.bincount(at, weights=np.concatenate(value), minlength=len(key)), np.array([votes(x) for _, x in read])


def chosen(bucket: np.ndarray, docs: np.ndarray, s: Settings) -> np.ndarray:
    """The buckets that get weights, sorted."""
    fixed = np.unique(range_buckets(np.repeat(np.arange(len(EDGES) + 1)[:, None], len(LABELLERS), axis=1), s.buckets))
    order = np.argsort(-docs, kind="stable")
    other = bucket[order][~np.isin(bucket[order], fixed)]
    return np.sort(np.concatenate([fixed, other[: max(0, s.features - len(fixed))]]))


def learned(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, s: Settings) -> Scorer:
    """Logistic regression on posterior labels, by Adam."""
    w, m, v = (np.zeros(s.buckets + 1) for _ in range(3))
    for step in range(1, s.rounds + 1 if len(target) else 1):
        z = w[-1] + np.bincount(doc, weights=w[bucket] * value, minlength=len(target))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        grad = np.append(np.bincount(bucket, weights=g[doc] * value, minlength=s.buckets) + s.decay * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Scorer(s.buckets, float(w[-1]), w[:-1])


def _voted(batches):
    for batch in batches:
        found = [votes(statistics(t.as_py())[1]) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["pattern"])


def train(docs: DataFrame, settings: Settings | None = None) -> tuple[dict[int, float], Scorer]:
    """Posterior of each pattern of votes, over all documents, and the scorer.

    The patterns are counted in Spark; at most 3**9 rows reach the driver, whatever the number of documents. The
    scorer's sample has texts of any length: tasks reduce each to the chosen features of the whole text.
    """
    with scratch(docs.sparkSession):
        s = settings or Settings()
        rows = docs.select(binary()).mapInArrow(_voted, "pattern long").groupBy("pattern").count().collect()
        rows.sort()
        patterns = np.array([r["pattern"] for r in rows], np.int64)
        post = expectation_maximisation(patterns, np.array([r["count"] for r in rows], np.float64), s.em_rounds) if rows else np.zeros(0)
        posterior = dict(zip(patterns.tolist(), post.tolist()))
        known = docs.where("text IS NOT NULL").select(binary(), F.col("doc_id").cast("string").alias("doc_id"))
        sample = save(sampled(known, ["doc_id", "text"], s.sample_rows).select("_hash", "text"), "quality-sample")

        def counted(batches):
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for a, b in chunks(texts, 1_000_000):
                    bucket, n = np.unique(features(texts[a:b], s.buckets)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], names=["bucket", "n"])

        got = sample.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().sort_by("bucket")
        use = chosen(got.column("bucket").to_numpy(), got.column("n").to_numpy(), s)

        def reduced(batches):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in chunks(texts, 1_000_000):
                    doc, bucket, value, pattern = features(texts[a:b], s.buckets)
                    kept = np.isin(bucket, use)
                    edge = pa.array(np.searchsorted(doc[kept], np.arange(b - a + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(edge, x) for x in (pa.array(bucket[kept].astype(np.int32)), pa.array(value[kept].astype(np.float32)))]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(pattern, pa.int64()), *lists], names=["_hash", "pattern", "bucket", "value"])

        found = sample.mapInArrow(reduced, "_hash long, pattern long, bucket array<int>, value array<float>").toArrow().sort_by("_hash")
        lists = found.column("bucket").combine_chunks()
        doc = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())
        target = np.array([posterior.get(p, 0.5) for p in found.column("pattern").to_pylist()])
        return posterior, learned(doc, lists.flatten().to_numpy(), found.column("value").combine_chunks().flatten().to_numpy(), target, s)


def report(docs: DataFrame, settings: Settings | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, posterior (of the labellers), score (of the scorer) and keep, for each row of docs.

    Null text is empty; equal texts get equal results, bit by bit; a null doc_id stays. Other columns of docs
    don't matter. An empty table gives no rows.
    """
    posterior, scorer = train(docs, settings)
    shared = docs.sparkSession.sparkContext.broadcast((posterior, scorer))

    def run(batches):
        known, model = shared.value
        for batch in batches:
            texts, post, score = batch.column(1).to_pylist(), [], [np.zeros(0)]
            for a, b in chunks(texts):
                read = [statistics(t) for t in texts[a:b]]
                post += [known.get(votes(x), 0.5) for _, x in read]
                score.append(model.scores([w for w, _ in read], [x for _, x in read]))
            score = np.concatenate(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(post, pa.float64()), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "posterior", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), binary()).mapInArrow(run, "doc_id long, posterior double, score double, keep boolean")
