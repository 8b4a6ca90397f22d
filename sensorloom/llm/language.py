"""Language of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.llm.common import Words, chunks, coded, in_fold, numbered, sampled, save, scratch, sums, with_added
from sensorloom.llm.toxicity import split_words

UNKNOWN = "und"


@dataclass
class Settings:
    """sample_rows, of texts of any length, and segments of `length` words from all over them bound what the model is fitted on.

    For the fit, words of over `longest` letters are cut into pieces. buckets and lexicon (words a language) bound the model.
    prior: so many trigrams that are known are added to those of a text before its share of known ones is taken;
    margin: of the share that texts left out of a fit have, a text in a learned language has at least so much.
    """

    sample_rows: int = 4_000
    longest: int = 256
    segments: int = 16_000
    length: int = 24
    buckets: int = 1 << 17
    lexicon: int = 400
    epochs: int = 3
    batch: int = 256
    rate: float = 0.2
    seed: int = 5
    prior: float = 10.0
    margin: float = 0.65


def features(words, buckets: int, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) pairs: whole word, prefixes, suffixes, n-grams, and whose lexicon lists the word."""
    w = Words(words)
    kinds = [(np.arange(w.n), w.whole()), *(w.prefix(n) for n in (1, 2, 3)), *(w.suffix(n) for n in (1, 2, 3, 4)), w.grams(1), w.grams(2), w.grams(3)]
    own = [k for k, _ in kinds]
    bucket = [((h + np.uint64(104_729 * i)) % np.uint64(buckets)).astype(np.int64) for i, (_, h) in enumerate(kinds)]
    listed = [(i, x) for i, word in enumerate(words) if (x := lexicon.get(word)) is not None]
    own.append(np.array([i for i, _ in listed], np.int64))
    bucket.append(buckets + np.array([x for _, x in listed], np.int64))
    return np.concatenate(own), np.concatenate(bucket)


def trigrams(words) -> tuple[np.ndarray, np.ndarray]:
    """(word, place in a table of 2**20) of each letter trigram; a shorter word is one itself."""
    w = Words(words)
    own, h = w.grams(3)
    short = np.flatnonzero(w.lengths < 3)
    return np.concatenate([own, short]), (np.concatenate([h, w.whole()[short]]) >> np.uint64(44)).astype(np.int64)


@dataclass
class Familiar:
    """Which trigrams the learned languages have, and the least share of them that a text in one of these has.

    A posterior over learned languages says which of them is likeliest, not whether it is any of them.
    """

    seen: np.ndarray
    least: float
    prior: float

    def shares(self, texts: list) -> np.ndarray:
        """Known trigrams of all of each text, with the prior's among both: a few odd words don't make a text foreign."""
        words, lengths = split_words(texts)
        known, of = np.zeros(0), np.zeros(0)
        if words:
            codes, distinct = numbered(words)
            own, at = trigrams(distinct)
            known = np.bincount(own, weights=self.seen[at], minlength=len(distinct))[codes]
            of = np.bincount(own, minlength=len(distinct))[codes].astype(np.float64)
        return (sums(known, lengths) + self.prior) / (sums(of, lengths) + self.prior)


def familiar(words: np.ndarray, docs: np.ndarray, s: Settings) -> Familiar:
    """words of all segments, with the document of each.

    Half of the documents say which trigrams there are, the other half how many of them a segment knows: the least share
    is `margin` of what all but a hundredth of these know. Without a second document it is 0, and no text is foreign.
    """
    codes, distinct = numbered(words)
    own, at = trigrams(distinct)
    of = np.bincount(own, minlength=len(distinct)).astype(np.float64)

    def table(picked: np.ndarray) -> np.ndarray:
        used, seen = np.zeros(len(distinct), bool), np.zeros(1 << 20, bool)
        used[codes[picked]] = True
        seen[at[used[own]]] = True
        return seen

    def shares(seen: np.ndarray, picked: np.ndarray) -> np.ndarray:
        """Of each segment that is wholly picked."""
        known = np.bincount(own, weights=seen[at], minlength=len(distinct))
        rows = picked.reshape(-1, s.length // 2 * 2).all(axis=1)
        x = codes.reshape(len(rows), -1)[rows]
        return (known[x].sum(axis=1) + s.prior) / (of[x].sum(axis=1) + s.prior)

    half = docs % 2 == 1
    own_shares = shares(table(~half), half)
    least = s.margin * float(np.quantile(own_shares, 0.01)) if len(own_shares) else 0.0
    return Familiar(table(np.ones(len(codes), bool)), least, s.prior)


@dataclass
class Crf:
    """States are languages. Weights of hashed features give a word's potentials; transitions are learned with them."""

    languages: list[str]
    buckets: int
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]
    familiar: Familiar | None = None

    def potentials(self, words) -> np.ndarray:
        own, bucket = features(words, self.buckets, self.lexicon)
        return np.stack([np.bincount(own, weights=self.weights[bucket, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)

    def posteriors(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Mean over its words of each text's posteriors, and its words. Texts advance together, the longest first.

        Arrays are languages by texts, and sums over languages are added one after another: what a text gets depends
        on that text only, to the last bit.
        """
        words, lengths = split_words(texts)
        n, k = len(texts), len(self.languages)
        total = np.zeros((k, n))
        if not words or not k:
            return total.T, lengths
        codes, distinct = numbered(words)
        e = self.potentials(distinct)
        e = np.ascontiguousarray(np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32).T)
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        longest = int(lengths[order[0]])
        active = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), side="right")  # texts of over t words
        t = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        add = (lambda rows: rows.sum(axis=0)) if k < 8 else lambda rows: reduce(np.add, rows)
        ahead, behind = t[:, :, None], np.ascontiguousarray(t.T)[:, :, None]
        alpha = np.empty((k, len(words)), np.float32)
        a = None
        for i in range(longest):
            at = starts[: active[i]] + i
            a = e[:, codes[at]] * (add(a[:, None, : active[i]] * ahead) if i else np.float32(1))
            a /= add(a)
            alpha[:, at] = a
        beta, done = np.ones((k, 0), np.float32), np.zeros((k, active[0]))
        for i in range(longest - 1, -1, -1):
            if beta.shape[1] < active[i]:
                beta = np.concatenate([beta, np.ones((k, active[i] - beta.shape[1]), np.float32)], axis=1)
            at = starts[: active[i]] + i
            g = alpha[:, at] * beta
            done[:, : active[i]] += g / add(g)
            beta = add((beta * e[:, codes[at]])[:, None] * behind)
            beta /= add(beta)
        total[:, order[: active[0]]] = done
        return (total / np.maximum(lengths, 1)).T, lengths

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        mean, lengths = self.posteriors(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = mean.argmax(axis=1)
        known = lengths > 0 if self.familiar is None else (lengths > 0) & (self.familiar.shares(texts) >= self.familiar.least)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, known)], np.clip(mean[np.arange(len(texts)), best], 0, 1)


@dataclass
class Draw:
    """Where the segments come from: for each piece its document, first word and words; pieces of a segment follow each other.

    Half of the segments join pieces of two texts: code-switching. Words of longer texts are drawn more often;
    a piece that meets the end of its text goes on at the beginning.
    """

    doc: np.ndarray
    at: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray, s: Settings) -> Draw:
        """lengths: words of each document."""
        r = np.random.default_rng(s.seed)
        n = min(s.segments, max(512, int(lengths.sum()) // s.length))
        half = s.length // 2
        size = np.concatenate([np.full(2, half) if i % 2 == 0 else np.full(1, 2 * half) for i in range(n)])
        doc = np.searchsorted(np.cumsum(lengths), r.integers(0, max(1, lengths.sum()), len(size)), side="right")
        return Draw(doc, r.integers(0, 1 << 40, len(size)) % lengths[doc], size)


def pieces(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    return [words[(a + np.arange(n)) % len(words)] for a, n in zip(at, size)]


def lexicon_of(rows, names: list[str]) -> dict[str, int]:
    """rows: word, language, times. The language that has a word most often; of several the first."""
    best: dict[str, tuple[int, int]] = {}
    for word, lang, n in rows:
        best[word] = max(best.get(word, (0, 0)), (n, -names.index(lang)))
    return {w: -j for w, (_, j) in sorted(best.items())}


def fit(texts: list[str], langs: list[str], s: Settings) -> Crf:
    """The model of a few texts at hand."""
    names = sorted(set(langs))
    read = [coded([t], s.longest) for t in texts]
    some = [i for i, (_, n, _) in enumerate(read) if n[0]]
    if not some:
        return unlearned(names, s)
    words = [read[i][2][read[i][0]] for i in some]
    counts: dict[tuple[str, str], int] = {}
    for i, x in zip(some, words):
        for w in x:
            counts[w, langs[i]] = counts.get((w, langs[i]), 0) + 1
    top = {w for name in names for w, _ in sorted(((w, n) for (w, l), n in counts.items() if l == name and n > 1), key=lambda x: (-x[1], x[0]))[: s.lexicon]}
    draw = Draw.of(np.array(list(map(len, words))), s)
    x = np.concatenate([p for d, a, n in zip(draw.doc, draw.at, draw.size) for p in pieces(words[d], [a], [n])])
    return learned(x, np.array([names.index(langs[some[d]]) for d in np.repeat(draw.doc, draw.size)]), names, lexicon_of([(w, l, n) for (w, l), n in counts.items() if w in top], names), s)


def unlearned(names: list[str], s: Settings) -> Crf:
    k = len(names)
    return Crf(names, s.buckets, np.zeros((s.buckets + k + 1, k), np.float32), np.zeros((k, k), np.float32), {})


def learned(words: np.ndarray, labels: np.ndarray, names: list[str], lexicon: dict[str, int], s: Settings) -> Crf:
    """Gradient steps on the log-likelihood of word labels, from the words of all segments and their labels."""
    k, r = len(names), np.random.default_rng(s.seed + 1)
    codes, used = numbered(words)
    x, y = (v.reshape(-1, s.length // 2 * 2) for v in (codes, labels))
    n = len(x)
    own, bucket = features(used, s.buckets, lexicon)
    order = np.argsort(own, kind="stable")
    own, bucket = own[order], bucket[order]
    first = np.searchsorted(own, np.arange(len(used) + 1))
    weights = np.zeros((s.buckets + k + 1, k), np.float64)
    trans = np.zeros((k, k)) + np.eye(k)
    gw, gt = np.full(weights.shape, 1e-2), np.full(trans.shape, 1e-2)
    eye = np.eye(k)
    for _ in range(s.epochs):
        turn = r.permutation(n)
        for b in range(0, n, s.batch):
            xs, ys = x[turn[b : b + s.batch]], y[turn[b : b + s.batch]]
            part, inside = np.unique(xs, return_inverse=True)
            inside = inside.reshape(xs.shape)
            size = first[part + 1] - first[part]
            flat = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            buckets, owner = bucket[flat], np.repeat(np.arange(len(part)), size)
            e = np.stack([np.bincount(owner, weights=weights[buckets, j], minlength=len(part)) for j in range(k)], axis=1)[inside]
            p, t = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(trans - trans.max())
            steps = xs.shape[1]
            alpha, beta = np.empty_like(p), np.ones_like(p)
            for i in range(steps):
                a = p[:, i] * (alpha[:, i - 1] @ t if i else 1.0)
                alpha[:, i] = a / a.sum(axis=1, keepdims=True)
            for i in range(steps - 2, -1, -1):
                z = (beta[:, i + 1] * p[:, i + 1]) @ t.T
                beta[:, i] = z / z.sum(axis=1, keepdims=True)
            gamma = alpha * beta
            gamma /= gamma.sum(axis=2, keepdims=True)
            de = eye[ys] - gamma
            xi = alpha[:, :-1, :, None] * t * (beta[:, 1:] * p[:, 1:])[:, :, None, :]
            xi /= xi.sum(axis=(2, 3), keepdims=True)
            dt = np.einsum("nti,ntj->ij", eye[ys[:, :-1]], eye[ys[:, 1:]]) - xi.sum(axis=(0, 1))
            dw = np.stack([np.bincount(inside.ravel(), weights=de[..., j].ravel(), minlength=len(part)) for j in range(k)], axis=1)[owner] / len(xs)
            spot, inv = np.unique(buckets, return_inverse=True)
            g = np.stack([np.bincount(inv, weights=dw[:, j], minlength=len(spot)) for j in range(k)], axis=1) - 1e-4 * weights[spot]
            gw[spot] += g**2
            weights[spot] += s.rate * g / np.sqrt(gw[spot])
            dt = dt / len(xs)
            gt += dt**2
            trans += s.rate * dt / np.sqrt(gt)
    return Crf(names, s.buckets, weights.astype(np.float32), trans.astype(np.float32), lexicon)


def train(docs: DataFrame, settings: Settings | None = None, held_out: tuple[int, int] = (3, 1), others: bool = False) -> Crf:
    """Fit on texts with a language outside the held-out fold: at most sample_rows of them, whole and of any length.

    others: the model also learns to tell texts in languages that none of them is in, and calls these `und`.

    Tasks count the sampled texts' words; from these counts the driver draws the segments' places, and tasks fetch
    their words. So what the driver gets is bounded by the settings, however long the texts are.
    """
    with scratch(docs.sparkSession):
        s = settings or Settings()
        known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~in_fold(F.col("doc_id"), *held_out))
        rows = known.select("text", F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("doc_id"))
        sample = save(sampled(rows, ["text", "lang", "doc_id"], s.sample_rows).select("_hash", "lang", "text"), "language-sample")

        def counted(batches):
            """A row for each text with its words, and one for each word and language with its times."""
            for batch in batches:
                for key, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                    codes, n, distinct = coded([text], s.longest)
                    times = np.bincount(codes, minlength=len(distinct))
                    m = len(distinct)
                    yield pa.RecordBatch.from_arrays([pa.array([key] + [None] * m, pa.int64()), pa.array([lang] * (m + 1)), pa.array([None, *distinct], pa.string()), pa.array([int(n[0]), *times.tolist()], pa.int64())], names=["key", "lang", "word", "n"])

        counts = save(sample.mapInArrow(counted, "key long, lang string, word string, n long"), "language-counts")
        texts = counts.where("word IS NULL").select("key", "lang", "n").toArrow().sort_by("key")
        names = sorted(set(texts.column("lang").to_pylist()))
        texts = texts.filter(pa.compute.greater(texts.column("n"), 0))
        if not len(texts):
            return unlearned(names, s)
        words = counts.where("word IS NOT NULL").groupBy("word", "lang").agg(F.sum("n").alias("n"))
        rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
        top = words.where("n > 1").withColumn("r", rank).where(F.col("r") <= s.lexicon).select("word").distinct()
        lexicon = lexicon_of([tuple(r) for r in words.join(F.broadcast(top), "word").select("word", "lang", "n").collect()], names)
        draw = Draw.of(texts.column("n").to_numpy(), s)
        keys = texts.column("key").to_numpy()
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        for i, (d, a, n) in enumerate(zip(draw.doc.tolist(), draw.at.tolist(), draw.size.tolist())):
            wanted.setdefault(int(keys[d]), []).append((i, a, n))
        shared = docs.sparkSession.sparkContext.broadcast(wanted)

        def fetched(batches):
            for batch in batches:
                for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if key in shared.value:
                        codes, _, distinct = coded([text], s.longest)
                        places, at, size = zip(*shared.value[key])
                        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([distinct[c].tolist() for c in pieces(codes, at, size)], pa.list_(pa.string()))], names=["piece", "words"])

        got = sample.select("_hash", "text").mapInArrow(fetched, "piece long, words array<string>").toArrow().sort_by("piece")
        flat = got.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        label = np.array([names.index(x) for x in texts.column("lang").to_pylist()])
        model = learned(flat, np.repeat(label[draw.doc], draw.size), names, lexicon, s)
        if others:
            model.familiar = familiar(flat, np.repeat(draw.doc, draw.size), s)
        return model


def with_language(docs: DataFrame, model: Crf) -> DataFrame:
    """The docs with _lang and _score, the mean posterior of that language over the text's words, as the last columns.

    `und` with score 0 for null texts and texts without a letter, or if no language was learned; `und` with the score of the
    likeliest one for texts in other languages, if the model learned to tell them. Where docs has
    these names already, its columns stay and the new ones get further underscores in front.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column):
        texts, lang, score = column.to_pylist(), [], [np.zeros(0)]
        for a, b in chunks(texts):
            got = shared.value.predict(texts[a:b])
            lang += got[0]
            score.append(got[1])
        return [pa.array(lang, pa.string()), pa.array(np.concatenate(score))]

    return with_added(docs, "text", run, {"_lang": "string", "_score": "double"})


def report(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs; lang, source and doc_id are no inputs of a prediction.

    `und` with score 0 for null and empty texts and those without a letter (Unicode's category L), and for all if
    no text has a language. Equal texts get equal results, bit by bit. A null doc_id is in no fold, so it is learned
    from. Other columns of docs don't matter. An empty table gives no rows.
    """
    model = train(docs, settings)
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
