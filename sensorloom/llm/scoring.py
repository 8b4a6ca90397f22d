"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The trie holds, for every context of up to `order` bytes, how often each byte followed it in the
training texts. A byte is predicted from the longest context known; if that never saw it, the model
escapes to the context one byte shorter, where the symbols that the longer one had seen are excluded.
Escapes are estimated as in method D: with n occurrences and d distinct symbols, a symbol seen k times
has probability (2k-1)/2n, the escape d/2n.

Every node of the trie is one (order+1)-gram or the end of one: all counts are sums of those of the
longest grams. Texts begin after a run of a byte that UTF-8 doesn't have and end with another, so the
probabilities of all texts sum to one.

The trie has no bound, so it is never in one place. Its levels below three bytes of context have at most
2**24 nodes and are broadcast; the others are dealt out by the last three bytes of context, which all
contexts of a byte share from three bytes up: a part holds, for each such three bytes however frequent, at most
2**8, 2**16 and 2**24 nodes of the levels with three, four and five bytes of context. The most frequent grams, a
bounded table of finished probabilities, are broadcast to the documents; what these have besides is looked up
in the parts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import binary, in_fold, mixed, save

BEGIN, END = b"\xfe", b"\xff"
SYMBOLS = 256


@dataclass
class Settings:
    """order: bytes of context, 3 to 6. frequent: grams whose probability is broadcast; it changes no score.

    part_grams: grams that a part of the trie should have. split_bytes of text meet their counts at once;
    of them count_bytes are counted and score_bytes scored at once, or one longer text. A shuffle deals the splits
    to at most most_parts partitions, so a partition of a large corpus has many splits, one after another in a task.
    Of a row (doc_id and text) that is there more than most_copies times one copy is dealt to a split, with their number.
    """

    order: int = 5
    frequent: int = 1_000_000
    part_grams: int = 100_000
    split_bytes: int = 8_000_000
    most_parts: int = 20_000
    count_bytes: int = 3_000_000
    score_bytes: int = 750_000
    most_copies: int = 16


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: the last order+1 bytes as one number; and how many each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    pad = BEGIN * order
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t, END)]), np.uint8)
    codes = np.zeros(len(data) - order, np.uint64)
    for i in range(order + 1):
        codes <<= np.uint64(8)
        codes |= data[i : len(data) - order + i]
    ends = np.cumsum(lengths + order)
    keep = np.ones(len(data), bool)
    starts = ends - (lengths + order)
    for i in range(order):
        keep[starts + i] = False
    return codes[keep[order:]], lengths


def batches_of(texts: list[bytes], most: int):
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 8
    if first < len(texts):
        yield first, len(texts)


class Lookup:
    """Positions of numbers in a sorted array: a table by hash finds nearly all, a binary search the others."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.slot[self._place(keys)] = np.arange(len(keys), dtype=np.int32)

    def _place(self, x: np.ndarray) -> np.ndarray:
        return (mixed(x) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of each, -1 for those that aren't there."""
        if not len(self.keys):
            return np.full(len(x), -1, np.int64)
        at = self.slot[self._place(x)].astype(np.int64)
        other = np.flatnonzero(self.keys[at] != x)
        if len(other):
            near = np.minimum(np.searchsorted(self.keys, x[other]), len(self.keys) - 1)
            at[other] = np.where(self.keys[near] == x[other], near, -1)
        return at


class Level:
    """The nodes with some bytes of context: sorted grams (context and symbol) and counts; by context the occurrences n,
    the distinct symbols d, and what these sum to one level below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, below: Level | None) -> None:
        self.grams, self.counts = grams, counts.astype(np.float64)
        context = grams >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[len(grams) > 0], context[1:] != context[:-1]]))
        self.contexts = context[first]
        self.d = np.diff(np.append(first, len(grams))).astype(np.float64)
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        self.n, self.excluded = add(self.counts), np.zeros(len(first))
        if below is not None:
            self.excluded = add(below.counts[np.searchsorted(below.grams, grams & np.uint64((1 << 8 * below.bytes) - 1))])
        self.bytes = 1 if below is None else below.bytes + 1  # of a gram
        self.gram_at, self.context_at = Lookup(self.grams), Lookup(self.contexts)


class Low:
    """Counts of the levels with up to two bytes of context, at most 2**24 nodes. A worker process makes the levels once."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.counts = counts

    @cached_property
    def levels(self) -> list[Level]:
        return stacked([], self.counts)


def stacked(levels: list[Level], more: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """The levels and those above them from sorted grams and counts."""
    levels = list(levels)
    for grams_, counts in more:
        levels.append(Level(grams_, counts, levels[-1] if levels else None))
    return levels


class Ppm:
    """levels: from none to `order` bytes of context; the lower ones may be made already."""

    def __init__(self, levels: list) -> None:
        made = [x for x in levels if isinstance(x, Level)]
        self.levels = stacked(made, levels[len(made) :])
        self.order = len(levels) - 1

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        seen_n, seen_d = np.zeros(len(codes)), np.zeros(len(codes))  # what the longer context excludes here
        for k in range(self.order, -1, -1):
            x = codes[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            own = self.levels[k]
            context = own.context_at.find(x >> np.uint64(8))
            known = context >= 0
            n, d = np.zeros(len(x)), np.zeros(len(x))
            n[known] = own.n[context[known]] - seen_n[open_[known]]
            d[known] = own.d[context[known]] - seen_d[open_[known]]
            some = known & (d > 0)
            gram = own.gram_at.find(x)
            hit = some & (gram >= 0)
            out[open_[hit]] += np.log10((2 * own.counts[gram[hit]] - 1) / (2 * n[hit]))
            miss = some & ~hit
            out[open_[miss]] += np.log10(d[miss] / (2 * n[miss]))
            lower = known & ~hit
            seen_n[open_[lower]] = own.excluded[context[lower]]
            seen_d[open_[lower]] = own.d[context[lower]]
            open_ = open_[~hit]
        out[open_] -= np.log10(np.maximum(SYMBOLS - seen_d[open_], 1))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, from a whole trie."""
        codes, lengths = grams(texts, self.order)
        distinct, at = np.unique(codes, return_inverse=True)
        return np.add.reduceat(self._logs(distinct)[at], np.cumsum(lengths) - lengths)


def level(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes with k bytes of context, and their counts."""
    node, at = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
    return node, np.bincount(at, weights=counts, minlength=len(node))


def gathered(rows: DataFrame, s: Settings) -> DataFrame:
    """gram and n over all training texts; -1 has their number of tokens, ends included."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            tokens = sum(len(t.split()) + 1 for t in texts)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([tokens], pa.int64())], names=["gram", "n"])
            for a, b in batches_of(texts, s.count_bytes):
                codes, _ = grams(texts[a:b], s.order)
                code, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    found = rows.where("NOT held_out").select("text").mapInArrow(run, "gram long, n long")
    return save(found.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")


def low_levels(counted: DataFrame) -> Low:
    """Nodes with up to two bytes of context: at most 2**24, 16 bytes each, whatever the corpus; the lower two levels are sums by table."""
    got = counted.where("gram >= 0").groupBy((F.col("gram").bitwiseAND(F.lit(0xFFFFFF))).cast("int").alias("node")).agg(F.sum("n").alias("n")).toArrow().sort_by("node")
    node, n = got.column("node").to_numpy(), got.column("n").to_numpy()
    low = []
    for k in (0, 1):
        total = np.bincount(node & ((1 << 8 * (k + 1)) - 1), weights=n, minlength=1 << 8 * (k + 1))
        at = np.flatnonzero(total)
        low.append((at.astype(np.uint64), total[at]))
    return Low([*low, (node.astype(np.uint64), n)])


def frequent(counted: DataFrame, s: Settings) -> tuple[Lookup, np.ndarray]:
    """The most frequent grams and their log10 probabilities. The threshold on counts doubles until they are few enough."""
    steps = [1 << i for i in range(48)]
    known = counted.where("gram >= 0")
    sizes = known.agg(*[F.count(F.when(F.col("n") >= t, 1)) for t in steps]).first()
    least = next(t for t, size in zip(steps, sizes) if size <= s.frequent)
    context = F.shiftright("gram", 8)
    top = known.where(F.col("n") >= least).select("gram", "n", context.alias("context"))
    # At most `frequent` contexts of eight bytes: their grams are found and summed before anything is shuffled.
    sums = known.select("n", context.alias("context")).join(F.broadcast(top.select("context").distinct()), "context", "left_semi").groupBy("context").agg(F.sum("n").alias("all"))
    got = top.join(sums, "context").select("gram", "n", "all").toArrow()
    gram, n, total = (got.column(c).to_numpy() for c in ("gram", "n", "all"))
    order = np.argsort(gram)
    return Lookup(gram[order].astype(np.uint64)), np.log10((2 * n[order] - 1) / (2 * total[order]))


def looked_up(wanted: DataFrame, counted: DataFrame, s: Settings) -> DataFrame:
    """gram and log, the log10 probability of its last byte after the others, for the distinct grams of `wanted`."""
    shared = wanted.sparkSession.sparkContext.broadcast(low_levels(counted))
    known = counted.where("gram >= 0")
    parts = int(known.count() // s.part_grams) + 1
    dealt = lambda df: df.withColumn("part", F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF))), F.lit(parts)).cast("int"))

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        codes = asked.column("gram").to_numpy().astype(np.uint64)
        gram, n = own.column("gram").to_numpy().astype(np.uint64), own.column("n").to_numpy()
        logs = Ppm([*shared.value.levels, *(level(gram, n, k) for k in range(3, s.order + 1))])._logs(codes) if len(codes) else np.zeros(0)
        return pa.table({"gram": asked.column("gram"), "log": pa.array(logs, pa.float64())})

    return dealt(wanted.select("gram").distinct()).groupBy("part").cogroup(dealt(known).groupBy("part")).applyInArrow(answer, "gram long, log double")


def _words(table: pa.Table) -> pa.Table:
    """The distinct tokens of a split, and how often its training texts have each; the end is the empty token."""
    known, other = Counter(), set()
    for text, held, copies in zip(*(table.column(c).to_pylist() for c in ("text", "held_out", "copies"))):
        words = text.lower().split()
        if held:
            other.update(words)
        elif copies == 1:
            known.update(words)
            known[b""] += 1
        else:
            for word, times in Counter(words).items():
                known[word] += times * copies
            known[b""] += copies
    other = [w for w in {*other, b""} if w not in known]
    tokens = [*known, *other]
    split = table.column("split")[0].as_py()
    return pa.table({"split": pa.array([split] * len(tokens), pa.int64()), "token": pa.array(tokens, pa.binary()), "n": pa.array([*known.values(), *[0] * len(other)], pa.int64())})


RESULT = "doc_id long, place long, copies long, held_out boolean, n_tokens long, n_known long, logs double, part_score double, rare array<struct<gram: bigint, times: bigint>>"


def _summed(table: Lookup, log: np.ndarray, texts: list[bytes], s: Settings) -> tuple[np.ndarray, list]:
    """For each text the sum over its frequent grams, and its other grams with their times."""
    total, rare = [np.zeros(0)], []
    for a, b in batches_of(texts, s.score_bytes):
        codes, lengths = grams(texts[a:b], s.order)
        at = table.find(codes)
        found = log[at] if len(log) else np.zeros(len(codes))
        new = np.flatnonzero(at < 0)
        found[new] = 0
        starts = np.cumsum(lengths) - lengths
        total.append(np.add.reduceat(found, starts))
        own = np.searchsorted(starts, new, side="right") - 1
        edge = np.searchsorted(own, np.arange(b - a + 1))
        for i in range(b - a):
            gram, times = np.unique(codes[new[edge[i] : edge[i + 1]]], return_counts=True) if edge[i] < edge[i + 1] else ((), ())
            rare.append([{"gram": int(g), "times": int(t)} for g, t in zip(gram, times)])
    return np.concatenate(total), rare


def _scored(shared, s: Settings):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        log = dict(zip(counts.column("token").to_pylist(), np.log10(counts.column("c").to_numpy() + 0.5).tolist()))
        never, texts = np.log10(0.5), docs.column("text").to_pylist()
        n, known, logs = [], [], []
        for t in texts:
            words = t.lower().split()
            words.append(b"")
            each = np.fromiter(map(log.__getitem__, words), np.float64, len(words))
            n.append(len(words))
            known.append(int((each > never).sum()))
            logs.append(float(each.sum()))
        del log
        score, rare = _summed(*shared.value, texts, s)
        return pa.table({"doc_id": docs.column("doc_id"), "place": docs.column("place"), "copies": docs.column("copies"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "logs": pa.array(logs, pa.float64()), "part_score": pa.array(score, pa.float64()), "rare": pa.array(rare, pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())])))})

    return run


def with_copies(placed: DataFrame, s: Settings) -> tuple[DataFrame, bool]:
    """placed (doc_id, text, held_out, place) with `copies`: often repeated rows are one each, with their number, all others 1; and whether there are such.

    Only hashes are counted; rows are told apart by their columns. The few that are repeated so often are summed before
    they are shuffled, and nothing else moves.
    """
    often = save(placed.groupBy("place").count().where(F.col("count") > s.most_copies).select("place"), "ppm-often")
    if often.isEmpty():
        return placed.withColumn("copies", F.lit(1).cast("long")), False
    hot = placed.join(often, "place", "left_semi").groupBy("doc_id", "text", "held_out", "place").agg(F.count("*").alias("copies"))
    return placed.join(often, "place", "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(hot), True


def repeated(scored: DataFrame) -> DataFrame:
    """A row for each copy. Rows with many are dealt out in portions first, so no task makes all copies of one."""
    at_once = 10_000
    portions = F.floor((F.col("copies") - 1) / at_once)
    scored = save(scored, "ppm-joined")
    many = scored.where("copies > 1").withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), portions))).repartition("place", "portion")
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies") - F.col("portion") * at_once, F.lit(at_once)))))
    return scored.where("copies = 1").unionByName(many.drop("portion", "copy"))


def report(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for each row of docs.

    Null text is empty; an empty text has its end alone. Learns from the documents outside the held-out fold; a null
    doc_id is in no fold, so it is learned from; repeated rows count each. Other columns of docs don't matter. An
    empty table gives no rows.

    Every split of about split_bytes of text meets the counts of its own distinct tokens only, so the
    vocabulary is never broadcast and no split grows with it; one shuffle carries the texts, one the
    distinct tokens of the splits summed by token, and one takes these sums back. Rare grams are looked up once each,
    their documents meet the answers in a join, and each document's are summed before they are shuffled.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary(), in_fold(F.col("doc_id"), 5, 1).alias("held_out"))
    counted = gathered(rows, s)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // s.split_bytes) + 1
    train_tokens = (counted.where("gram = -1").agg(F.sum("n")).first() or [0])[0] or 0
    shared = spark.sparkContext.broadcast(frequent(counted, s))
    placed, hot = with_copies(rows.withColumn("place", F.xxhash64("doc_id", "text")), s)
    parts = placed.withColumn("split", F.pmod("place", F.lit(n)).cast("long")).repartition(min(n, s.most_parts), "split")
    tokens = parts.groupBy("split").applyInArrow(_words, "split long, token binary, n long")
    tokens = save(tokens, "ppm-tokens")
    totals = save(tokens.groupBy("token").agg(F.sum("n").alias("c")), "ppm-totals")
    words = totals.where("c > 0").count()
    counts = tokens.select("split", "token").join(totals, "token")
    out = save(parts.groupBy("split").cogroup(counts.groupBy("split")).applyInArrow(_scored(shared, s), RESULT), "ppm-scores")
    rare = out.select("doc_id", "place", F.posexplode("rare").alias("i", "r")).select("doc_id", "place", "i", "r.gram", "r.times")
    copies = F.count(F.when(F.col("i") == 0, 1))
    rest = (F.sum(F.col("log") * F.col("times")) / copies).alias("rest")
    answers = rare.join(looked_up(rare, counted, s), "gram").groupBy(F.col("doc_id").alias("d"), F.col("place").alias("p")).agg(rest)
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(train_tokens + 0.5 * (words + 1)))
    score = F.col("part_score") + F.coalesce(F.col("rest"), F.lit(0.0))
    joined = out.drop("rare").join(answers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("place") == F.col("p")), "left")
    return (repeated(joined) if hot else joined).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(train_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
