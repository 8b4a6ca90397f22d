import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sensorloom.llm import scoring as P
from sensorloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def levels_of(texts, order):
    out = []
    code, _ = P.grams(texts, order)
    for k in range(order + 1):
        g, n = np.unique(code & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        out.append((g, n))
    return out


def slow_log(texts, order, context, symbol):
    """PPM by the book, from the training texts themselves."""
    padded = [P.BEGIN * order + t + P.END for t in texts]
    excluded, p = set(), 1.0
    for k in range(order, -1, -1):
        own = context[len(context) - k :]
        follow = Counter(x[i : i + 1] for x in padded for i in range(order, len(x)) if x[i - k : i] == own)
        live = {s: c for s, c in follow.items() if s not in excluded}
        total = sum(live.values())
        if live:
            if symbol in live:
                return math.log10(p * (2 * live[symbol] - 1) / (2 * total))
            p *= len(live) / (2 * total)
        if follow:
            excluded = set(follow)
    return math.log10(p / (256 - len(excluded)))


def test_against_the_book():
    train = [b"abracadabra", b"abrac", b"", b"cadabra bar", "é".encode()]
    m = P.Ppm(levels_of(train, 3))
    for t in (b"abra", b"", b"zzz", b"bar cad", b"dabrx", "é è".encode()):
        padded = P.BEGIN * 3 + t + P.END
        want = sum(slow_log(train, 3, padded[i - 3 : i], padded[i : i + 1]) for i in range(3, len(padded)))
        assert abs(m.scores([t])[0] - want) < 1e-9


def test_probabilities_sum_to_one():
    m = P.Ppm(levels_of([b"abracadabra", b"the theme", b"tha"], 2))
    for context in (b"ab", b"\xfe\xfe", b"zz", b"th", b"\xfea"):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs((10 ** m._logs(codes)).sum() - 1) < 1e-9


def slow_base(rows):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(words(t)), sum(w in c for w in words(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in rows), key=str)


def test_whole_table(spark):
    got = QUERIES["op2_scoring"](spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((*r[:5], round(r[5], 6)) for r in got), key=str) == slow_base(rows)
    held = [r for r in got if r["held_out"]]
    size = dict((i, len((t or "").encode()) + 1) for i, t in rows)
    assert -sum(r["score"] for r in held) / math.log10(2) < 2.4 * sum(size[r["doc_id"]] for r in held)
    texts = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    m = P.Ppm(levels_of(texts, 5))
    want = dict(zip((i for i, _ in rows), m.scores([(t or "").encode() for _, t in rows])))
    assert all(abs(want[r["doc_id"]] - r["score"]) < 1e-6 * abs(r["score"]) for r in got)


def test_odd_rows_and_parts(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "long text " * 30_000, None), (None, "a b A", 0.5), (4, "same", 1.0), (4, "same", 1.0), (5, "\x00 é\n", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    scores = []
    for s in (P.Settings(), P.Settings(frequent=0, part_grams=4), P.Settings(frequent=10, split_bytes=100_000), P.Settings(order=3)):
        got = P.report(df, s).collect()
        scores.append(sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got))
        assert sorted(((*r[:5], round(r[5], 6)) for r in got), key=str) == slow_base([r[:2] for r in rows])
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert scores[0] == scores[1] == scores[2]
    assert P.report(df.limit(0)).collect() == []


def test_dominant_token_and_few_partitions(spark):
    """One token is most of the text and in every split; many splits share two partitions."""
    rows = [(i, "the " * 300 + f"word{i % 7} end{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = P.Settings(split_bytes=2_000, most_parts=2, part_grams=20, frequent=5)
    got, want = (sorted(((r["doc_id"], round(r["base_score"], 6), round(r["score"], 6)) for r in P.report(df, s).collect())) for s in (small, P.Settings()))
    assert got == want
    assert sorted(((*r[:5], round(r[5], 6)) for r in P.report(df, small).collect()), key=str) == slow_base(rows)
    plan = P.report(df, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_one_row_repeated(spark):
    """100,000 copies of one row and many of a held-out one are dealt as one each, counted and scored as so many."""
    rows = [(7, "the same text")] * 100_000 + [(100 + i, f"other text {i % 5} of the kind") for i in range(60)] + [(None, None)] * 40 + [(1, "")] * 17
    held = next(i for i in range(1_000, 2_000) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows += [(held, "held the out text")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    placed, hot = P.with_copies(df.select("doc_id", P.binary(), P.in_fold(F.col("doc_id"), 5, 1).alias("held_out")).withColumn("place", F.xxhash64("doc_id", "text")), P.Settings())
    assert hot and placed.count() == 64 and placed.agg(F.sum("copies")).first()[0] == len(rows)
    got = P.report(df)
    few = sorted(set(map(tuple, got.collect())), key=str)
    assert got.count() == len(rows) and got.where("doc_id = 7").count() == 100_000 and len(few) == len(set(rows))
    want = {r[0]: r for r in slow_base(rows)}
    assert all((*r[:5], round(r[5], 6)) == want[r[0]] for r in few)
    m = P.Ppm(levels_of([(t or "").encode() for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1], 5))
    texts = dict(rows)
    assert all(abs(m.scores([(texts[r[0]] or "").encode()])[0] - r[6]) < 1e-6 * abs(r[6]) for r in few)
