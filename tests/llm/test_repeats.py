import random
from hashlib import sha256

import numpy as np
import pytest
from oracle import compare

from sensorloom.llm import repeats as R
from sensorloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, kept string, spans int, h long, source string"


def slow(rows, size=13):
    words = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if d is not None and d < least.get(g, d + 1):
                least[g] = d
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def documents(seed):
    """Passages and whole copies at many places; few words, so that paths branch; odd white space and words."""
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "c", "dd", "é", " x", "Ab"])
    shared = [[word() for _ in range(r.choice([12, 13, 14, 40, 200]))] for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randrange(4)):
            p = r.choice(shared)
            parts += p[r.randrange(5) :] if r.random() < 0.5 else p
            parts += [f"{word()}{r.randrange(300)}" for _ in range(r.randrange(20))]
        rows.append((r.randrange(100) if r.random() < 0.95 else None, r.choice([" ", "\t", " \x0b", "\n"]).join(parts)))
    return rows + rows[:15] + [(1000 + i, "x " * 50) for i in range(5)] + [(5, None), (6, ""), (7, " \n"), (None, None), (2000, " ".join(shared[4]) * 2)]


@pytest.mark.parametrize("seed, settings", [(1, R.Settings()), (2, R.Settings(buckets=1)), (3, R.Settings(size=4, gram=2, bucket_bytes=100)), (4, R.Settings(size=1, gram=1)), (5, R.Settings(size=8, gram=8))])
@pytest.mark.parametrize("batch", [10_000, 3])
def test_against_sets(spark, seed, settings, batch):
    """Ties, repeated rows, nulls, self-repeats, windows across batches and partitions."""
    rows = documents(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, "k", 1, 2, "s") for r in rows], SCHEMA).repartition(5)
        got = sorted(map(tuple, R.report(df, settings).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == slow(rows, settings.size)


def test_spans_are_long_and_true(spark):
    """A passage of 300 words is one span, with the source's coordinates."""
    r = random.Random(7)
    passage = [f"w{r.randrange(10**6)}" for _ in range(300)]
    fill = lambda n: [f"f{r.randrange(10**9)}" for _ in range(n)]
    texts = {3: fill(5) + passage + fill(4), 8: fill(40) + passage[:250] + fill(9), 9: passage}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = sorted((x["doc_id"], x["start"], x["n"] + 12, x["source"], x["source_start"]) for x in R.repeated_spans(df).collect())
    assert [(d, a, n) for d, a, n, *_ in got] == [(8, 40, 250), (9, 0, 300)]
    for d, a, n, s, b in got:
        assert texts[d][a : a + n] == texts[s][b : b + n]


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b", "k", 1, 2, "s"), (2, None, None, None, None, None)], SCHEMA)
    got = R.without_repeats(df)
    assert got.columns == [*df.columns, "n_words", "n_removed", "_kept"]
    assert {tuple(x) for x in got.collect()} == {(1, "a b", "k", 1, 2, "s", 2, 0, "a b"), (2, None, None, None, None, None, 0, 0, None)}
    assert R.without_repeats(df.limit(0)).collect() == []


def test_helpers():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 50).astype(np.uint64)
    for size in (1, 2, 5, 8, 13, 50, 51):
        got = R.rolled(h, size)
        assert len(got) == max(0, 51 - size) and (size > 25 or np.array_equal(R.rolled(np.concatenate([h, h]), size)[:10], got[:10]))
        assert list(R.sliding_min(h, size)) == [h[i : i + size].min() for i in range(51 - size)]
    for columns in ([np.array([], np.int64)] * 2, [r.integers(-(2**62), 2**62, 9), np.arange(9)], [np.array([2**63 - 1, -(2**63), 0]), np.array([5, 5, 5])]):
        back = R.unpacked(R.packed(*columns), 2)
        assert all(np.array_equal(a, b) for a, b in zip(columns, back))


def test_against_sql(spark):
    assert compare(QUERIES["op11_repeats"](spark, "/root/testdata/sf0.001"), ORACLE_SQL["op11_repeats"], "/root/testdata/sf0.001") >= 200
