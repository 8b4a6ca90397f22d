import hashlib
import random
import re

from oracle import compare

from sensorloom.llm import decontaminate as D
from sensorloom.llm.queries import ORACLE_SQL, QUERIES

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, window=10):
    grams = {}
    for i, text in items:
        w = slow_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = []
    for d, text in docs:
        w = slow_words(text)
        hit, own = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    own |= g
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_whole_tables_against_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
        got = sorted(map(tuple, QUERIES["op7_decontaminate"](spark, sf).collect()), key=str)
        assert got == slow(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
        assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(QUERIES["op7_decontaminate"](spark, sf), ORACLE_SQL["op7_decontaminate"], sf) > 100


def test_random_small_alphabet(spark):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(i, text(r.randrange(0, 14))) for i in range(12)] + [(5, "b c"), (None, "a"), (77, None), (78, "ç É")]
    docs = [(i, text(r.randrange(0, 60))) for i in range(60)] + [(99, None), (99, None), (None, "a a"), (100, ""), (101, "x É ç y É ç É"), (102, "x " * 60_000 + "b c")]
    for window in (3, 10):
        got = D.report(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "2 AS _x"), spark.createDataFrame(items, "item_id long, text string"), window)
        assert sorted(map(tuple, got.collect()), key=str) == slow(docs, [x for x in items if x[0] is not None], window)


def test_shards_find_the_same(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = spark.createDataFrame([(i, text(12)) for i in range(4)] + [(50, text(90)), (51, "a b"), (52, "a b"), (53, "")], "item_id long, text string")
    docs = spark.createDataFrame([(i, text(400)) for i in range(30)] + [(3, None), (None, "")], "doc_id long, text string")
    rows = lambda most: sorted(map(str, D.contamination(docs, items, 5, most).collect()))
    assert rows(10**6) == rows(60)


def test_many_equal_items(spark):
    """Copies of an item cost no more than their number, in the automaton and in each hit."""
    yes = [([b"yes"], list(range(50_000))), ([b"no"], [-1]), ([b"w%d" % i for i in range(12)], list(range(100, 20_100)))]
    m = D.SuffixAutomaton(yes, 10)
    assert max(map(len, m.ends)) == 1 and max(map(len, m.items.values())) == 1
    spans, items = m.scan([b"yes", b"no"] * 5_000)
    assert spans == [(0, 10_000)] and items == [-1, *range(50_000)]
    bench = spark.range(30_000).selectExpr("id AS item_id", "'Yes.' AS text")
    (one,) = D.shards(bench, 10, 250_000)
    assert len(one.ids) == 1 and len(one.len) == 2
    got = D.report(spark.createDataFrame([(1, "oh yes " * 1_000), (2, "no")], "doc_id long, text string"), bench).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"]) for r in got] == [(1_000, 30_000), (0, 0)]


def test_texts_without_spans(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(QUERIES["decontaminated_texts"](spark, sf), ORACLE_SQL["decontaminated_texts"], sf) > 100


def test_clashing_names(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c y", [7], "mine", "m", 3)], "doc_id long, text string, _items array<int>, _bytes string, _spans string, _words int")
    (r,) = D.contamination(docs, items, 3).collect()
    assert tuple(r)[2:6] == ([7], "mine", "m", 3) and (r["__items"], r["__spans"], r["__words"]) == ([1], [[1, 4]], 5)
    kept = D.decontaminate(docs, items, 3, longest=2, coverage=0.9)
    assert kept.columns == docs.columns and [tuple(x) for x in kept.collect()] == [(1, "x  y", [7], "mine", "m", 3)]


def test_spans_are_cut_and_documents_dropped(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"Before, {item.upper()}. After this and more and more and even more", 7), (2, item, 7), (3, "clean text", 7), (4, None, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _n int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in D.decontaminate(df, items, coverage=0.6).collect()}
    assert got == {1: "Before, . After this and more and more and even more", 3: "clean text", 4: None}
    assert sorted(r["doc_id"] for r in D.decontaminate(df, items, coverage=0.0).collect()) == [3, 4]
    empty = D.decontaminate(df.limit(0), items.limit(0))
    assert empty.collect() == [] and empty.columns == df.columns


def test_window_of_very_many_items(spark):
    """2,000 items share a prefix that a document repeats: each state's items are united once."""
    prefix = " ".join(f"w{i}" for i in range(30))
    items = [(i, f"{prefix} end{i}") for i in range(2_000)]
    docs = [(1, " ".join([prefix] * 80)), (2, f"{prefix} end7"), (3, "w0 w1"), (4, None)]
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == slow(docs, items)
