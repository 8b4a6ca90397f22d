import random
from collections import defaultdict

import xxhash

from sensorloom.llm import simhash as S
from sensorloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, fp string, rep int, component_id int"


def slow_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius=4):
    """fps: (id, fp) pairs."""
    parent = {i: i for i, _ in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = defaultdict(list)
    for i, f in fps:
        distinct[f].append(i)
    keys = list(distinct)
    groups = [v for v in distinct.values()] + [distinct[a][:1] + distinct[b][:1] for n, a in enumerate(keys) for b in keys[:n] if (a ^ b).bit_count() <= radius]
    for g in groups:
        for x in g[1:]:
            a, b = top(g[0]), top(x)
            parent[max(a, b)] = min(a, b)
    return {i: top(i) for i, _ in fps}


def test_masks_cover_every_pair():
    masks = S.covering_masks(list(range(64)), 4)
    assert len(masks) == 31 and min(m.bit_count() for m in masks) >= 32
    r = random.Random(1)
    for _ in range(3000):
        d = sum(1 << p for p in r.sample(range(64), r.randrange(1, 5)))
        assert any(not d & m for m in masks)
    for m in masks:
        assert min(x.bit_count() for x in S.covering_masks([p for p in range(64) if not m >> p & 1], 4)) >= 14


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op8_simhash"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [(d["doc_id"], slow_fp(d["text"])) for d in docs]
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == dict(fps)
    assert {r["doc_id"]: r["component_id"] for r in got} == slow_components(fps)


def test_odd_rows(spark):
    """Null and empty texts share fingerprint zero; clashing column names, ties and repeated rows are fine."""
    rows = [(1, None, "x", 1, 1), (2, "", "y", 2, 2), (3, " \t\n", "z", 3, 3), (None, "a b c d e", "", 0, 0), (5, "one two", None, None, None), (4, "ONE  Two", None, None, None), (4, "ONE  Two", None, None, None), (6, "w " * 50_000 + "x", None, None, None)]
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}
    assert by[5] == by[4] and {c for _, c in by[4]} == {4}
    assert {c for _, c in by[None]} == {None}
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_overflowing_buckets_lose_no_link(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << p for p in r.sample(range(64), r.randrange(0, 6))) for b in base for _ in range(60)}
    rows = [(S.signed(f), i) for i, f in enumerate(sorted(fps))]
    classes = spark.createDataFrame(rows, "fp long, rep long")
    want = slow_components([(i, f % (1 << 64)) for f, i in rows])
    for limit in (20_000, 3):
        roots = {x["node"]: x["root"] for x in S.components(S.links(classes, 4, limit)).collect()}
        assert {i: roots.get(i, i) for _, i in rows} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in S.components(edges).collect()} == {0}
