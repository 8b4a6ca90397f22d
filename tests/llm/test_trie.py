import random
import zlib
from collections import defaultdict
from hashlib import sha256

from oracle import compare

from sensorloom.llm import trie as T
from sensorloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string, name long"


def slow(rows):
    """Nodes by dicts of tuples."""
    digest = lambda r, t: sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for c, turn, r, t in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(r or "", t or ""), r or "", t or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 6, abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        whole[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    sums = {}
    for k in sorted(members, key=len, reverse=True):
        text = len(k[-1][1]) if k else 0
        sums[k] = (sum(sums[x][0] for x in kids[k]) or (not kids[k]), (len(members[k]) - 1) * text + sum(sums[x][1] for x in kids[k]))
    ends = lambda k: ",".join(str(c) for c in members[k] if len(whole[c]) == len(k))
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), int(sums[k][0]), sums[k][1], sha256(ends(k).encode()).hexdigest()) for k, m in members.items())


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = sorted(map(tuple, T.report(df).collect()))
    assert got == slow(rows)
    return got


def test_against_dicts(spark):
    """Shared first turns, copies, nulls, ties, repeated rows, missing and turnless conversations, negative and null ids."""
    r = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 240), -7, -250, 10**12]:
        for i in range(r.randrange(1, 7)):
            rows.append((c, i if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["", None, "a", "éé", "b" * 5])))
    rows += rows[:20] + [(None, 0, "user", "nobody's"), (300, 0, "user", "a"), (400, None, None, None)]
    got = check(spark, rows)
    assert got[0][1] >= 0 and max(x[3] for x in got) == len({x[0] for x in rows if x[0] is not None})


def test_copies_long_and_turnless(spark):
    """Many copies of one conversation, one of 400 turns, and one that only its first turns have."""
    rows = [(500 + c, i, "user", f"t{i}") for c in range(99) for i in range(7)] + [(600, i, "user", f"u{i}") for i in range(400)] + [(c, 0, "user", "gone") for c in range(700, 712)]
    got = check(spark, rows)
    assert any(x[3] > 20 and x[1] > 5 for x in got) and max(x[1] for x in got) == 400


def test_empty_table(spark):
    assert check(spark, []) == []


def test_ids_in_several_texts(spark):
    ids = list(range(-50, 300))
    df = spark.createDataFrame([(0, 5, i) for i in reversed(ids)] + [(1, 5, 9)], "depth int, name long, conv_id long")
    got = {r["depth"]: r["sha"] for r in T.id_digests(df, ["depth", "name"], 7).collect()}
    assert got == {0: sha256(",".join(map(str, ids)).encode()).hexdigest(), 1: sha256(b"9").hexdigest()}


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(QUERIES["op12_trie"](spark, sf), ORACLE_SQL["op12_trie"], sf) > 40
