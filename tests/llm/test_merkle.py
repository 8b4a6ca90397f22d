import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from oracle import compare

from sensorloom.llm import merkle as M
from sensorloom.llm.common import crc32_sql
from sensorloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp int, pos int"


def hashed(parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow(rows, arity=3):
    """Every row's columns, by lists."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: hashed([field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text)])

    def build(nodes):
        """Root and, for each node, its siblings as (left, right) by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, a in enumerate(at):
                first = a - a % arity
                paths[i].append((nodes[first:a], nodes[a + 1 : first + arity]))
                at[i] = a // arity
            nodes = [hashed(nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        groups[r[3]].append((r[0], leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if bad else r[1])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = build([x[1] for x in groups[s]])
    root, uppers = build([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, upper in zip(order, uppers):
        for (doc, own, bad), path in zip(groups[s], trees[s][1]):
            whole, back = path + upper, bad
            for left, right in whole:
                back = hashed([*left, back, *right])
            out.append((doc, own, trees[s][0], root, hashed([x for left, right in whole for x in (*left, *right)]), back, back == root))
    return sorted(out, key=str)


def rows_of(n, sources):
    texts = ["a\nb", "", None, "\n", "é😀\nx", "plain", "y" * 5000]
    return [(i * 7 % (n - n // 5) if i % 11 else None, texts[i % 7], [None, "en"][i % 2], sources[(i * i) % len(sources)], [None, 3, 44][i % 3], "x", 1, 2) for i in range(n)]


@pytest.mark.parametrize("shape", [M.Shape(), M.Shape(levels=1, top=4), M.Shape(levels=2, top=3), M.Shape(arity=2, levels=1, top=1)])
@pytest.mark.parametrize("n, sources", [(1, ["a"]), (40, ["a", None, "", "é", "Z"]), (90, ["a"] * 9 + ["b"]), (30, [f"s{i}" for i in range(30)])])
def test_against_lists(spark, shape, n, sources):
    """Nulls, ties, repeated rows, clashing names; one node, many groups, several rounds."""
    rows = rows_of(n, sources) + rows_of(n, sources)[: n // 2]
    got = M.report(spark.createDataFrame(rows, SCHEMA), shape).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows, shape.arity)


def test_more_groups_than_the_driver_takes(spark):
    rows = [(i, "t\nt", "en", f"s{i % 50}", 1, "x", 1, 2) for i in range(60)]
    assert sorted(map(tuple, M.report(spark.createDataFrame(rows, SCHEMA), M.Shape(levels=1, top=5)).collect()), key=str) == slow(rows)


def test_empty_table(spark):
    assert M.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_crc32_in_sql():
    for x in (0, 7, 10, 128, 99999, 123456789, -5):
        assert duckdb.sql(f"SELECT {crc32_sql(str(x) if x >= 0 else f'({x})')}").fetchall()[0][0] == zlib.crc32(str(x).encode())


def test_against_sql(spark):
    assert compare(QUERIES["op13_merkle"](spark, "/root/testdata/sf0.001"), ORACLE_SQL["op13_merkle"], "/root/testdata/sf0.001") >= 200
