import numpy as np

from sensorloom.llm import neighbours as N
from sensorloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def slow(rows, queries, k=5):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in queries:
        own = x[list(ids).index(q)]
        score = (x * own).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((own * own).sum()))
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), score[i]) for i in order]
    return out


def test_recall_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = slow(rows, [r[0] for r in rows if r[0] % 50 == 0])
    got = QUERIES["op1_neighbours"](spark, SF).collect()
    assert len(got) == 5 * len(want)
    hit = 0
    for q, near in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hit += len({m[1] for m in mine} & {i for i, _ in near})
    print("recall", hit / (5 * len(want)))
    assert hit / (5 * len(want)) >= 0.9


def test_odd_rows_and_ties(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(700)]
    bad = [(2000, None), (2050, [0.0] * 6), (2100, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0]), (2150, [float("inf")] * 6), (2200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2250, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, leaf string, rank int")
    s = N.Settings(recall=1.0, leaf_rows=50, block_rows=64, block_queries=3, at_once=2)
    got = N.search(df, "vec_id % 50 = 0", s).collect()
    x = [(i, np.float32(v).tolist()) for i, v in rows]
    want = slow(x, [i for i, _ in rows if i % 50 == 0])
    same = 0
    for q, near in want.items():
        mine = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == q)
        assert np.allclose([m[2] for m in mine], [b for _, b in near]) or q < 1000
        same += [m[1] for m in mine] == [a for a, _ in near]
    assert {g["query_id"] for g in got} == set(want) and same >= 0.9 * len(want)
    assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 1100] == [1000, 1001, 1002, 1003, 1004]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, N.search(df, "vec_id = 0").select("rank", "vec_id").collect())) == [(1, 1), (2, 2)]
    assert N.search(df.limit(0), "vec_id = 0").collect() == []
    assert N.search(df.where("vec_id = 0"), "vec_id = 0").collect() == []


def test_clustered_vectors_need_few_leaves(spark):
    """Recall against brute force on clustered vectors, with a tenth of the leaves opened or fewer."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, 16))
    x = [(i, (centres[i % 60] + 0.15 * r.normal(size=16)).tolist()) for i in range(6_000)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    s = N.Settings(leaf_rows=50)
    seen = []
    calibrated = N.calibrated
    try:
        N.calibrated = lambda tree, *more: seen.append((calibrated(tree, *more), tree.leaves)) or seen[-1][0]
        got = N.search(df, "vec_id % 50 = 0", s).collect()
    finally:
        N.calibrated = calibrated
    want = slow(x, [i for i, _ in x if i % 50 == 0])
    hit = sum(len({g["vec_id"] for g in got if g["query_id"] == q} & {i for i, _ in near}) for q, near in want.items())
    print("recall", hit / (5 * len(want)), "leaves opened, all", seen)
    assert hit >= 0.9 * 5 * len(want) and seen[0][0] <= 0.1 * seen[0][1]


def test_sizes_of_components_do_not_matter(spark):
    """Vectors by 1e200, 1e-200 or 2**900 are as near as the plain ones, and equal ones tie."""
    r = np.random.default_rng(6)
    plain = [(i, r.normal(size=8).tolist()) for i in range(400)] + [(400 + i, [3.0, 1.0, 2.0, 0.0, 1.0, 1.0, 5.0, 7.0]) for i in range(8)]
    factor = [1.0, 1e200, 1e-200, 2.0**900, 1e-310]
    scaled = [(i, [c * factor[i % 4] for c in v]) for i, v in plain[:400]] + [(i, [c * 2.0 ** (100 * i - 40_400) for c in v]) for i, v in plain[400:]] + [(500, [c * 1e-320 for c in (1.0, 0, 0, 0, 0, 0, 0, 0)])]
    plain.append((500, [1.0] + [0.0] * 7))
    s = N.Settings(recall=1.0, leaf_rows=50, block_rows=64)
    got = {}
    for name, rows in (("plain", plain), ("scaled", scaled)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got[name] = {(g["query_id"], g["rank"]): (g["vec_id"], g["score"]) for g in N.search(df, "vec_id % 50 = 0", s).collect()}
    assert got["plain"].keys() == got["scaled"].keys() and len(got["plain"]) == 5 * 10
    for key, (vec_id, score) in got["plain"].items():
        assert np.isclose(got["scaled"][key][1], score, rtol=1e-9), key
    assert [got["scaled"][400, k][0] for k in range(1, 6)] == [401, 402, 403, 404, 405]


def test_long_vectors_take_a_smaller_sample(spark):
    """sample_values bounds the components that the driver holds; every row is still indexed and found."""
    r = np.random.default_rng(8)
    x = [(i, r.normal(size=40).tolist()) for i in range(300)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = N.search(df, "vec_id % 50 = 0", N.Settings(recall=1.0, leaf_rows=20, sample_values=2_000)).collect()
    want = slow(x, [i for i, _ in x if i % 50 == 0])
    assert all([g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == q] == [i for i, _ in near] for q, near in want.items())
