from collections import defaultdict
from fractions import Fraction

from oracle import compare

from sensorloom.llm import mixing as M
from sensorloom.llm.queries import ORACLE_SQL, QUERIES


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(QUERIES["op3_mixing"](spark, sf), ORACLE_SQL["op3_mixing"], sf) > 50


def fill(budget, children):
    """Slow water filling: (name, weight, capacity) -> tokens as fractions."""
    given, open_ = dict.fromkeys((c[0] for c in children), Fraction(0)), list(children)
    while open_ and budget > 0:
        w = sum(c[1] for c in open_)
        full = [c for c in open_ if c[2] <= Fraction(budget) * c[1] / w]
        if not full:
            for c in open_:
                given[c[0]] = Fraction(budget) * c[1] / w
            break
        for c in full:
            given[c[0]] = Fraction(c[2])
            budget -= c[2]
        open_ = [c for c in open_ if c not in full]
    return given


def test_shortage_goes_to_siblings_first(spark):
    rows = [("books", "en", "a", 100), ("books", "en", "b", 5000), ("books", "de", "c", 4000), ("web", "en", "d", 3000), ("web", "fr", "e", 10), ("code", "en", "f", 7)]
    mix = M.Mix(domain_weights={"books": 1, "web": 1, "code": 1}, language_weights={}, share=(1, 2))
    got = {r[:3]: r["given"] for r in M.budgets(spark.createDataFrame(rows, "domain string, language string, origin string, tokens long"), mix).collect()}
    total = sum(r[3] for r in rows) // 2

    def down(prefix, budget):
        kids = defaultdict(int)
        for r in rows:
            if r[: len(prefix)] == prefix:
                kids[r[len(prefix)]] += 2 * r[3]
        for name, x in fill(budget, [(k, 1, c) for k, c in kids.items()]).items():
            if len(prefix) == 2:
                assert abs(got[(*prefix, name)] - x) <= 3
            else:
                down((*prefix, name), x)

    down((), total)
    assert abs(sum(got.values()) - total) <= 6 and got["books", "en", "a"] == 200


def test_odd_rows(spark):
    rows = [(i, f"w{i} " * (i % 9), [None, "en", "de"][i % 3], [None, "src1", "", "x9999999999"][i % 4], 0) for i in range(200)] + [(5, "same row", "en", "src1", 0)] * 3 + [(None, "a b", "en", "src1", 0), (900, None, "en", "src1", 0), (901, "long " * 40_000, "fr", "src2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, given int").selectExpr("*", "1 AS epoch", "'q' AS domain")
    got = M.report(df.drop("domain", "epoch")).collect()
    spent = defaultdict(int)
    for r in got:
        spent[r["domain"], r["language"], r["origin"], r["leaf_budget"]] += r["n_tokens"]
    assert got and all(v <= k[3] for k, v in spent.items()) and max(r["epoch"] for r in got) <= 1
    out = M.mixed_documents(df)
    assert out.columns == [*df.columns, "_epoch"] and all((r["epoch"], r["domain"], r["given"]) == (1, "q", 0) for r in out.collect())
    key = lambda rows: sorted(str((r["doc_id"], r[-1])) for r in rows)
    assert key(out.select("doc_id", "_epoch").collect()) == key(M.mixed_documents(df.drop("domain", "epoch")).select("doc_id", "epoch").collect())
    assert {r["domain"] for r in M.report(df, M.Mix(domain="domain")).collect()} == {"q"}
    assert M.report(df.limit(0)).collect() == []
    few = M.report(df, M.Mix(most_leaves=1)).collect()
    assert sorted(map(str, few)) == sorted(map(str, got))
