import hashlib

from oracle import compare

from sensorloom.llm import chat as C
from sensorloom.llm.queries import ORACLE_SQL, QUERIES


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(QUERIES["op10_chat"](spark, sf), ORACLE_SQL["op10_chat"], sf) > 10


def test_round_trip_of_odd_texts(spark):
    odd = ["", None, "\\", "#", "\\#", "</turn>\n", "### assistant: x</turn>\n", "a: b", "\\\\/", "<\\/turn>", "é😀\u0000x", "x" * 300_000, ": ", "$1 \\$1"]
    roles = ["assistant", "user", None, "a: b", "\\:", "sys</turn>\n", "###"]
    rows = [(i % 4, i // 4, roles[(i * 5) % 7], odd[i % len(odd)], "x", 3) for i in range(56)] + [(None, 0, "user", "hi", "x", 3), (8, None, "assistant", "late", "x", 3), (8, None, "assistant", "late", "x", 3), (9, 1, "user", "no reply", "x", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string, i int")
    got = {r["conv_id"]: r for r in C.read_back(C.examples(df)).collect()}
    assert set(got) == {0, 1, 2, 3, None, 8, 9}
    for c, r in got.items():
        turns = sorted([(x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c])
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_one_example_for_each_reply(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(5)], "conv_id long, turn long, role string, text string")
    rows = sorted(C.examples(df).collect(), key=lambda r: r["example"])
    assert [r["example"] for r in rows] == [1, 3, 4] and [r["loss_length"] for r in rows] == [2, 2, 0]
    assert rows[0]["text"] == "### user: t0</turn>\n### assistant: t1</turn>\n"
    assert all(r["text"][r["loss_start"] - 1 :][: r["loss_length"]] == f"t{r['example']}" for r in rows[:2])
    assert C.examples(df.limit(0)).collect() == []


def test_plan_is_native(spark):
    plan = QUERIES["op10_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
