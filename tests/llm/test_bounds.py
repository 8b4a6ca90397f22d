import os

from pyspark.sql import functions as F

from sensorloom.llm import common, language, quality, toxicity


def test_fit_samples_of_large_tables(spark, monkeypatch):
    """What the models are fitted on when there is more than enough."""
    taken = {}
    for module in (language, quality, toxicity):
        def counting(rows, keys, most, name=module.__name__.split(".")[-1]):
            out = common.sampled(rows, keys, most)
            taken[name] = out.count()
            return out

        monkeypatch.setattr(module, "sampled", counting)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.lit("en").alias("lang"))
    language.train(docs)
    quality.train(docs)
    toxicity.train(docs, docs.selectExpr("doc_id", "doc_id % 2 AS toxic"))
    assert taken == {"language": 4_000, "quality": 6_000, "toxicity": 12_000}
    assert language.Settings().segments == 16_000 and toxicity.Settings().terms == 2_048


def test_copies_do_not_fill_a_sample(spark):
    rows = spark.range(3_000).selectExpr("CASE WHEN id < 2900 THEN -1 ELSE id END AS k")
    for most in (5, 50, 101, 1_000):
        got = [r["k"] for r in common.sampled(rows, ["k"], most).collect()]
        assert len(got) == len(set(got)) == min(most, 101)
    hashes = sorted((r[0], r[1]) for r in rows.distinct().select(F.xxhash64("k"), "k").collect())
    assert {k for _, k in hashes[:50]} == {r["k"] for r in common.sampled(rows, ["k"], 50).collect()}


def test_scratch_removes_its_folders(spark):
    before = list(common.WRITTEN)
    with common.scratch(spark):
        path = common.save(spark.range(3), "gone").inputFiles()[0]
        kept = common.save(spark.range(3), "kept", keep=True)
    assert kept.count() == 3 and common.WRITTEN == before
    assert not os.path.exists(path.removeprefix("file://"))


def test_letters():
    assert common.letter_words("ab\u00bd \u00b2 \u2167 \u2460 \u00e9_x 12 \u65e5\u672c3\u8a9e") == ["ab", "\u00e9", "x", "\u65e5\u672c", "\u8a9e"]
