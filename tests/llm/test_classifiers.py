import numpy as np
from pyspark.sql import functions as F

from sensorloom.llm import language, quality, toxicity
from sensorloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op6_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    y, hit = got["toxic"].to_numpy(), got["predicted"].to_numpy()
    print("auc", auc(got["score"].to_numpy(), y), "recall", hit[y == 1].mean(), "precision", y[hit == 1].mean())
    assert auc(got["score"].to_numpy(), y) > 0.9
    assert hit[y == 1].mean() > 0.8 and hit[y == 0].mean() < 0.02


def test_pairs_count(spark):
    """Two words that are harmless alone and toxic together: an additive score can't tell."""
    r = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(1500):
        a, b = r.random(2) < 0.5
        texts.append(" ".join([*["filler"] * 3, *["insulta"] * int(a), *["gruppe"] * int(b), f"w{chr(97 + r.integers(26))}"]))
        y.append(int(a and b))
    m = toxicity.fit(texts, np.array(y), toxicity.Settings(least_z=3))
    s = m.scores(["filler insulta gruppe", "filler insulta", "filler gruppe", "filler", "", None])
    assert s[0] > 0.5 and max(s[1:]) < 0.3


def test_pairs_of_words_that_say_nothing_alone(spark):
    """Toxic if both words are there or neither: no single term differs between the classes."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        a, b = r.random(2) < 0.5
        rows.append((i, " ".join([*["insulta"] * int(a), *["gruppe"] * int(b), *(f"w{chr(97 + k)}" for k in r.integers(0, 26, 4))]), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(docs, docs, held_out=(4, 2))
    s = m.scores(["insulta gruppe wa", "insulta wb", "gruppe wc", "wa wb"])
    assert s[0] > 0.7 and s[3] > 0.7 and s[1] < 0.3 and s[2] < 0.3
    got = toxicity.with_scores(docs.where("crc32(cast(doc_id AS string)) % 4 = 2"), m, 0.5)
    assert got.where("_predicted = toxic").count() > 0.95 * got.count()


def test_pair_sum_against_all_pairs(spark):
    """Scores over a table, from the sum over all pairs of terms, one after another."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert 50 < len(m.keys) <= toxicity.Settings().terms
    at = {int(k): p for k, p in zip(m.keys, m.params)}
    for r in toxicity.with_scores(docs, m).collect()[:300]:
        words = sorted({w for w in "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower()).split()})
        vectors = []
        for w in words:  # a word's terms: their weights and factors add up, its own pairs don't count
            terms = [at[int(b[0])] for own, b in toxicity.word_terms([w], m.buckets) if len(b) and int(b[0]) in at]
            vectors.append([(t[0], t[1:-1]) for t in terms])
        flat = [t for v in vectors for t in v]
        z = m.bias + sum(t[0] for t in flat) + sum(float(a[1] @ b[1]) for i, a in enumerate(flat) for b in flat[:i])
        assert abs(r["_score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
        assert r["_predicted"] == (r["_score"] >= 0.3)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op4_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    print("accuracy", right)
    assert right[0] > 0.95 and 0 <= right[1] and right[2] <= 1


def test_forward_backward_is_exact():
    r = np.random.default_rng(1)
    m = language.Crf(["a", "b", "c"], 64, r.normal(size=(68, 3)).astype(np.float32), r.normal(size=(3, 3)).astype(np.float32), {"abc": 1})
    texts = ["abc", "", None, "one two three four", "x yy", "12 34", "abc abc x one"]
    mean, lengths = m.posteriors(texts)
    for k, t in enumerate(texts):
        words = (t or "").split() if lengths[k] else []
        if not words:
            assert not mean[k].any()
            continue
        e, want, total = m.potentials(words), np.zeros(3), 0
        for path in np.ndindex(*[3] * len(words)):
            p = np.exp(sum(e[i, s] for i, s in enumerate(path)) + sum(m.transitions[a, b] for a, b in zip(path, path[1:])))
            total += p
            want += p * np.bincount(path, minlength=3) / len(words)
        assert np.allclose(mean[k], want / total, atol=1e-4)


def test_code_switched_text():
    s = language.Settings(segments=600, epochs=3)
    m = language.fit(["the house and the tree of"] * 20 + ["das haus und der baum von"] * 20, ["en"] * 20 + ["de"] * 20, s)
    assert m.predict(["the tree and house", "der baum und haus", "...", None])[0] == ["en", "de", "und", "und"]
    mean, _ = m.posteriors(["the tree and house der baum und haus"])
    assert abs(mean[0, 0] - 0.5) < 0.1


def test_odd_rows(spark):
    rows = [(1, None, None, "s", 0), (2, "", "en", "s", 0), (3, "x " * 80_000, "en", None, 1), (4, "abc def", None, "s", None), (4, "abc def", "de", "s", None), (None, "abc", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _score string, held_out int")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (3, 1)], "doc_id long, toxic int")
    assert len(language.report(df).collect()) == len(toxicity.report(df, labels).collect()) == len(rows)
    for empty in (df.limit(0), df.where("doc_id = 1")):
        assert all(r["lang_pred"] == "und" for r in language.report(empty).collect())
        assert toxicity.report(empty, labels.limit(0)).count() == empty.count()


LONG = {"en": "the house and the tree of a garden by the river ", "de": "das haus und der baum in dem garten an dem fluss ", "fr": "la maison et le jardin avec un arbre de la rue "}


def test_long_texts_are_learned_from(spark):
    """Tables with long texts only, and with one class in long texts only."""
    rows = [(i, LONG[k] * 600, k, int(k == "fr")) for i, k in enumerate(["en", "de", "fr"] * 14)]
    only = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    mixed = only.unionByName(spark.createDataFrame([(1000 + i, LONG[k] * 3, k, 0) for i, k in enumerate(["en", "de"] * 40)], only.schema))
    for docs in (only, mixed):
        assert min(len(r["text"]) for r in docs.where("lang = 'fr'").collect()) > 20_000
        got = language.report(docs).join(docs, "doc_id").collect()
        assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.5 for r in got)
        score = toxicity.report(docs, docs).join(docs, "doc_id").collect()
        assert all(r["predicted"] == r["toxic"] for r in score)


def test_results_depend_on_their_own_row_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    crf = language.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    fm = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    posterior, scorer = quality.train(docs)
    texts = [r["text"] or "" for r in docs.collect()]

    def all_of(some):
        read = [quality.statistics(t.encode()) for t in some]
        return list(zip(*crf.predict(some), fm.scores(some), scorer.scores([w for w, _ in read], [x for _, x in read])))

    want = dict(zip(texts, all_of(texts)))
    order = np.random.default_rng(1).permutation(len(texts))
    for some in ([texts[i] for i in order], [t for t in texts[:40] for _ in range(3)], texts[500:503]):
        assert all_of(some) == [want[t] for t in some]
    assert all(all_of([t])[0] == want[t] for t in texts[:60])
    shuffled = docs.union(docs).repartition(5)
    for build in (lambda d: toxicity.with_scores(d, fm), lambda d: language.with_language(d, crf)):
        one, two = (sorted(tuple(r) for r in build(d).selectExpr("doc_id", "_score").collect()) for d in (docs, shuffled))
        assert two == sorted(one * 2)


def test_letters_and_clashing_names(spark):
    model = language.fit([LONG["en"]] * 20 + [LONG["de"]] * 20, ["en"] * 20 + ["de"] * 20, language.Settings(segments=600))
    docs = spark.createDataFrame([(1, "\u00bd \u00b2 \u2167 \u2460", "mine", 7), (2, "the tree", "mine", 7)], "doc_id long, text string, _lang string, _score int")
    got = language.with_language(docs, model)
    assert got.columns == ["doc_id", "text", "_lang", "_score", "__lang", "__score"]
    assert [(r["_lang"], r["_score"], r["__lang"]) for r in got.orderBy("doc_id").collect()] == [("mine", 7, "und"), ("mine", 7, "en")]
    fm = toxicity.fit(["a b c"] * 9, np.zeros(9), toxicity.Settings())
    assert [tuple(r)[2:4] for r in toxicity.with_scores(docs, fm).collect()] == [("mine", 7)] * 2
