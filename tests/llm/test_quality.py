import numpy as np

from sensorloom.llm import quality as Q
from sensorloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_against_labels(spark):
    """The labels are not used in training."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op5_quality"](spark, SF).join(labels, "doc_id").toPandas()
    y, s = got["quality"].to_numpy(), got["score"].to_numpy()
    rank = np.argsort(np.argsort(s, kind="stable"))
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    print("auc", auc, "good kept", got["keep"][y == 1].mean(), "bad kept", got["keep"][y == 0].mean())
    assert auc > 0.95 and got["keep"][y == 1].mean() > 0.97 and got["keep"][y == 0].mean() < 0.3


def test_em_finds_accuracies():
    r = np.random.default_rng(3)
    y = r.random(20_000) < 0.6
    cast = np.stack([np.where(r.random(len(y)) < 0.2, 0, np.where(r.random(len(y)) < a, y + 1, 2 - y)) for a in (0.9, 0.8, 0.7, 0.9, 0.6, 0.75, 0.85)], axis=1)
    pattern, counts = np.unique(cast @ 3 ** np.arange(6, -1, -1), return_counts=True)
    post = dict(zip(pattern, Q.expectation_maximisation(pattern, counts.astype(float), 100)))
    guess = np.array([post[p] for p in cast @ 3 ** np.arange(6, -1, -1)]) > 0.5
    assert (guess == y).mean() > 0.95


def slow_em(cast, rounds):
    """Document by document and labeller by labeller, from the same start."""
    p = [[[0.3, 0.3, 0.4], [0.3, 0.02, 0.68]] for _ in cast[0]]
    prior = [0.3, 0.7]
    for _ in range(rounds):
        post = []
        for votes in cast:
            like = [prior[k] * np.prod([p[j][k][v] for j, v in enumerate(votes)]) for k in (0, 1)]
            post.append([x / sum(like) for x in like])
        size = [sum(q[k] for q in post) for k in (0, 1)]
        prior = [(x + 1) / (len(cast) + 2) for x in size]
        p = [[[(sum(q[k] for q, votes in zip(post, cast) if votes[j] == v) + 1) / (size[k] + 3) for v in (0, 1, 2)] for k in (0, 1)] for j in range(len(cast[0]))]
    return [q[1] for q in post]


def test_against_documents_one_by_one(spark):
    """Posteriors by a slow expectation-maximisation, and scores by the scorer's weights, a row at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = Q.Settings(em_rounds=30)
    posterior, scorer = Q.train(docs, s)
    got = {r["doc_id"]: r for r in Q.report(docs, s).collect()}
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    read = [Q.statistics(t) for _, t in rows]
    cast = [[Q.BAD if bad(x) else Q.GOOD if good(x) else Q.ABSTAIN for x, (bad, good) in zip(stats, Q.LABELLERS)] for _, stats in read]
    for (i, text), (words, stats), want in zip(rows, read, slow_em(cast, 30)):
        assert abs(got[i]["posterior"] - want) < 1e-9
        z = scorer.bias + sum(scorer.weights[b] for b in Q.stat_buckets(np.array([stats]), scorer.buckets)[0])
        each = [scorer.weights[a[0]] + scorer.weights[b[0]] for a, b in (Q.word_buckets([w], scorer.buckets) for w in words)]
        z += sum(each) / max(1, len(each))
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and got[i]["keep"] == (got[i]["score"] >= 0.5)
    # the scorer's features, and a step of its descent, by hand
    d, b, v, pattern = Q.features([t for _, t in rows], s.buckets)
    assert [posterior[p] for p in pattern] == [got[i]["posterior"] for i, _ in rows]
    for k in range(20):
        want = {}
        for x in Q.stat_buckets(np.array([read[k][1]]), s.buckets)[0]:
            want[int(x)] = want.get(int(x), 0) + 1
        for w in read[k][0]:
            for x in Q.word_buckets([w], s.buckets):
                want[int(x[0])] = want.get(int(x[0]), 0) + 1 / len(read[k][0])
        mine = dict(zip(b[d == k].tolist(), v[d == k].tolist()))
        assert mine.keys() == want.keys() and all(abs(mine[x] - want[x]) < 1e-9 for x in want)


def test_long_texts_are_learned_from(spark):
    """Bad texts are short and good ones long."""
    good = "The river ran by the old house, and nobody had seen it before. " * 400
    rows = [(i, good + f" End {i}.") for i in range(20)] + [(100 + i, "BUY $$$ NOW!!! ### " * 40 + str(i)) for i in range(20)]
    got = Q.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(good) > 20_000 and all(r["keep"] == (r["doc_id"] < 100) for r in got)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "word " * 60_000, None), (None, "a b", 0.2), (4, "Same row here", 1.0), (4, "Same row here", 1.0)], "doc_id long, text string, score double")
    got = Q.report(df).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    assert Q.report(df.limit(0)).collect() == []
