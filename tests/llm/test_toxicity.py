import random
import zlib

import numpy as np

from gaugemill.llm import toxicity as t


def corpus(n=900):
    rnd = random.Random(1)
    bad = ["grumpf", "blarg", "snerk"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(60)]
        toxic = int(rnd.random() < 0.15)
        for _ in range(3 * toxic):
            words[rnd.randrange(60)] = rnd.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_rows_are_told_apart(spark, make):
    docs, labels = corpus()
    got = t.score(make(docs), t.fit(make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(held) > 150
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_never_used(spark, make):
    docs, labels = corpus(300)
    schema = "doc_id long, quality int, toxic int"
    wrong = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    a, b = (t.fit(make(docs), spark.createDataFrame(x, schema)) for x in (labels, wrong))
    assert a.intercept == b.intercept and np.array_equal(a.buckets, b.buckets) and np.array_equal(a.weights, b.weights)


def test_held_out_rows_of_the_real_table(spark):
    """Recall and precision on rows that are never learned from, on 10,000 documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    got = t.score(docs, t.fit(docs, labels)).join(labels, "doc_id").where("held_out and toxic is not null").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    hit, missed, wrong = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert hit + missed > 100 and hit >= 0.9 * (hit + missed) and hit >= 0.85 * (hit + wrong)  # measured: 113 of 120 found, 17 others


def test_label_model_finds_the_voters_rates_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.stack([rng.random(4000) < np.where(y, p, q) for p, q in ((0.8, 0.1), (0.6, 0.02), (0.5, 0.5))], axis=1)
    votes = np.column_stack([votes, votes[:, 0]])
    given = np.where(rng.random(4000) < 0.1, 1 - y, y).astype(float)
    q, rates, weight = t.label_model(votes, given)
    assert abs(rates[1][0] - 0.8) < 0.1 and abs(rates[0][1] - 0.02) < 0.05
    assert weight[0] < weight[1] and weight[3] < weight[1]  # the doubled voter counts less
    assert np.mean((q > 0.5) == y) > np.mean(given == y)


def test_features_do_not_depend_on_how_texts_are_cut(monkeypatch):
    texts = ["alpha beta alpha", None, "", "BETA!! gamma", "x " * 500]
    whole = t.features(texts)
    monkeypatch.setattr(t, "pieces", lambda sizes: ((i, i + 1) for i in range(len(sizes))))
    assert all(np.array_equal(a, b) for a, b in zip(whole, t.features(texts)))


def test_odd_rows(spark, odd, none, make):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 0), (5, None, 1), (5, 1, 0), (9, 1, None), (None, 1, 1), (77, 0, 1)], schema)
    got = t.score(odd, t.fit(odd, labels)).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 4)}) == 1
    assert t.score(none, t.fit(none, labels)).count() == 0
    assert all(r.score < 0.3 for r in t.score(odd, t.fit(odd, labels.limit(0))).collect())
