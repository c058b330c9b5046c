import random
import zlib

import numpy as np
from plyforge.llm import toxicity


def test_learns_from_the_training_fold_only(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}"
    rows, labels = [], []
    for k in range(600):
        bad = k % 6 == 0
        words = [word() for _ in range(40)] + (["grobian", "grobianly"] if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        # Labels of the held-out fold are turned round: they must not matter.
        held = zlib.crc32(str(k).encode()) % 5 == 0
        labels.append((k, 0, int(bad) ^ int(held)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 6 == 0) for k in range(600))
    kept = toxicity.without_toxic(docs, model)
    assert {r.doc_id for r in kept.collect()} == {k for k in range(600) if k % 6}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "you idiot, you moron", "c"), (2, "x " * 40_000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, labels)
    scores = sorted((r.score for r in toxicity.scored(docs, model).collect()), reverse=True)
    assert len(scores) == 4 and scores[0] > 0.5 > scores[1] and min(scores) >= 0
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_label_model_orders_voters():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 800)
    good = np.where(rng.random(800) < 0.9, y, 1 - y)
    noise = rng.integers(0, 2, (800, 3))
    post = toxicity.label_model(np.column_stack([good, good, noise]).astype(np.float32), np.where(rng.random(800) < 0.3, y, -1))
    assert ((post > 0.5) == y).mean() > 0.85


def plain_label_model(votes, labels, rounds=12):
    """The same expectation maximisation, a row and a voter at a time."""
    import math

    n, m, sure = len(votes), len(votes[0]), toxicity.LABEL_ACCURACY
    post = [min(0.9, max(0.02, 4 * sum(v) / m)) if y < 0 else (sure if y else 1 - sure) for v, y in zip(votes, labels)]
    share = [1.0] * m
    for turn in range(rounds):
        total = sum(post)
        bad = [(sum(post[i] * votes[i][j] for i in range(n)) + 0.2) / (total + 2) for j in range(m)]
        good = [(sum((1 - post[i]) * votes[i][j] for i in range(n)) + 0.2) / (n - total + 2) for j in range(m)]
        prior = math.log((total + 1) / (n - total + 1))
        if turn == rounds // 2:
            rest = [[votes[i][j] - post[i] * bad[j] - (1 - post[i]) * good[j] for j in range(m)] for i in range(n)]
            both = [[sum(r[a] * r[b] for r in rest) for b in range(m)] for a in range(m)]
            share = [1 / sum(min(1, max(0, both[a][b] / math.sqrt((both[a][a] + 1e-9) * (both[b][b] + 1e-9)))) for b in range(m)) for a in range(m)]
        for i in range(n):
            z = prior + (0 if labels[i] < 0 else (2 * labels[i] - 1) * math.log(sure / (1 - sure)))
            for j in range(m):
                z += share[j] * (math.log(bad[j] / good[j]) if votes[i][j] else math.log((1 - bad[j]) / (1 - good[j])))
            post[i] = 1 / (1 + math.exp(-min(30, max(-30, z))))
    return post


def test_label_model_as_by_hand():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 90)
    votes = np.column_stack([np.where(rng.random(90) < a, y, 1 - y) for a in (0.9, 0.8, 0.7)] + [rng.integers(0, 2, 90)])
    votes = np.column_stack([votes, votes[:, 0]])
    labels = np.where(rng.random(90) < 0.5, y, -1)
    got = toxicity.label_model(votes.astype(np.float32), labels)
    assert np.abs(got - plain_label_model(votes.tolist(), labels.tolist())).max() < 1e-3
    # Copies of a voter say together little more than one of them.
    copied = toxicity.label_model(np.column_stack([votes, *[votes[:, :1]] * 6]).astype(np.float32), labels)
    assert np.abs(copied - got).mean() < 0.1


def test_filter_of_null_and_long_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "you idiot, you moron"), (3, "x " * 100_000)], "doc_id long, text string")
    model = toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(r.doc_id for r in toxicity.without_toxic(docs, model).collect()) == [1, 3]
