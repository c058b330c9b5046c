"""Every document replayed through every order by hand, and odd input."""

import random
from itertools import permutations

from plyforge.llm import filter_audit


def by_hand(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    rows = [(i, t or "", s or "") for i, t, s in docs]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out = {}
    fails = []
    for i, t, s in rows:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        f = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in rows),
        }
        fails.append((s, f, i in good, i in toxic))
    for part in {s for *_, s in rows}:
        mine = [x for x in fails if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                here = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                failing = [x for x in mine if x[1][k]]
                shapley[k] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), len(failing) - len(here), sum(sum(x[1].values()) == 1 for x in failing), sum(x[2] for x in here), sum(x[3] for x in here), k]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[key[1][key[2] - 1]]
    return {k: tuple(v) for k, v in out.items()}


def ours(spark, docs, labels, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    if extra:
        d = d.selectExpr("*", "1 AS mask", "2 AS part", "3 AS first", "'x' AS filter_order")
    made = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in made}


def test_against_replay_by_hand(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "d#", "EPS", "zeta\x0b", "eta x", *(f"w{i}" for i in range(40))]
    docs = []
    for i in range(120):
        text = rng.choice([" ", "\t", "\n "]).join(rng.choices(words[7:] if i % 2 else words, k=rng.choice([0, 5, 49, 50, 70])))
        docs.append((i, text if rng.random() < 0.7 or not docs else rng.choice(docs)[1], rng.choice(["a", "b", None, ""])))
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130, 2)]
    got = ours(spark, docs, labels)
    assert got == by_hand(docs, labels)
    assert len(got) == 600 * len({s or "" for *_, s in docs})


def test_odd_input(spark):
    docs = [(5, None, None), (5, "", ""), (None, "", "a"), (3, "", "b"), (7, " ".join(f"w{i}" for i in range(200_000)), "b"), (7, "same", "a"), (7, "same", "a"), (8, "same", "a")]
    labels = [(5, 1, None), (5, 0, 1), (None, 1, 1), (7, None, 1), (99, 1, 1)]
    assert ours(spark, docs, labels, extra=True) == by_hand(docs, [(i, q, x) for i, q, x in labels if i is not None])
    assert ours(spark, [], labels) == {}
    assert ours(spark, docs, []) == by_hand(docs, [])


def test_rows_meet_the_orders_combined(spark):
    """However many documents share flags and labels, one row of them meets the orders."""
    docs = spark.createDataFrame([(i, "one text", "a") for i in range(500)] + [(1000 + i, f"text {i}", "a") for i in range(500)], "doc_id long, text string, source string")
    rows = filter_audit.flags(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.mask, r.n) for r in rows) == [(1, 501), (17, 499)]
