import random

import numpy as np
from plyforge.llm import common, minhash


def brute(rows, n, percent):
    words = common.WordHashes()
    sets = {i: set(minhash.shingles(t or "", n, words).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 9, 60, 150]))] for _ in range(25)]
    rows = []
    for k in range(260):
        words = list(base[0] if k % 3 == 0 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(900)}"
        rows.append((1000 - k, " ".join(words)))
    return rows + [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "Two Words")]


def test_components_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.linked(docs, n, percent).collect()}
        assert got == brute(rows, n, percent)


def test_postings_count_all_collisions():
    rng = np.random.default_rng(7)
    for n, values, least in ((1, 3, 5), (40, 2, 60), (300, 40, 20), (300, 3, 63), (64, 1, 96)):
        sigs = rng.integers(0, values, (n, minhash.K)).astype(np.uint64)
        sigs[n // 2 :] = np.where(rng.random((n - n // 2, minhash.K)) < 0.2, sigs[n // 2 :], sigs[0])
        lists = minhash.Postings(sigs, least)
        for x in range(n):
            counts = (sigs[:x] == sigs[x]).sum(1)
            near, hits = lists.matches(x, lists.earlier(x))
            assert near.tolist() == np.flatnonzero(counts >= least).tolist() and hits.tolist() == counts[counts >= least].tolist()


def test_pairs_at_the_threshold_are_candidates():
    rng, least = np.random.default_rng(11), minhash.least_matches(0.85)
    fewest = minhash.K
    for _ in range(1500):
        shared, own = rng.integers(0, 1 << 63, 170).astype(np.uint64), rng.integers(0, 1 << 63, 30).astype(np.uint64)
        a, b = np.concatenate([shared, own[:15]]), np.concatenate([shared, own[15:]])
        fewest = min(fewest, int((minhash.signature(np.unique(a)) == minhash.signature(np.unique(b))).sum()))
    assert fewest >= least


def test_counts_are_summed_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sigs = [minhash.packed(rng.integers(0, 50, minhash.K).astype(np.uint64)) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in sigs], "sig binary").repartition(9)
    monkeypatch.setattr(minhash, "ADDENDS", 2)
    table = minhash.pair_counts(df)
    keys = minhash.pair_hashes(minhash._stack(__import__("pyarrow").array(sigs))) >> np.uint64(64 - minhash.COUNT_BITS)
    assert table.sum() == keys.size and (table == np.bincount(keys.ravel().astype(np.int64), minlength=len(table))).all()


def test_groups_of_several_blocks(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.linked(docs, 3, 85, block=8).collect()}
    assert got == brute(rows, 3, 85)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.linked(docs, 3, 85).collect())
    assert rows == [(-1, -1, True), (-1, -1, True), (3, 3, True), (3, 3, True), (9, 3, False)]
    assert minhash.linked(docs.limit(0), 3, 85).count() == 0
    kept = minhash.drop_near_copies(docs.withColumn("sig", docs.text).withColumn("_gone", docs.text), 3, 85)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 3, 3] and kept.columns == ["doc_id", "text", "sig", "_gone"]
