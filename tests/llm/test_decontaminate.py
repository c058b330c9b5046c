import random

import numpy as np
from plyforge.llm import common, decontaminate as d


def brute(words, item, shingle=5, least=0.8):
    """Best similarity over all item-sized windows, and its first place."""
    h = common.WordHashes()
    w, m = h(d.words_of(words)), h(d.words_of(item))
    if not len(m) or not len(w):
        return None
    size, best = min(len(m), len(w)), None
    for at in range(len(w) - size + 1):
        s = d.weighted_similarity(common.ngram_hashes(w[at : at + size], shingle), common.ngram_hashes(m, shingle))
        if s >= least and (best is None or s > best[1]):
            best = (at, s)
    return best


def test_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 6, 14, 30, 55])))) for k in range(30)] + [(98, ""), (99, None)]
    docs = []
    for k in range(120):
        text = [word() for _ in range(rng.choice([0, 2, 20, 90]))]
        for _ in range(rng.choice([0, 1, 2])):
            part = rng.choice(items[:30])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], ["zz"], ["zz", part[at]]])
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((k, ", ".join(text).upper()))
    docs += [(None, items[5][1]), (500, None), (500, items[6][1]), (500, items[6][1])]
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = [(i, k, *b) for i, t in docs for k, item in items if (b := brute(t or "", item or ""))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    found = sorted(((r.doc_id, r.item_id, r.first_word, r.similarity) for r in got), key=key)
    # Whatever is found is right; of what is there, the fingerprints keep nearly all, and all that is exact.
    pairs, whole = {r[:2]: r[3] for r in expected}, len(expected)
    assert all(0.8 <= r[3] <= pairs[r[:2]] + 1e-12 for r in found)
    assert len(found) >= 0.99 * whole and [r for r in found if r[3] == 1.0] == sorted((r for r in expected if r[3] == 1.0), key=key)


def test_recall_at_the_threshold():
    rng, h = random.Random(9), common.WordHashes()
    at_threshold = within = 0
    for size in (20, 40, 80):
        for _ in range(400):
            item = [f"u{rng.randrange(5000)}" for _ in range(size)]
            words, index = [f"o{rng.randrange(5000)}" for _ in range(30)], d.Items([(1, " ".join(item))])
            part = list(item)
            for _ in range(rng.choice([0, 1, 1, 2])):
                part[rng.choice([rng.randrange(2), size - 1 - rng.randrange(2), rng.randrange(size)])] = "zz"
            words[9:9] = part
            best = brute(" ".join(words), " ".join(item))
            if best and best[1] < 0.86:
                at_threshold += 1
                within += bool(index.matches(h(d.words_of(" ".join(words)))))
    assert at_threshold > 60 and within >= 0.9 * at_threshold, (within, at_threshold)


def test_index_misses_nothing_within_the_radius():
    rng = random.Random(2)
    index = d.Items([(k, " ".join(f"w{rng.randrange(900)}" for _ in range(12))) for k in range(200)])
    for _ in range(300):
        k = rng.randrange(200)
        mark = index.prints[k]
        for b in rng.sample(range(d.BITS), rng.randrange(d.RADIUS + 1)):
            mark ^= 1 << b
        near = index.near(12, mark)
        assert sorted(near) == [(j, n) for j, p in enumerate(index.prints) if (n := (p ^ mark).bit_count()) <= d.RADIUS] and k in dict(near)
    assert sum(bool(index.near(12, rng.getrandbits(d.BITS))) for _ in range(500)) < 25


def test_rolled_fingerprints():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    starts = sorted({*rng.integers(0, 8900, 300).tolist(), *range(100, 5000)})
    for width in (1, 7, 60):
        assert d.rolled(grams, starts, width) == [d.fingerprint(grams[a : a + width]) for a in starts]


def test_blocks_of_items_and_filter(spark):
    items = [(k, " ".join(f"q{k}x{j}" for j in range(20))) for k in range(12)]
    docs = [(k, f"lead {items[k % 12][1]} tail" if k % 3 == 0 else f"clean text number {k}") for k in range(40)]
    docs.append((77, None))
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.contaminated(frame, bench, most=4).collect()} == {(k, k % 12) for k in range(0, 40, 3)}
    kept = d.without_contaminated(frame, bench, most=4)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {k for k in range(40) if k % 3} | {77}
    assert d.contaminated(frame.limit(0), bench).count() == 0 and d.contaminated(frame, bench.limit(0)).count() == 0
