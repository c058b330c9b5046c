"""Removed words against a plain search of all windows, parts of the method by themselves, and odd input."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from plyforge.llm import substring_dedup as sd


def by_hand(docs, size):
    """docs: (doc_id, text) in the order of rows; per row (words, kept words)."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k))
    split = [(t or "").encode().split() for _, t in docs]
    seen, gone = set(), [set() for _ in docs]
    for k in order:
        for s in range(len(split[k]) - size + 1):
            w = tuple(split[k][s : s + size])
            if w in seen:
                gone[k] |= set(range(s, s + size))
            seen.add(w)
    return [(len(ws), [w for i, w in enumerate(ws) if i not in g]) for ws, g in zip(split, gone, strict=True)]


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(parts) if parts else spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)


def check(spark, docs, parts=3, **how):
    size = how.get("size", sd.SIZE)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.digests(frame(spark, docs, parts), **how).collect()}
    want = {i: (n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for (i, _), (n, k) in zip(docs, by_hand(docs, size), strict=True)}
    assert got == want
    return sum(w[1] for w in want.values())


def corpus(rng, n, vocabulary, longest):
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [rng.choices(words, k=rng.randint(5, 60)) for _ in range(8)]
    docs = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            text += rng.choices(words, k=rng.randint(0, longest)) + p[rng.randint(0, len(p) // 2) : rng.randint(len(p) // 2, len(p))]
        docs.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(text) if rng.random() < 0.95 else rng.choice(docs or [(0, "")])[1]))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "vocabulary", "hot"), [(1, 400, 1000), (2, 3, 1000), (3, 400, 3), (4, 3, 2)])
def test_against_plain_search(spark, seed, vocabulary, hot):
    """Texts of few different words have repeats inside a document, windows that overlap themselves, and ties of anchors."""
    docs = corpus(random.Random(seed), 60, vocabulary, 40)
    assert check(spark, docs, hot=hot, shard_bytes=2000) > 100


def test_other_sizes(spark):
    assert check(spark, corpus(random.Random(5), 40, 50, 20), size=6, anchor=3) > 100
    assert check(spark, corpus(random.Random(6), 40, 3, 20), size=5, anchor=5) > 100


def test_periodic_text(spark):
    docs = [(1, "a " * 100), (2, "a b " * 60), (3, "b a " * 60 + "c"), (4, "a " * 19), (5, "a " * 20), (6, "x " * 20 + "y " * 20)]
    check(spark, docs)
    check(spark, docs, hot=2)


def test_passages_of_twenty_words_and_not_of_nineteen(spark):
    rng = random.Random(9)
    own = lambda k: [f"u{rng.random()}" for _ in range(k)]
    short, long_ = own(19), own(20)
    docs = [(i, " ".join(own(30) + short + own(30) + long_ + own(30))) for i in range(10)]
    assert check(spark, docs) == 9 * 20


def test_odd_input(spark):
    twenty = " ".join(f"t{i}" for i in range(20))
    same = [(7, twenty), (7, twenty), (None, twenty), (None, twenty), (8, "\x00 \x1c" + twenty), (9, None), (10, ""), (11, " \n")]
    rows = spark.createDataFrame(same, "doc_id long, text string").coalesce(1).selectExpr("*", "1 AS key", "2 AS gone", "3 AS _gone", "4 AS _ROW", "5 AS row", "6 AS seg")
    got = sd.without_repeats(rows)
    assert got.columns == rows.columns
    left = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in got.collect()), key=repr)
    # One row without id is the first; the others lose the passage.
    assert sorted(t for i, t in left if i == -1) == ["", twenty] and [t for i, t in left if i == 7] == ["", ""]
    assert [t for i, t in left if i == 8] == ["\x00 \x1ct0 " + twenty[3:]] and [t for i, t in left if i in (9, 10, 11)] == ["", " \n", None]
    assert sd.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sd.digests(frame(spark, [(1, "one two"), (2, "one two")])).agg({"n_removed": "sum"}).first()[0] == 0


def test_one_very_long_text(spark):
    rng = random.Random(4)
    words = [f"v{rng.randrange(10**6)}" for _ in range(300_000)]
    words[200_000:200_500] = words[1000:1500]
    assert check(spark, [(1, " ".join(words)), (2, " ".join(words[5000:5100]))]) == 500 + 100


def test_untouched_texts_keep_their_blanks(spark):
    twenty = " ".join(f"t{i}" for i in range(20))
    got = {r.doc_id: r.text for r in sd.without_repeats(frame(spark, [(1, "a  b\n" + twenty), (2, f"x\n{twenty}  y")])).collect()}
    assert got == {1: "a  b\n" + twenty, 2: "x y"}


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(30)]
    s = sd.Slice(pa.array(texts), 8, 3)
    words, place, windows = s.words.to_pylist(), {}, 0
    for at, low, high in zip(s.at.tolist(), s.low.tolist(), s.high.tolist(), strict=True):
        for w in range(low, high + 1):
            assert place.setdefault(tuple(words[w : w + 8]), at - w) == at - w and 0 <= at - w <= 5
            windows += 1
    assert windows == sum(max(0, c - 7) for c in s.counts.tolist())


def test_words_split_at_the_six_blanks_only():
    texts = ["", None, " ", "a", " a b\x0b\x0cc\td\r\ne ", "\x1c\x85\u2003x y", "é\u00a0ü  z", "\n\n"]
    words, counts = sd.split_words(pa.array(texts))
    assert (words.to_pylist(), counts.tolist()) == ([w.decode() for t in texts for w in (t or "").encode().split()], [len((t or "").encode().split()) for t in texts])


@pytest.mark.parametrize("most", [0, 1, 63, 64, 5000, 300_000, 20_000_000, 2_000_000_000])
def test_letters_tell_numbers_apart(most):
    ids = np.unique(np.concatenate([np.arange(min(most + 1, 3000)), np.linspace(0, most, 500).astype(np.int64)]))
    text, digits = sd.letters(ids)
    parts = [text[i : i + digits] for i in range(0, len(text), digits)]
    assert len(set(parts)) == len(ids) == len(parts)
    # No letter of a first place stands elsewhere, so nothing matches in the middle of a number.
    assert digits == 1 or not {p[0] for p in parts} & {c for p in parts for c in p[1:]}


def test_recurring_counts_sequences_and_not_hashes(monkeypatch):
    ids = np.array([1, 2, 3, 4, 1, 2, 3, 9, 9])
    starts = np.arange(7)
    want = [tuple(ids[s : s + 3]) for s in sd.recurring(ids, starts, np.ones(7, int), 3)]
    assert want == [(1, 2, 3)]
    monkeypatch.setattr(sd, "runs_of", lambda words, n: np.zeros(len(words) - n + 1, np.uint64))  # all hashes collide
    assert [tuple(ids[s : s + 3]) for s in sd.recurring(ids, starts, np.ones(7, int), 3)] == want


def test_shards_keep_keys_whole():
    """Batches cut keys anywhere; the answers are those of one shard."""
    rng = random.Random(8)
    rows = []
    for key in range(40):
        passage = [f"k{key}x{i}" for i in range(6)]
        rows += [(key, b" ".join(w.encode() for w in passage[rng.randint(0, 1) :])) for _ in range(rng.randint(1, 9))]
    n = len(rows)
    table = pa.table({"seg": pa.array(range(n), pa.int64()), "key": pa.array([k for k, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.binary()), "n": pa.array([1] * n, pa.int64()), "first_doc": pa.array(range(n), pa.int64()), "first_row": pa.array(range(n), pa.int64()), "first_start": pa.array([0] * n, pa.int32())})
    whole = pa.Table.from_batches([sd.answers(table, 5)]).sort_by("seg")
    for most in (1, 100, 1000, 10**6):
        for width in (1, 3, 1000):
            parts = list(sd._answered(5, most)(iter(table.to_batches(width))))
            assert pa.Table.from_batches(parts).sort_by("seg").equals(whole)
