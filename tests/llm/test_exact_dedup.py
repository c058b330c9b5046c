import random

import numpy as np
from plyforge.llm import exact_dedup as e


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        values = np.unique(rng.integers(0, 1 << 42, n))
        for shift in (1, 20, e.best_shift(len(values), 1 << 42)):
            if (values[-1] >> shift) < 10_000_000:
                assert (e.ungolomb(*e.golomb(values, shift), len(values), shift) == values).all()


def test_owners_cover_all_fingerprints():
    for owners in (1, 64, 1000):
        fps = np.array([0, 1, (1 << 48) - 1, *(e.low_of(k, owners) for k in range(owners)), *(max(0, e.low_of(k, owners) - 1) for k in range(owners))], np.uint64)
        own = e.owner_of(fps, owners)
        assert own.min() >= 0 and own.max() < owners
        assert all(e.low_of(int(o), owners) <= int(f) for f, o in zip(fps, own, strict=True))


def test_decisions(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["same", f"own {k}", f"pair {k // 2}", ""])) for k in range(3000)] + [(5000, None), (None, "same"), (None, "null id"), (9999, "twice"), (9999, "twice"), (1, "long " * 50_000), (2, "long " * 50_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, sha string").repartition(5)
    got = e.decisions(docs, block_rows=100, owners=7).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    expected = sorted((i or -1, max((x for x in ids if x is not None), default=None) or -1, len(ids)) for ids in groups.values() for i in ids)
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got) == expected
    assert e.decisions(docs.limit(0)).count() == 0


def test_drop_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", "q"), (2, "a", "r"), (3, "b", "s"), (None, "c", "t"), (7, None, "u"), (8, "", "v")], "doc_id long, text string, _gone string")
    kept = e.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 8]


def test_repeated_rows_and_owners(spark):
    docs = spark.createDataFrame([(1, "same", "a"), (1, "same", "b"), (2, "x", "c"), (2, "y", "d"), (3, "x", "e"), (None, "n", "f"), (None, "n", "g"), (5, None, "h"), (5, "", "i")], "doc_id long, text string, _sha string")
    kept = e.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "n"), (1, "same"), (2, "y"), (3, "x"), (5, "")]
    assert e.owners_for(10) == e.LEAST_OWNERS and e.owners_for(5 * 10**10) == e.BLOCK_ROWS // e.LIST_ROWS
