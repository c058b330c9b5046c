import numpy as np
import pyarrow as pa
from plyforge.llm import common
from plyforge.llm.components import components


def test_filter_misses_nothing(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 3000)
    made = common.KeyFilter.of(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 16)
    assert made.hits(keys).all() and 0 < made.hits(keys + 1).mean() < 0.2
    empty = common.KeyFilter.of(spark.createDataFrame([], "k long"), "k", 16)
    assert not empty.hits(keys).any()


def test_slices_hold_all_rows():
    texts = ["", "a" * 10, None, "b" * 100, "c", "é" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for most in (1, 20, 1000):
        assert [t for s in common.slices(batch.slice(1), "text", most) for t in s.column("text").to_pylist()] == texts[1:]
    assert list(common.slices(batch.slice(0, 0), "text")) == []


def test_ngrams_of_short_sequences():
    words = common.WordHashes(2)([b"a", b"b", b"a", b"c"])
    assert words[0] == words[2] and len(common.ngram_hashes(words, 3)) == 2
    assert len(common.ngram_hashes(words[:2], 3)) == 1 and len(common.ngram_hashes(words[:0], 3)) == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (50, 77), (-5, 200), (7, 7)] + [(300, 300 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n for n, r in got.items() if r == 0} == set(range(1, 41))
    assert got[100] == got[77] == 50 and got[200] == -5 and all(got[300 + k] == 300 for k in range(1, 60))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
