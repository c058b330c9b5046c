import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from plyforge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
OURS = bpe.Bpe(PATH, public_tokenizers.PATTERN)
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OURS.ranks, special_tokens={})
ODD = ["", "a", "\x00x\x00", "é" * 3000, "a" * 5000, "ab" * 3000 + " " * 700 + "!", "日本語" * 50, "'s't ll", " \n\n  x", "😀😀", "x" * 255 + "y", "<|endoftext|>", "word " * 3000]


def test_as_tiktoken_and_back():
    coded = OURS.encode(ODD)
    assert [c.tolist() for c in coded] == [OWN.encode_ordinary(t) for t in ODD]
    assert OURS.decode(coded) == [t.encode() for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_any_text(texts):
    coded = OURS.encode(texts)
    assert [c.tolist() for c in coded] == [OWN.encode_ordinary(t) for t in texts]
    assert OURS.decode(coded) == [t.encode() for t in texts]


@pytest.mark.parametrize("text", ["thequickbrown" * 40, "!?" * 300, "7" * 600])
def test_heap_agrees_with_sql(text):
    short = text[:200]
    OURS.known.clear()
    OURS.learn({short})
    by_sql = OURS.known[short]
    assert OURS._heap_piece(short).astype(OURS.type).tobytes() == by_sql


def test_query_columns(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens long")
    got = bpe.digests(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    expected = sorted((i is None, i or 0, t or "") for i, t in rows)
    made = sorted((r.doc_id is None, r.doc_id or 0, OWN.decode(list(r.ids))) for r in got)
    assert made == expected
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(OWN.decode_bytes(list(r.ids))).hexdigest()
    assert bpe.encoded(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
