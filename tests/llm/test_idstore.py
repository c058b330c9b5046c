import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plyforge.llm import common, idstore
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b c", " a b", "a b ", "a\nb c\n", "é ü x y", "1 2 's 't", "\t a", "", " ", "x  y z", "a  b", "don't we'll 12 34", "a \x1c b", "a\x1c b c", "日本 語 x", "q" * 3000, "w " * 4000]
OWN, MODEL = idstore.Stretches(PATH), Tokenizer.from_file(PATH)


def coded(own, texts):
    ids, ends = own(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, ends)[: len(texts)]]


def test_stretches_as_whole_texts():
    model = Tokenizer.from_file(PATH)
    own = idstore.Stretches(PATH)
    expected = [model.encode(t, add_special_tokens=False).ids for t in ODD]
    for _ in range(2):
        assert coded(own, ODD) == expected
    assert coded(own, ODD[::-1]) == expected[::-1]
    assert coded(own, []) == [] and coded(own, ["", ""]) == [[], []]


@given(st.lists(st.text(st.sampled_from(" a\u00e9\n\u00a0\u3000\u2003\t'1.\u65e5\x1c\x85s<|>"), max_size=40), max_size=6))
@settings(max_examples=400, deadline=None)
def test_stretches_of_any_texts(texts):
    assert coded(OWN, texts) == [MODEL.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgotten_stretches(monkeypatch):
    monkeypatch.setattr(idstore, "KNOWN", 50)
    own = idstore.Stretches(PATH)
    for at in range(0, 400, 20):
        texts = [f"word{at + i % 20} and w{i * 7919 % 1000} <b>{i}</b>" for i in range(40)]
        assert coded(own, texts) == [MODEL.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.known) == len(own.uses) == len(own.at) - 1


def test_added_tokens_as_the_library_has_them(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b\n", "a <|endoftext| > b", "<|ENDOFTEXT|> x", "é <|endoftext|>\n é"]
    model = Tokenizer.from_file(PATH)
    expected = [model.encode(t, add_special_tokens=False).ids for t in texts]
    own = idstore.Stretches(PATH)
    assert expected[0] == [64, 220, 50256, 275]
    assert coded(own, texts) == expected
    path = common.new_path(spark, "t")
    idstore.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, PATH)
    at = 0
    for r, ids in zip(sorted(idstore.verified(spark, path).collect()), expected, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        at += len(ids) + 1


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 20_000).astype(np.uint16)
    shifted = np.concatenate([rng.integers(0, 50_000, 777).astype(np.uint16), ids])
    (a,), (b,) = idstore.cuts(ids, np.array([len(ids)])), idstore.cuts(shifted, np.array([len(shifted)]))
    assert a[-1] == len(ids) and all(1 <= y - x <= idstore.MOST for x, y in zip([0, *a], a))
    assert len(set(a) & {x - 777 for x in b}) > 0.8 * len(a)
    assert idstore.cuts(np.zeros(5, np.uint16), np.array([5])) == [[5]]


def test_crc_of_parts():
    data = [b"ab", b"", b"c" * 4000, b"xyz"]
    after = np.array([sum(map(len, data[i + 1 :])) for i in range(len(data))])
    shares = idstore.crc_before(np.array([zlib.crc32(d) for d in data], np.uint32), after)
    assert int(np.bitwise_xor.reduce(shares)) == zlib.crc32(b"".join(data))


def test_store(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(40, "same passage " * 400), (41, "other " + "same passage " * 400), (None, None), (60, "again"), (60, "again")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start long").repartition(3)
    path = common.new_path(spark, "t")
    idstore.write(docs, path, PATH)
    model = Tokenizer.from_file(PATH)
    at, expected = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in idstore.verified(spark, path).collect()), key=key) == sorted(expected, key=key)
    whole = idstore.reconstructed(spark, path).collect()
    assert all(zlib.crc32(np.frombuffer(r.ids_le, "<u2").astype("<u4").tobytes()) in {e[3] for e in expected} for r in whole) and len(whole) == len(rows)
    addresses = [r.address for r in idstore.chunks(spark, path).collect()]
    assert len(addresses) == len(set(addresses))
    empty = common.new_path(spark, "t")
    idstore.write(docs.limit(0), empty, PATH)
    assert idstore.verified(spark, empty).count() == 0


def test_damage_is_seen():
    batch = pa.RecordBatch.from_arrays([pa.array([idstore.address(b"ab")]), pa.array([b"ax"])], names=["address", "payload"])
    with pytest.raises(ValueError):
        list(idstore._facts(2)([batch]))


def test_tree_of_leaves_that_come_one_by_one():
    for n in range(70):
        leaves = [idstore.address(bytes([i])) for i in range(n)]
        tree = idstore.Tree()
        for leaf in leaves:
            tree.add(leaf)
        assert tree.root() == idstore.merkle(leaves)


@pytest.fixture(scope="module")
def whole(spark):
    path = common.new_path(spark, "t")
    rows = [(k, f"document {k} " + "shared passage of words " * 300 + f"end {k * 7919} " * (k % 7 * 60)) for k in range(60)]
    idstore.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, PATH)
    return path


def test_manifest(spark, whole):
    parts = idstore.manifest(spark, whole).orderBy("part").collect()
    rows = idstore.recipes(spark, whole).orderBy("doc_id").collect()
    assert {p.width for p in parts} == {2} == {idstore.width_of(spark, whole)} and sum(p.docs for p in parts) == 60
    at = 0
    for p in parts:
        mine = [r for r in rows if r.part == p.part]
        assert (p.before, p.ids, p.first_doc, p.last_doc) == (at, sum(r.n_tokens for r in mine), mine[0].doc_id, mine[-1].doc_id)
        assert p.root == idstore.merkle([idstore._leaf(r.root, r.n_tokens, r.start - at) for r in mine])
        at += p.ids


def damaged(spark, whole, table, change):
    """A copy of the store in which ``change`` is made to a table's rows."""
    path = common.new_path(spark, "t")
    for name in ("manifest", "recipes", "store"):
        df = spark.read.parquet(f"{whole}/{name}")
        df = change(df) if name == table else df
        (df.write.partitionBy("kind") if name == "store" else df.write).parquet(f"{path}/{name}")
    return path


def test_damage_anywhere_is_seen(spark, whole):
    from pyspark.sql import functions as F

    assert idstore.verified(spark, damaged(spark, whole, "", None)).count() == 60
    one = F.col("doc_id") == 42
    swapped = F.when(one, F.concat(F.expr("substring(recipe, 17, 16)"), F.expr("substring(recipe, 1, 16)"), F.expr("substring(recipe, 33)"))).otherwise(F.col("recipe"))
    changes = {
        "chunk order of a recipe": ("recipes", lambda d: d.withColumn("recipe", swapped)),
        "root of a recipe": ("recipes", lambda d: d.withColumn("root", F.when(one, F.expr("unhex(md5('x'))")).otherwise(F.col("root")))),
        "place of a document": ("recipes", lambda d: d.withColumn("start", F.col("start") + one.cast("long"))),
        "a document less": ("recipes", lambda d: d.where(~one)),
        "a document twice": ("recipes", lambda d: d.unionByName(d.where(one))),
        "root of a part": ("manifest", lambda d: d.withColumn("root", F.expr("unhex(md5('x'))"))),
        "a part less": ("manifest", lambda d: d.where(F.col("part") != d.agg(F.max("part")).first()[0])),
        "payload of a chunk": ("store", lambda d: d.withColumn("payload", F.when(F.col("payload").isNotNull(), F.expr("overlay(payload PLACING X'00FF' FROM 1)")))),
        "chunks missing": ("store", lambda d: d.where("kind = 'recipe' OR address > X'80'")),
    }
    for name, (table, change) in changes.items():
        path = damaged(spark, whole, table, change)
        for read in (idstore.verified, idstore.reconstructed):
            with pytest.raises(Exception, match="Merkle|does not match|missing|not as long"):
                read(spark, path).collect()
                pytest.fail(name)


def test_wide_vocabulary_and_other_pre_tokenizers(spark, tmp_path):
    from tokenizers import models, normalizers, pre_tokenizers

    model = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    model.pre_tokenizer, model.normalizer = pre_tokenizers.Whitespace(), normalizers.Lowercase()
    file = str(tmp_path / "wide.json")
    model.save(file)
    texts = [f"W{69_000 + k}  w{k} nothing" for k in range(200)] + ["", None, "w65536 " * 3000]
    path = common.new_path(spark, "t")
    idstore.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, file)
    assert idstore.width_of(spark, path) == 4
    expected = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in idstore.verified(spark, path).collect()} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in expected.items()}
    assert all(np.array_equal(np.frombuffer(r.ids_le, "<u4"), expected[r.doc_id]) for r in idstore.reconstructed(spark, path).collect())
    assert not idstore.Stretches(public_tokenizers.path("word_bpe_49k.json")).cuttable and OWN.cuttable


def test_empty_store(spark):
    path = common.new_path(spark, "t")
    idstore.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert idstore.verified(spark, path).count() == 0 == idstore.reconstructed(spark, path).count()
