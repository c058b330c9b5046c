import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from plyforge.llm import bpe, common, minhash
from tests.llm.test_minhash import brute


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = [(k, " ".join(word() for _ in range(80))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(10)]
    for k in range(10, 20):
        words = rows[k][1].split()
        words[40] = "changed"
        rows.append((200 + k, " ".join(words)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(5)]
    rows += [(300 + k, f"{word()} {items[k][1]} {word()}") for k in range(5)]
    rows += [(400 + k, f"you {bad} of a {word()} {bad} {word()} {word()}") for k, bad in enumerate(["idiot", "moron", "scum", "stupid", "trash", "loser"] * 5)]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i >= 400)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = common.documents(spark, str(tmp_path))
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.saved(stage(spark, now, str(tmp_path)), "t")
        assert now.columns == docs.columns
        left.append({r.doc_id for r in now.collect()})
    clean = {i for i, _ in rows if i < 400}
    assert left[0] == clean
    assert left[1] == clean - set(range(10))
    texts = dict(rows)
    near = brute([(i, texts[i]) for i in sorted(left[1])], 5, 80)
    assert left[2] == {i for i in left[1] if near[i][1] == i} == left[1] - set(range(210, 220))
    assert left[3] == left[2] - set(range(300, 305))
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: own.encode_ordinary(texts[i]) for i in left[3]}
