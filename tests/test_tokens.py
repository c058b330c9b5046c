"""Windows, labels and padding of token ids against plain loops."""

import random

from plyforge.operators import tokens as tk
from pyspark.sql import functions as F


def windows_by_hand(tokens, fens, size, overlap, per):
    if not tokens:
        return []
    if len(tokens) <= size:
        return [(0, tokens, fens)]
    out, at = [], 0
    while at < len(tokens):
        part = tokens[at : at + size]
        skip = tokens[:at].count("B") // per
        out.append((at, part, fens[skip : skip + part.count("B") // per]))
        if at + size > len(tokens):
            break
        at += size - overlap
    return out


def test_windows(spark):
    rng = random.Random(1)
    for size, overlap, per in ((8, 2, 3), (5, 0, 1), (6, 5, 2), (10, 3, 4)):
        rows = []
        for i in range(60):
            tokens = []
            for _ in range(rng.randrange(0, 9)):
                tokens += rng.choice([["B"] * per, ["x"], ["y", "z"]])
            rows.append((i, tokens, [f"f{k}" for k in range(tokens.count("B") // per)]))
        df = spark.createDataFrame(rows, "i int, tokens array<string>, fens array<string>")
        made = df.select("i", tk.windows(F.col("tokens"), tk.places(F.col("tokens"), lambda x: x == "B"), F.col("fens"), size, overlap, per).alias("w")).collect()
        for r in made:
            assert [(w.start, w.tokens, w.fens) for w in r.w] == windows_by_hand(rows[r.i][1], rows[r.i][2], size, overlap, per), (size, overlap, rows[r.i])


def labels_by_hand(ids, template, end):
    out, i = [-100] * len(ids), 0
    while i <= len(ids) - len(template):
        if ids[i : i + len(template)] == template:
            j = i + len(template)
            while j < len(ids) and ids[j] != end:
                j += 1
            j = min(j + 1, len(ids))
            out[i + len(template) : j] = ids[i + len(template) : j]
            i = j
        else:
            i += 1
    return out


def test_labels(spark):
    rng = random.Random(2)
    for template in ([1, 2, 3], [1], [1, 1, 2]):
        rows = [(i, [rng.choice([1, 2, 3, 9, 7]) for _ in range(rng.randrange(0, 40))]) for i in range(150)]
        rows += [(150, template), (151, template * 3), (152, [*template, 9, *template, 5]), (153, [])]
        df = spark.createDataFrame(rows, "i int, ids array<int>")
        t = F.array(*map(F.lit, template))
        made = df.select("i", "ids", tk.reply_spans(F.col("ids"), t, 9).alias("s")).select("i", tk.reply_labels(F.col("ids"), F.col("s")).alias("labels")).collect()
        for r in made:
            assert r.labels == labels_by_hand(rows[r.i][1], template, 9), rows[r.i]


def test_pieces_make_up_the_text(spark):
    texts = ["<|im_start|>user\nHi, you!<|im_end|>", "", "é😀 <|x", "a  b\r\n\x0b", "<|vision_pad|><|vision_pad|>12ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tk.pieces(F.col("t")).alias("p"), tk.ids_of(F.col("t")).alias("ids"))
    for r in df.collect():
        assert "".join(r.p) == r.t and len(r.p) == len(r.ids)
        assert [i for i in r.ids if i >= tk.VOCABULARY] == [tk.SPECIAL[p] for p in r.p if p in tk.SPECIAL]


def test_padding(spark):
    rows = [(0, "a", [1, 2, 3], [7, 7, 7]), (1, "a", [], []), (2, None, [4], [8]), (3, None, [5, 6], [9, 9]), (4, "b", [], [])]
    df = spark.createDataFrame(rows, "i int, batch string, ids array<int>, labels array<int>")
    got = {r.i: (r.ids, r.mask, r.labels) for r in tk.padded(df, "batch", pad=0, labels=-100).collect()}
    assert got == {0: ([1, 2, 3], [1, 1, 1], [7, 7, 7]), 1: ([0, 0, 0], [0, 0, 0], [-100] * 3), 2: ([4, 0], [1, 0], [8, -100]), 3: ([5, 6], [1, 1], [9, 9]), 4: ([], [], [])}
