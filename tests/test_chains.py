"""Pools with caps, compared moves, nearest neighbours, answers and judges against plain Python."""

import json
import random
import re

import numpy as np
from plyforge.operators import engine, records
from plyforge.operators import text as t
from pyspark.sql import functions as F


def test_a_key_that_a_full_pool_turns_away_goes_on(spark):
    rng = random.Random(4)
    for cap in (1, 3, 10):
        rows = [(k, *(rng.choice([None, rng.randrange(50)]) for _ in range(3))) for k in range(40)]
        df = spark.createDataFrame(rows, "k int, a int, b int, c int")
        got = {(r.k, r.pool) for r in records.chained(df, "k", ["a", "b", "c"], cap).collect()}
        taken, want = set(), set()
        for i, pool in enumerate("abc", 1):
            line = sorted((r[i], r[0]) for r in rows if r[i] is not None and r[0] not in taken)[:cap]
            taken |= {k for _, k in line}
            want |= {(k, pool) for _, k in line}
        assert got == want
    # Two keys fit the first pool best, which takes one: the other one is the second pool's.
    df = spark.createDataFrame([(1, 1, 5), (2, 2, 6)], "k int, a int, b int")
    assert {(r.k, r.pool) for r in records.chained(df, "k", ["a", "b"], 1).collect()} == {(1, "a"), (2, "b")}


def test_compared_moves(spark):
    line = "pos_id long, multipv int, l_partkey long, l_suppkey long, move string, score_type string, score long, win long"
    lines = [(1, 1, 0, 0, "e4", "cp", 40, None), (1, 2, 0, 0, "d4", "cp", 30, None), (2, 1, 0, 0, "x", "cp", -20, 300), (3, 1, 0, 0, "y", "mate", 2, None), (4, 1, 0, 0, "z", "cp", 100, 600), (5, 1, 0, 0, "w", "cp", 100, None)]
    played = [(1, "d4", 2), (1, "e4", 4), (4, "a3", 3), (3, "y", 5), (5, "q", 99)]
    df = engine.compare_moves(spark.createDataFrame(lines, line), spark.createDataFrame(played, "pos_id long, user_move string, after_id long"))
    got = {(r.pos_id, r.user_move): (r.best_move, r.cp_loss, r.wp_loss, r["class"]) for r in df.collect()}
    sigmoid = lambda cp: 0.5 + 0.5 * (2 / (1 + np.exp(-0.00368208 * cp)) - 1)
    # The answer's -20 is 20 for the mover; of its 300 wins and 350 draws in 1,000 the 350 losses are the mover's wins.
    assert got[1, "d4"] == ("e4", 20, round(sigmoid(40) - 0.35, 4), "Good")
    assert got[1, "e4"] == ("e4", 140, round(sigmoid(40) - 0.2, 4), "Best")
    assert got[4, "a3"] == ("z", 0, 0.6, "Great") and got[3, "y"] == ("y", 0, round(1 - sigmoid(-100), 4), "Best")
    assert len(got) == 4


def test_nearest_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[10], x[30], x[41] = x[9], x[9], 0
    rows = [(int(i), int(i // 25), int(i % 3), v.tolist()) for i, v in enumerate(x)] + [(99, 7, 1, [1.0] * 5), (100, 0, 1, None)]
    got = {r.vec_id: r.o_id for r in records.nearest(spark.createDataFrame(rows, "vec_id long, batch long, label int, embedding array<float>"), "batch").collect()}
    for i in range(60):
        others = [j for j in range(60) if j != i and j // 25 == i // 25]
        with np.errstate(invalid="ignore"):
            cos = {j: np.nan_to_num(round(float(np.float32(x[i]).astype(float) @ np.float32(x[j]).astype(float) / np.linalg.norm(np.float32(x[i]).astype(float)) / np.linalg.norm(np.float32(x[j]).astype(float))), 9), nan=-2.0) for j in others}
        assert got[i] == max(others, key=lambda j: (cos[j], -j)), i
    assert 99 not in got and 100 not in got


def said(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_every_list_is_sorted(spark):
    form = lambda m: "[" + ", ".join(f"'{x}'" for x in sorted(x.strip().strip("'\"") for x in m[1].split(","))) + "]"
    for text in ("['b', \"a\"] and [d,c] [] x", "none", "[z]", "a [b", "[c, 'a'][b]", ""):
        assert said(spark, text, t.bracket_sorted) == re.sub(r"\[([^\]]+)\]", form, text), text


def judged(text):
    """The last block that is JSON and has a correctness."""
    blocks = re.findall(r'\{[^{}]*"correctness"\s*:\s*[\d.]+[^{}]*\}', text) or re.findall(r"\{[^{}]+\}", text)
    for b in reversed(blocks):
        try:
            got = json.loads(b)
        except json.JSONDecodeError:
            continue
        if "correctness" in got:
            out = {}
            for k in t.JUDGE:
                try:
                    out[k] = float(got[k])
                except (KeyError, TypeError, ValueError):
                    out[k] = None
            return out
    return dict.fromkeys(t.JUDGE)


def test_last_block_of_scores(spark):
    texts = ['{"correctness": 1} {"correctness": 2, "clarity": "4", "fluency": null, "relevance": "x"} and {"correctness": 3 4}', '{"clarity": 3, "correctness": "2"} {"other": 1}', "{'correctness': 2}", "none", '{"correctness": 2.5, "fluency": 1} {"clarity": 5}', '{"a": 1} {not json}']
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for r, text in zip(df.select(*(c.alias(k) for k, c in t.judge_scores(F.col("t")).items())).collect(), texts, strict=True):
        assert r.asDict() == judged(text), text


def test_puzzle_reward(spark):
    df = spark.createDataFrame([("E2E4", "e2e4 ", 50), ("e2e4", "d2d4", 50), (None, "e2e4", 50), ("e2e4", "e2e4", 2048)], "m string, g string, n int")
    assert [round(r.x, 6) for r in df.select(t.puzzle_reward(F.col("m"), F.col("g"), F.col("n")).alias("x")).collect()] == [1.0, 0.0, -1.0, 0.8]
