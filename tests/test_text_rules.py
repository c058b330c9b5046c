from plyforge.operators import text as t
from plyforge.operators.engine import move_class, win_probability
from plyforge.streaming.logs import split_chunks
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def said(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).collect()[0].x


def test_move_json(spark):
    for text, move in (('{"move": "e2e4"}', "e2e4"), ('{"move": "a2a3"} {"move": "e2e4"}  ', "e2e4"), ('{"move": "e2e4"} and more', None), ('<think>{"move": "e2e4"}</think> nothing', None), ('x</think>{"move": "e7e8q"}\n', "e7e8q")):
        assert said(spark, text, t.move_json) == move, text


def test_length_penalty(spark):
    assert [round(value(spark, t.length_penalty(F.lit(n))), 6) for n in (0, 100, 2048, 20480)] == [0.0, 0.0, -0.2, -0.2]


def test_classes_and_probabilities(spark):
    for losses, name in (((0, 5, 10), "Best"), ((15, 30), "Great"), ((50, 80), "Good"), ((100, 150), "Inaccuracy"), ((200, 300), "Mistake"), ((400, 1000), "Blunder")):
        for loss in losses:
            assert value(spark, move_class(F.lit(loss), "verifier")) == name
    rows = spark.createDataFrame([("cp", 0, None), ("cp", 300, None), ("mate", 2, None), ("cp", 0, 650)], "score_type string, score long, win long").select(win_probability().alias("p")).collect()
    assert [round(r.p, 2) for r in rows] == [0.5, 0.75, 1.0, 0.65]
    assert said(spark, "This is a blunder", t.text_class) == "Blunder" and said(spark, "an excellent, strong move", t.text_class) == "Great" and said(spark, "neutral", t.text_class) == "Unknown"


def test_answers(spark):
    assert said(spark, "FINAL ANSWER: **Nf3**\nbye", t.final_answer) == "Nf3"
    assert said(spark, "FINAL ANSWER: b5, a5", lambda c: t.match_exact(c, F.lit("a5, b5"), F.lit("multi"))) is True
    assert said(spark, "FINAL ANSWER: ['e3', 'a5']", lambda c: t.match_exact(c, F.lit("['a5', 'e3']"), F.lit("single"))) is True


def test_missing_judge_scores_do_not_count(spark):
    assert said(spark, '{"correctness": 3}', t.judge_combined) == 1.0 and said(spark, "nothing", t.judge_combined) == 0.0


def test_split_chunks_at_any_cut():
    text = "a<think>b<c</think>d<think>e</think>"
    for cut in range(len(text)):
        out, state = [], (False, "")
        for chunk in (text[:cut], text[cut:]):
            more, *state = split_chunks([chunk], *state)
            out += more
        assert "".join(x for k, x in out if k == "token") == "ad" and "".join(x for k, x in out if k == "think") == "b<ce"


def test_words_end_at_letters_beyond_ascii(spark):
    """As in the SQL's patterns, which know ASCII words only."""
    for text, name in (("zusch schöbest heitung", "Best"), ("bestä", "Best"), ("ein best", "Best"), ("xbest, best1 _best", "Unknown"), ("a fİne reply", "Good"), ("éstrong", "Great")):
        assert said(spark, text, t.text_class) == name, text


def test_agreement_where_words_end_at_letters_beyond_ascii(spark):
    engine = lambda name: lambda c: t.compatible(t.text_class(c), F.lit(name))
    assert said(spark, "schöbest heitung", engine("Great")) and not said(spark, "schöbest heitung", engine("Mistake"))


def test_an_attempt_is_valid_by_words_that_end_at_letters_beyond_ascii(spark, tmp_path):
    from plyforge.operators.readers import first_valid_attempt

    # Of this conversation, turns 0 and 22 are the text alone, and the engine's class is Inaccuracy.
    c = next(c for c in range(2000) if c * 7 % 22 == 21 and c % 6 == 3)
    spark.createDataFrame([(c, 0, "assistant", "schöbest"), (c, 22, "assistant", "inaccuracy")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = first_valid_attempt(spark, str(tmp_path)).first()
    assert (got.conv_id, got.accepted, got.attempts) == (c, 22, 2)
