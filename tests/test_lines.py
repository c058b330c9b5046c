"""Analyses and reviews of a position by hand."""

import os

import pytest
from plyforge.operators import lines
from plyforge.plans import load
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PLIES = "pos_id long, multipv int, l_partkey long, l_suppkey long, l_extendedprice double, move string, score_type string, score long"


def board(spark, rows):
    """Plies whose terms are all small but for the first two, which the keys of the row make large."""
    return spark.createDataFrame(rows, PLIES)


def test_lines_are_in_order_and_know_their_score(spark):
    rows = [(1, 2, 0, 0, 0.0, "d4", "cp", -70), (1, 1, 5, 0, 0.0, "e5", "cp", 9), (1, 1, 2, 0, 0.0, "e4", "cp", 65), (1, 3, 0, 0, 0.0, "a4", "mate", -3), (2, 1, 0, 0, 0.0, "h4", "mate", 2)]
    got = {r.pos_id: r for r in lines.analysed(board(spark, rows)).collect()}
    one = got[1]
    assert [(x.multipv, x.cp, x.label, [p.move for p in x.plies]) for x in one.lines] == [(1, 65, "good for white", ["e4", "e5"]), (2, -70, "good for black", ["d4"]), (3, None, "winning for black", ["a4"])]
    assert (one.root_cp, one.spread) == (65, 135) and (got[2].root_cp, got[2].spread, got[2].lines[0].label) == (None, 0, "winning for white")


def test_review_of_a_played_move(spark):
    # Keys of 0 make vectors of zeros: no term is told.
    rows = [(1, k, 0, 0, float(i), f"{m}{i}", "cp", 100 - 40 * k) for k, m in ((1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f")) for i in range(7)]
    played = [(1, "F", "w", "Opening", "B", "b0"), (1, "F", "b", "Endgame", "B", "b0"), (1, "F", "w", "Opening", "B", "zz"), (1, "F", "w", "Opening", "B", "a0")]
    df = spark.createDataFrame(played, "pos_id long, fen string, turn string, phase string, board string, move string")
    out = lines.reviewed(lines.analysed(board(spark, rows)), df).withColumn("block", lines.thinking()).collect()
    got = {(r.move, r.turn): r for r in out}
    white, black, other, best = got["b0", "w"], got["b0", "b"], got["zz", "w"], got["a0", "w"]
    # A spread of 200: six plies a line, five lines beside the played one.
    assert [p.move for p in white.played] == [f"b{i}" for i in range(6)] and [x.plies[0].move for x in white.beside] == ["a0", "c0", "d0", "e0", "f0"]
    assert (white.cp_loss, white["class"]) == (40, "inaccuracy") and (black.cp_loss, black["class"]) == (0, "best")
    assert (other.cp_loss, other["class"], [p.move for p in other.played]) == (0, "good", ["zz"]) and len(other.beside) == 5 and best["class"] == "best"
    text = white.block.split("\n")
    assert text[:5] == ["POSITION: Opening | white to move | eval: good for white", "CLASSIFICATION: b0 is inaccuracy", "", "LINE analysis:", "  PLAYED: b0 → b1 → b2 → b3 → b4 → b5 | eval: equal"]
    assert text[5] == "    b0: (no notable term changes)" and text[11] == "" and text[12].startswith("  LINE 1: a0 → a1")
    assert text[-2:] == ["VERDICT: b0 is inaccuracy. a0 was better (good for white).", "COACHING FOCUS: explain why a0 is stronger and what concept b0 misses."]
    assert best.block.endswith("VERDICT: a0 best.\nCOACHING FOCUS: reinforce the idea behind a0 — student played well.")
    assert "note zz is solid; briefly mention what a0 achieves differently." in other.block


def test_only_commented_moves_are_samples(spark):
    rows = [(k, 1, 3, 4, 0.0, "a4", "cp", 250) for k in (1, 2)]
    played = spark.createDataFrame([(k, "FEN", "b", "Endgame", "BOARD", "a4") for k in (1, 2)], "pos_id long, fen string, turn string, phase string, board string, move string")
    (r,) = lines.joint_records(lines.reviewed(lines.analysed(board(spark, rows)), played), spark.createDataFrame([(2, "Well done.")], "pos_id long, comment string")).collect()
    assert [m.role for m in r.messages] == ["system", "user", "assistant"] and r.messages[2].content.endswith("</think>\n\nWell done.")
    assert "PLAYED LINE: a4 [" in r.messages[1].content and "Engine assessment: winning for white" in r.messages[1].content
    assert (r.metadata.source, r.metadata.n_lines, r.metadata.spread_cp) == ("textbook_joint_sft", 1, 0)
    terms = spark.range(1).select(lines.told_terms(F.array(*map(F.lit, [0.05, -0.3, 0.2, 0.2, 0.1, *[0.0] * 8]))).alias("t")).first().t
    assert [(t.name, t.v) for t in terms] == [("Imbalance", -0.3), ("Pawns", 0.2), ("Knights", 0.2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize(("name", "phrases"), [("e12_line_analysis", 0), ("e21_context_hints", 0), ("e15_thinking_block", 2)])
def test_plies_are_grouped_with_what_is_asked_for_only(spark, name, phrases):
    plan = load.all_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate" in line and "collect_list" in line]
    assert grouped and not any("shown" in line for line in grouped) and all(any(c in line for line in grouped) == bool(phrases) for c in ("told", "net,"))


def test_plies_are_dealt_to_parts_by_the_size_of_the_input(spark):
    rows = board(spark, [(k, 1, 0, 0, 0.0, "a4", "cp", k) for k in range(9)]).repartition(3)
    for only in ((), lines.SAID):
        assert lines.analysed(rows, only).rdd.getNumPartitions() == 3 * lines.PARTS
