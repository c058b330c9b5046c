"""Boards are made once a row, not once a square."""

import os

import pytest
from plyforge.plans import load

SF = "/root/testdata/sf0.001"
QUERIES = [
    "p04_prompt_board",
    "p06_representations",
    "p02_piece_labels",
    "k07_html_output",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_no_lambda_makes_the_board(spark, name):
    plan = load.all_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    over_squares = [line for line in plan.splitlines() if "lambdafunction" in line]
    assert over_squares and not any("replace(replace(" in line for line in over_squares)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", [*QUERIES, "p29_board_html"])
def test_boards_are_dealt_and_told_by_one_lambda(spark, name):
    plan = load.all_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("lambdafunction(") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_an_inventory_looks_at_ranks_and_is_dealt(spark):
    plan = load.all_queries()["q30_board_inventory"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "locate(" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_xrays_are_compiled_and_dealt(spark):
    """The virtual machine compiles no method of more than 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = load.all_queries()["p20_xray"](spark, SF)._jdf.queryExecution()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(query.executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "RepartitionByExpression" in query.optimizedPlan().toString()
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


@pytest.mark.parametrize(
    "fen, seen",
    [
        ("k6q/8/7p/8/8/8/8/K6R w - - 0 1", [("h1", "p", "q")]),  # ends on h8, upwards
        ("k6r/8/8/7P/8/8/8/K6Q w - - 0 1", [("h8", "P", "Q")]),  # downwards, from h8
        ("7k/8/5p2/8/8/8/1B6/K7 w - - 0 1", [("b2", "p", "k")]),
        ("k7/8/1b6/8/3N4/8/5Q2/6K1 w - - 0 1", [("b6", "N", "Q")]),  # the queen sees its own knight
        ("k7/8/8/8/8/8/8/RK1rp2q w - - 0 1", []),  # a king before a rook, own pieces
    ],
)
def test_xrays_by_hand(spark, fen, seen):
    from plyforge.operators.attacks import xray
    from plyforge.operators.bitboards import bitboards
    from plyforge.operators.features import decoded

    rows = xray(bitboards(decoded(spark.createDataFrame([(1, fen)], "pos_id long, fen string")))).collect()
    assert [tuple(r)[1:] for r in rows] == seen
