import pytest
from plyforge.functions.rules import NAMES, Position
from plyforge.operators import attacks, bitboards, features
from plyforge.sources.positions import catalogue

FENS = catalogue()[:150]


def of(spark, fens, columns):
    df = spark.createDataFrame(list(enumerate(fens)), "pos_id long, fen string")
    return {r.pos_id: r for r in features.apply(df, columns).collect()}


def test_boards_agree_with_the_rules(spark):
    df = features.decoded(spark.createDataFrame(list(enumerate(FENS)), "pos_id long, fen string"))
    for r in df.collect():
        p = Position(FENS[r.pos_id])
        assert r.b == "".join(p.board) and (r.turn == "w") == p.white


@pytest.mark.parametrize("fen, passed, isolated, doubled", [
    ("4k3/8/8/8/1P6/8/8/4K3 w - - 0 1", ["b4"], ["b4"], []),
    ("4k3/1p6/8/8/1P6/8/8/4K3 w - - 0 1", [], ["b4"], []),
    ("4k3/2p5/8/8/1P6/8/8/4K3 w - - 0 1", [], ["b4"], []),
    ("4k3/8/8/8/1P6/p7/8/4K3 w - - 0 1", ["b4"], ["b4"], []),
    ("4k3/8/8/6P1/7P/8/8/4K3 w - - 0 1", ["h4", "g5"], [], []),
    ("4k3/8/8/2P5/2P5/8/1P6/4K3 w - - 0 1", ["b2", "c4", "c5"], [], ["c"]),
    ("4k3/7p/P7/8/7P/8/8/4K3 w - - 0 1", ["a6"], ["h4", "a6"], []),
])
def test_pawns(spark, fen, passed, isolated, doubled):
    names = lambda f: lambda d: features.names(d, f(d, True))
    r = of(spark, [fen], {"passed": names(features.passed), "isolated": names(features.isolated), "doubled": features.doubled(True)})[0]
    assert (list(r.passed), list(r.isolated), list(r.doubled)) == (passed, isolated, doubled)


def test_phase_material_and_shield(spark):
    got = of(spark, ["4k3/8/8/8/8/6P1/5P1P/6K1 w - - 0 1", "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "r3k3/8/8/8/8/8/8/R3K2R w KQq - 0 1"], {"phase": features.phase, "balance": features.balance, "shield": features.shield(True), "rights": lambda d: features.rights(d, 0, "")})
    assert [got[k].phase for k in range(3)] == ["Endgame", "Opening", "Endgame"]
    assert [got[k].balance for k in range(3)] == [3, 0, 5] and (got[0].shield, got[1].shield) == (2, 3) and got[2].rights == "KQq"


def test_attacks_agree_with_the_rules(spark):
    df = features.decoded(spark.createDataFrame(list(enumerate(FENS)), "pos_id long, fen string"))
    got = {}
    for r in attacks.ray_join(bitboards.bitboards(df)).collect():
        got.setdefault((r.pos_id, r.sq), []).append(r.dest)
    for k, fen in enumerate(FENS):
        p = Position(fen)
        for s in range(64):
            if p.board[s] != ".":
                assert sorted(got.get((k, s), [])) == sorted(p.attacks(s)), (fen, NAMES[s])


def test_start_mobility(spark):
    df = features.decoded(spark.createDataFrame([(0, FENS[0])], "pos_id long, fen string"))
    r = attacks.mobility(bitboards.bitboards(df)).collect()[0]
    assert (r.white, r.black) == (19, 19)


def test_odd_fens(spark):
    got = of(spark, ["8/8/8/8/8/8/8/8 w", "8/8/8/8/8/8/8/8"], {"n": lambda d: d.size(d.where("PNBRQKpnbrqk")), "moves": lambda d: "fullmove", "rights": lambda d: features.rights(d, 0, "")})
    assert all((r.n, r.moves, r.rights) == (0, 1, "") for r in got.values())
