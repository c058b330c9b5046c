"""What is remembered of replayed moves, and which picks stand for all with the same answer."""

import pyarrow as pa
import pytest
from plyforge.functions import rules
from plyforge.functions.rules import Position, play
from plyforge.operators import moves, readers  # noqa: F401 (registers its queries)
from plyforge.sources import positions

#: Queries whose answers depend on a part of pick only.
NARROWED = [
    "m06_play_moves",
    "m08_puzzle_questions",
    "m12_line_legality",
    "m13_line_boards",
    "m14_opening_prefix",
    "m22_session_moves",
    "r05_reward_legality",
    "m21_legal_tool",
    "m20_tactics_text",
    "f06_mate_in_one_verified",
    "x15_joint_prompt",
    "q24_threaten_piece_with",
    "f09_solution_legal",
    "m15_first_legal_move",
    "m16_threat_kind",
    "m01_validate_move",
    "m04_valid_moves",
    "m02_parse_flexible",
    "p08_training_context",
]


def test_a_state_is_searched_once(monkeypatch):
    searched = []
    inner = Position._pseudo
    monkeypatch.setattr(Position, "_pseudo", lambda p: searched.append(p) or inner(p))
    line = "e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6 O-O Be7".split()
    first = play(Position(), line)
    assert searched and first[0] == line
    searched.clear()
    again = play(Position(rules.START.replace("0 1", "7 9")), line)
    assert again[0] == line and not searched and again[1].full == first[1].full + 8
    # The same board with another side, other rights or another en passant square is another state.
    for fen in ("4k3/8/8/3pP3/8/8/8/R3K2R w KQ d6 0 2", "4k3/8/8/3pP3/8/8/8/R3K2R w KQ - 0 2", "4k3/8/8/3pP3/8/8/8/R3K2R w K d6 0 2", "4k3/8/8/3pP3/8/8/8/R3K2R b KQ - 0 2"):
        p = Position(fen)
        assert p.sans() == sorted(p._san(m) for m in p.legal()) and p.legal() == sorted((m for m in p._pseudo() if not p.push(m).in_check(p.white)), key=rules.uci)


@pytest.mark.parametrize("name", NARROWED)
def test_a_narrowed_pick_has_the_same_answer(name):
    fn, cycle, choice = moves.ASKED[name]
    of_line = "sans" in fn.__code__.co_varnames[: fn.__code__.co_argcount]
    lines = list(zip(*positions._lines(), strict=True))[5::700] if of_line else [(fen,) for fen in positions.catalogue()[::400]]
    for fen, *rest in lines:
        stands = (lambda pick: pick % cycle) if cycle else (lambda pick: moves.by_choice(choice, fen, pick)[1])
        picks = range(0, 1009, 5 if of_line else 2)
        for pick in picks:
            assert fn(fen, pick, *rest) == fn(fen, stands(pick), *rest)
        assert len(set(map(stands, picks))) <= (cycle or choice * max(1, len(Position(fen).legal())))


def test_a_worker_holds_the_answers_of_one_function():
    calls = []
    one, other = (lambda x: calls.append(x) or (x,)), (lambda x: (x,))
    for _ in range(2):
        assert moves.remembered(one, 10)(3) == (3,)
    assert calls == [3]
    moves.remembered(other, 10)
    moves.remembered(one, 10)(3)
    assert calls == [3, 3]


def test_equal_inputs_of_a_task_are_asked_for_once():
    """Rows are told apart by columns, before any of them is looked at by itself; only what is kept goes back."""
    new = pa.schema([("x", pa.string()), ("y", pa.list_(pa.int64()))])
    n, asked = 3 * moves.BACK + 7, []
    rows = [pa.record_batch({"pos_id": range(s, s + n), "fen": [(None, "a", "b")[i % 3] for i in range(n)], "pick": [i % 4 for i in range(n)]}) for s in (0, n)]
    known = lambda fen, pick: asked.append((fen, pick)) or (f"{fen}{pick}", [pick] * pick)
    back = list(moves.answered(iter([*rows, rows[0].slice(0, 0)]), ["fen", "pick"], ["pos_id"], new, known))
    assert len(asked) == len(set(asked)) == 12 and max(b.num_rows for b in back) <= moves.BACK
    told = pa.Table.from_batches(back).to_pylist()
    assert [r["pos_id"] for r in told] == list(range(2 * n)) and set(told[0]) == {"pos_id", "x", "y"}
    for i, r in enumerate(told):
        fen, pick = (None, "a", "b")[i % n % 3], i % n % 4
        assert (r["x"], r["y"]) == (f"{fen}{pick}", [pick] * pick)
    assert not list(moves.answered(iter([rows[0].slice(0, 0)]), ["fen"], ["pos_id"], new, known))


def test_columns_are_narrowed_as_rows_are():
    fens, picks = positions.catalogue()[::500] * 40, range(0, 1000, 5)
    fens = (fens * 10)[: len(picks)]
    for choice in (1, 2, 5):
        told = moves.all_by_choice(choice, pa.array(fens), pa.array(picks, pa.int32()))
        assert list(zip(*(c.to_pylist() for c in told), strict=True)) == [moves.by_choice(choice, f, p) for f, p in zip(fens, picks, strict=True)]


def test_checks_and_mates_are_found_once_a_state(monkeypatch):
    """A move's check and mate stand in its SAN: what asks for them again searches nothing."""
    for fen in ("6k1/5ppp/8/8/8/8/8/K3R3 w - - 0 1", "4k3/8/8/8/8/8/8/K3R3 w - - 0 1", "4k3/8/8/8/8/8/4Q3/K7 w - - 0 1", rules.START):
        p = Position(fen)
        for m in p.legal():
            after = p.push(m)
            assert (p.gives_check(m), p.mates(m)) == (after.in_check(), after.is_checkmate())
    p = Position("6k1/5ppp/8/8/8/8/8/K3R3 w - - 0 1")
    m = p.parse_uci("e1e8")
    assert p.san(m) == "Re8#"
    monkeypatch.setattr(Position, "_pseudo", lambda p: pytest.fail("searched again"))
    monkeypatch.setattr(Position, "in_check", lambda p, white=None: pytest.fail("searched again"))
    assert rules.validate(p, "e1e8")["mate"] and "delivers checkmate" in rules.move_facts(p, m) and rules.threat_kind(p, m) == "checkmate"


@pytest.mark.parametrize(
    "fen, square",
    [
        ("4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 2", "d6"),
        ("8/8/8/K2pP2q/8/8/8/7k w - d6 0 1", "-"),  # both pawns leave the rank, and the king is in check
        ("8/8/8/8/R2pP2k/8/8/4K3 b - e3 0 2", "-"),
        ("4k3/8/8/8/3pP3/8/8/4K3 b - e3 0 2", "e3"),
        ("4k3/8/8/3p4/8/8/8/4K3 w - d6 0 2", "-"),
        ("4k3/8/8/8/8/8/4P3/4K3 w - e3 0 1", "e3"),  # no pawn has passed: told by all moves
    ],
)
def test_en_passant_squares_by_hand(fen, square, monkeypatch):
    p = Position(fen)
    assert any(m[1] == p.ep and p.board[m[0]].lower() == "p" for m in p.legal()) == (square != "-")
    if square != "e3" or "p" in fen.split()[0]:
        rules._state.cache_clear()
        p = Position(fen)
        monkeypatch.setattr(Position, "_pseudo", lambda p: pytest.fail("all moves were searched"))
    assert p.fen().split()[3] == square


def test_lines_of_one_position_share_what_is_legal_of_them(monkeypatch):
    played = []
    inner = rules.line_legality
    monkeypatch.setattr(rules, "line_legality", lambda p, line: played.append(line) or inner(p, line))
    line = "a4 a5 h4 h5 Ra3 Rh6"
    assert [moves.legality(rules.START, pick, "", line)[0] for pick in (1, 29, 57, 85)] == [2 / 7 - 1] * 4 and len(played) == 1


def test_answers_whose_arrays_are_those_of_states_are_remembered_as_flat_ones():
    """Of 2,048 positions with 25 moves each, 220,000 answers of m21_legal_tool differ: more than WIDE_MEMO."""
    assert moves.MEMOS["m21_legal_tool"] == moves.MEMO and moves.legal_tool(rules.START, 0)[1] is moves.legal_tool(rules.START, 1)[1]
