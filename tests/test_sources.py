"""Files that the sources read and write, and printed boards."""

import random
import struct

import pytest
from plyforge.functions.rules import Position
from plyforge.operators import moves, textbook
from plyforge.sources import fixed, pgn
from plyforge.sources.positions import catalogue, games


def test_catalogue_repeats_and_differs():
    fens = catalogue()
    assert len(set(fens)) == len(fens) > 1000 and catalogue() is fens
    assert any(Position(f).is_checkmate() for f in fens) and any(f.split()[3] != "-" for f in fens)
    p = Position()
    for ply in games()[0]:
        assert p.san(p.parse_uci(ply.uci)) == ply.san
        p = p.push(p.parse_uci(ply.uci))
        assert p.fen() == ply.fen


def test_records_of_fixed_width(spark, tmp_path):
    rows = [(f, [0.5 * k] * 13, float(k)) for k, f in enumerate(catalogue()[:50])] + [("no fen", [0.0] * 13, 1.0)]
    df = spark.createDataFrame(rows, "fen string, terms array<float>, score float").repartition(3)
    path = (tmp_path / "records").as_uri()
    moves.write_records(df, path)
    files = sorted((tmp_path / "records").iterdir())
    # Nothing but whole files: no draft, and no more bytes than records.
    assert all(f.name.startswith("part-") for f in files) and sum(f.stat().st_size for f in files) == 50 * fixed.SIZE == 50 * 210
    for where in (path, str(tmp_path / "records"), path.replace("file:///", "file:/")):
        read = moves.read_records(spark, where, range=5 * fixed.SIZE + 3)
        got = {r.fen: (r.terms[0], r.score, r.labels) for r in read.collect()}
        assert len(got) == 50 and read.rdd.getNumPartitions() >= 10
    for fen, terms, score in rows[:50]:
        assert got[fen] == (terms[0], score, [".PNBRQKpnbrqk".index(c) for c in Position(fen).board])
    assert moves.read_records(spark, path, limit=2).count() == 2 * len(files)
    data = files[0].read_bytes()
    assert struct.unpack("<90s13ff64B", data[:210])[0].rstrip(b"\0").decode() in got
    # Appended beside, or in place of what is there.
    moves.write_records(df.limit(4), path)
    assert moves.read_records(spark, path).count() == 54
    few = moves.read_records(spark, path, limit=1).where("score >= 0")
    few.persist().count()
    few.write.format("position_records").mode("overwrite").save(path)
    assert 0 < moves.read_records(spark, path).count() < 10
    files = sorted((tmp_path / "records").iterdir())
    files[0].write_bytes(b"x" * (fixed.SIZE + 1))
    with pytest.raises(Exception, match="whole number of records"):
        moves.read_records(spark, path).collect()
    assert moves.read_records(spark, str(tmp_path / "nothing")).count() == 0


def test_a_job_that_fails_leaves_no_records(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(f, [0.0] * 13, float(k)) for k, f in enumerate(catalogue()[:40])], "fen string, terms array<float>, score float").repartition(4)
    bad = df.withColumn("score", F.when(F.col("score") == 33, F.raise_error(F.lit("stop")).cast("float")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="stop"):
        moves.write_records(bad, str(tmp_path / "r"))
    assert not (tmp_path / "r").exists() or list((tmp_path / "r").iterdir()) == []


def test_pgn_files(spark, tmp_path):
    (tmp_path / "a.pgn").write_text('\n\n[Event "one"]\n[Result "1-0"]\n\n1. e4 e5 1-0\n\n[Event "two"]\n\n1. d4 *\n')
    (tmp_path / "b.pgn").write_text("")
    got = [r.text for r in pgn.scan(spark, str(tmp_path)).collect()]
    assert sorted(t.split('"')[1] for t in got) == ["one", "two"]
    assert moves.annotated_text('[Event "x"]\n\n1. e4 {a long comment that says a lot} e5 (1... c5 (1... e6) 2. Nf3) 2. Nf3 {ok}') == "e4 [Position: rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1] a long comment that says a lot e5 (1... c5 (1... e6) 2. Nf3) Nf3 ok"


def drawn(fen: str, style: int) -> list[str]:
    b, lines = Position(fen).board, []
    for r in range(7, -1, -1):
        cells = []
        for c in b[r * 8 : r * 8 + 8]:
            name = {"N": "Kt"}.get(c.upper(), c.upper())
            cells.append(("   " if style else "    ") if c == "." else f" {c.upper()}{'*' if c.islower() else ' '}" if style else f" {'^' if c.isupper() else '#'}{name}".ljust(4))
        lines += [("|" if style else f"   {r + 1} |") + "|".join(cells) + "|"]
    border = "+" + "---+" * 8 if style else "     +" + "-" * 39 + "+"
    return [border, *lines, border]


def test_printed_boards():
    rng = random.Random(4)
    for fen in rng.sample(catalogue(), 40):
        one, two = drawn(fen, 0), drawn(fen, 1)
        placed = fen.split()[0]
        text = "\n".join(["Before.", *one, "", "Diag. 3. and more", "Between.", "No. 12.", "BLACK.", *two, "WHITE.", "After."])
        found = textbook.boards(text)
        assert [(b.fen.split()[0], b.caption) for b in found] == [(placed, "Diag. 3."), (placed, "No. 12")]
        broken = "\n".join(["x", *one[:6], "y", *two[:5], "z"])
        assert textbook.boards(broken) == [] and textbook.marked(broken) == broken
    assert textbook.diagrams("a\n[Position (q): 8/8 w - - 0 1]\n" + "b" * 1600 + "\nc") == [("8/8 w - - 0 1", "q", "a", "b" * 1600)]
    assert textbook.boards("") == [] and textbook.rank_text(["x"] * 7, {}) is None


def test_session_and_threats():
    game = moves.Session()
    assert [game.make(m) for m in ("e4", "e7e5", "Ng1-f3")] == ["e4", "e5", "Nf3"] and "pawn: a5" in game.by_piece()
    with pytest.raises(ValueError):
        game.make("e4")
    assert game.undo() and game.undo() and game.undo() and not game.undo() and game.position.fen() == Position().fen()
    assert moves.verified_mate("rnbqkbnr/pppp1ppp/8/4p3/8/5P2/PPPPP1PP/RNBQKBNR w KQkq - 0 2", "g2g4", "d8h4")[1]
    assert moves.verified_mate(Position().fen(), "e2e4", "e7e4")[1] is False and moves.verified_mate("x", "e2e4", "e7e5") == (None, False)
    found = moves.threaten(Position("4k3/8/8/3q4/8/8/8/R3K3 w - - 0 1"), 5)
    assert found in {("a1", "d5", "Ra5"), ("a1", "d5", "Rd1")}
