"""Operators that replay moves: Arrow batches through the rules kernel, each distinct position once while its worker remembers it."""

from __future__ import annotations

import re
from functools import lru_cache, partial, reduce
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plyforge.functions import rules
from plyforge.functions.dialect import SPARK
from plyforge.functions.rules import NAMES, VALUES, WORDS, Position, position, uci
from plyforge.operators.features import picked
from plyforge.operators.legal_sql import ROWS_SQL, attacked, name, with_moves
from plyforge.plans.registry import register
from plyforge.sources import fixed
from plyforge.sources.pgn import header, pgn_texts, scan
from plyforge.sources.positions import LINES_SQL, picked_line, positions
from plyforge.streaming.logs import shared_dir

#: Answers that a worker remembers: of flat columns, and of columns that hold arrays.
MEMO, WIDE_MEMO = 250_000, 50_000
_last: list = []
#: Of each query its function, and what of pick it depends on: see position_query.
ASKED: dict[str, tuple] = {}
#: How many answers of a query are remembered, where its columns do not say it.
MEMOS: dict[str, int] = {}


def remembered(fn, size: int):
    """``fn`` with a memo that the next task of this worker finds again; a worker holds that of its last function only."""
    if not _last or _last[0] is not fn:
        _last[:] = fn, lru_cache(size)(fn)
    return _last[1]


def period(every: int, fen: str) -> int:
    """Picks that differ by it choose the same move and have the same remainder by ``every``."""
    return lcm(every, len(position(fen).legal()) or 1)


def by_choice(every: int, fen: str, pick: int) -> tuple[str, int]:
    """The least pick that chooses the same move and has the same remainder by ``every``."""
    return fen, pick % period(every, fen)


def all_by_choice(every: int, fens: pa.Array, picks: pa.Array) -> list[pa.Array]:
    """The same of columns; moves are counted once a different FEN."""
    told = fens.dictionary_encode()
    periods = np.array([period(every, fen) for fen in told.dictionary.to_pylist()], dtype=np.int64)
    return [fens, pa.array(picks.to_numpy(zero_copy_only=False) % periods[told.indices.to_numpy()])]


#: Rows that a task looks at together, and rows that it gives back together.
ROWS, BACK = 65_536, 10_000


def gathered(batches):
    """The rows of ``batches`` in batches of ROWS or somewhat more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def told_apart(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row of ``columns`` comes first, and of every row which of those it equals."""
    first = at = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        told = column.dictionary_encode("encode")
        _, first, at = np.unique(at * len(told.dictionary) + told.indices.to_numpy(), return_index=True, return_inverse=True)
    return first, at


def answered(batches, inputs: list[str], keep: list[str], new: pa.Schema, known, narrowed=None):
    """Columns ``keep`` of ``batches`` and those of ``new``, which ``known`` is asked for once for equal inputs of ROWS rows."""
    for batch in gathered(batches):
        columns = [batch.column(c) for c in inputs]
        if narrowed:
            columns = narrowed(*columns)
        first, at = told_apart(columns)
        rows = [known(*x) for x in zip(*(c.take(first).to_pylist() for c in columns), strict=True)]
        found = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(new)]
        for start in range(0, len(at), BACK):
            kept, part = batch.slice(start, BACK), at[start : start + BACK]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), *(c.take(part) for c in found)], names=[*keep, *new.names])


def per_row(df: DataFrame, inputs: list[str], outputs: str, fn, narrowed=None, keep: list[str] | None = None, memo: int | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with columns ``outputs`` (DDL) from fn(*inputs), a tuple; equal inputs are computed once while they are remembered.

    ``narrowed`` gives, of columns of inputs, those that stand for all with the same answer; ``memo`` is how many answers are remembered.
    """
    # The kernel takes far longer over a row than a shuffle of it: a table in fewer splits than cores is dealt out first.
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    keep = df.columns if keep is None else keep
    schema = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(outputs).fields])
    new = to_arrow_schema(StructType.fromDDL(outputs))
    size = memo or (WIDE_MEMO if "array" in outputs else MEMO)

    def run(batches):
        return answered(batches, inputs, keep, new, remembered(fn, size), narrowed)

    return df.mapInArrow(run, schema)


def picks(df: DataFrame) -> DataFrame:
    """``df`` with a number below 1009 that depends on the position's key alone."""
    return df.withColumn("pick", F.expr(picked("pick", 1009)(SPARK)).cast("int"))


def _register(key: str, source, inputs: list[str], outputs: str, explode: str | None, oracle: str | None, cycle: int | None = None, choice: int | None = None, memo: int | None = None):
    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = source(spark, sf_dir)
            if cycle:
                df = df.withColumn("pick", F.col("pick") % cycle)
            # What a function does not ask for is no part of the key under which its answers are remembered.
            rows = per_row(df, inputs[: fn.__code__.co_argcount], outputs, fn, partial(all_by_choice, choice) if choice else None, ["pos_id"], memo)
            return rows.select("pos_id", F.explode(explode).alias("x")).select("pos_id", "x.*") if explode else rows

        register(key, oracle)(run)
        ASKED[key] = fn, cycle, choice
        if memo:
            MEMOS[key] = memo
        return fn

    return put


def position_query(key: str, outputs: str, explode: str | None = None, sql: str | None = None, cycle: int | None = None, choice: int | None = None, memo: int | None = None):
    """Register fn(fen, pick) or fn(fen) -> tuple as a query over all positions; ``sql`` says the same over the relations of legal_sql.

    The answer depends on pick by its remainder by ``cycle``, or by the move it chooses and its remainder by ``choice``, if they are given.
    ``memo`` is for answers whose arrays are those of their states, so that many may be remembered.
    """
    return _register(key, lambda spark, sf_dir: picks(positions(spark, sf_dir, dealt=True)), ["fen", "pick"], outputs, explode, sql and with_moves(sql), cycle, choice, memo)


def line_query(key: str, outputs: str, explode: str | None = None, sql: str | None = None, cycle: int | None = None):
    """Register fn(fen, pick, ucis, sans) -> tuple over the line that each row picks; ``sql`` says the same over line_."""
    return _register(key, lambda spark, sf_dir: picked_line(spark, sf_dir, dealt=True), ["fen", "pick", "ucis", "sans"], outputs, explode, sql and f"WITH {LINES_SQL} {sql}", cycle)


def chosen(p: Position, pick: int):
    legal = p.legal()
    return legal[pick % len(legal)] if legal else None


def lan(p: Position, move) -> str:
    piece = p.board[move[0]].upper().replace("P", "")
    return f"{piece}{NAMES[move[0]]}{'x' if p.is_capture(move) else '-'}{NAMES[move[1]]}{'=' + move[2].upper() if move[2] else ''}"


def said(p: Position, pick: int) -> str:
    """A text for a move, as people and models write them: SAN, UCI, long algebraic, the way back (never legal), or no move."""
    m = chosen(p, pick)
    if m is None or pick % 5 == 4:
        return "zz"
    return (p.san(m), uci(m), lan(p, m), NAMES[m[1]] + NAMES[m[0]])[pick % 5]


# The same in SQL: of every row, its move if it has one, and what is said.
_FRM, _TO = name("frm"), name("dest")
_LAN = f"replace(upper(piece), 'P', '') || {_FRM} || CASE WHEN capture THEN 'x' ELSE '-' END || {_TO} || CASE WHEN promo = '' THEN '' ELSE '=' || upper(promo) END"
_ROWS = f"(SELECT r.*, c.* EXCLUDE (pos_id, pick, fen), CASE WHEN uci IS NULL OR r.pick % 5 = 4 THEN 'zz' WHEN r.pick % 5 = 0 THEN san WHEN r.pick % 5 = 1 THEN uci WHEN r.pick % 5 = 2 THEN {_LAN} ELSE {_TO} || {_FRM} END AS said, uci IS NOT NULL AND r.pick % 5 < 3 AS valid, CASE WHEN uci IS NULL OR r.pick % 5 = 4 THEN 'invalid uci: ''zz''' WHEN r.pick % 5 = 3 THEN 'illegal uci: ''' || {_TO} || {_FRM} || '''' END AS problem FROM rows_ r LEFT JOIN ch c USING (pos_id))"
_WORD = lambda c: "CASE lower(" + c + ") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items()) + " END"
_WORTH = lambda c: "CASE lower(" + c + ") " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VALUES.items()) + " ELSE 0 END"
_TAKEN = f"CASE WHEN kind = 'ep' THEN 'pawn' ELSE {_WORD('target')} END"


def _best(what: str, test: str, order: str = "uci", other: str = "'none'") -> str:
    """Of each row, ``what`` of the first move that passes ``test``."""
    return f"SELECT r.pos_id, coalesce(x.a, {other}) AS answer FROM rows_ r LEFT JOIN (SELECT fen, arg_min({what}, {order}) AS a FROM mv WHERE {test} GROUP BY fen) x USING (fen)"


def _lists(**columns: str) -> str:
    """Of each row, lists of its position's moves; empty ones where there are none."""
    made = ", ".join(f"coalesce(x.{c}, []) AS {c}" for c in columns)
    return f"SELECT r.pos_id, {made} FROM rows_ r LEFT JOIN (SELECT fen, {', '.join(f'{v} AS {c}' for c, v in columns.items())} FROM mv GROUP BY fen) x USING (fen)"


_REST = "list_sort(list_filter(list_transform(range(0, 64), lambda s: lower(substr(b, s + 1, 1))), lambda c: c NOT IN ('.', 'k')))"
_SHADES = "list_distinct(list_transform(list_filter(range(0, 64), lambda s: lower(substr(b, s + 1, 1)) = 'b'), lambda s: (s % 8 + s // 8) % 2))"
_POOR = f"({_REST} IN ([], ['b'], ['n']) OR list_distinct({_REST}) = ['b'] AND len({_SHADES}) = 1)"


@position_query("f04_game_over", "over boolean", sql=f"SELECT pos_id, n = 0 OR {_POOR} OR halfmove >= 150 AS over FROM rows_ JOIN st_ USING (fen) JOIN pos_ USING (fen)")
def game_over(fen):
    return (position(fen).is_over(),)


def mate_in_one(p: Position) -> list[str]:
    return [p.san(m) for m in p.legal() if p.push(m).is_checkmate()]


def verified_mate(fen: str, opponent: str, solution: str) -> tuple[str | None, bool]:
    """(position after the opponent's move, does the solution mate there); nothing and false where a move is not legal."""
    try:
        p = position(fen)
        p = p.push(p.parse_uci(opponent))
    except (ValueError, IndexError):
        return None, False
    try:
        return p.fen(), p.mates(p.parse_uci(solution))
    except ValueError:
        return p.fen(), False


@line_query("f06_mate_in_one_verified", "question_fen string, mates boolean",
            sql="SELECT pos_id, max(fen) FILTER (k = 0) AS question_fen, coalesce(bool_or(k = 1 AND contains(san, '#')), false) AS mates FROM line_ GROUP BY pos_id", cycle=1)
def verified_line(fen, pick, ucis, sans):
    opponent, solution, *_ = [*ucis.split(), ""]
    return verified_mate(fen, opponent, solution)


@position_query("f09_solution_legal", "legal boolean", sql=f"SELECT pos_id, valid AND pick % 5 = 1 OR coalesce(pick % 5 = 0 AND san = uci, false) AS legal FROM {_ROWS}", choice=5)
def solution_legal(fen, pick):
    p = position(fen)
    try:
        p.parse_uci(said(p, pick))
    except ValueError:
        return (False,)
    return (True,)


def fen_error(fen: str) -> str | None:
    try:
        p = Position(fen)
    except (ValueError, IndexError) as e:
        return str(e)
    for white in (True, False):
        if p.board.count("K" if white else "k") != 1:
            return "one king a side is needed"
    if any(c in "pP" for c in p.board[:8] + p.board[56:]):
        return "pawns on the first or last rank"
    if p.in_check(not p.white):
        return "the side that is not to move is in check"
    return None


_OTHER = "replace(replace(fen, ' w ', ' @ '), ' b ', ' w ')"


@position_query("f12_fen_validity", "ok boolean, error string", sql="""
SELECT pos_id, error IS NULL AS ok, error FROM (SELECT pos_id, CASE pick % 5 WHEN 1 THEN 'expected 8 columns per row in position part of fen: ''' || regexp_replace(fen, '/', '/9') || ''''
  WHEN 2 THEN 'one king a side is needed' WHEN 3 THEN CASE WHEN in_check THEN 'the side that is not to move is in check' END WHEN 4 THEN 'invalid character in position part of fen: ''x' || fen || '''' END AS error
 FROM rows_ JOIN st_ USING (fen))""", cycle=5)
def fen_validity(fen, pick):
    """FENs as they are, and four ways in which they go wrong."""
    turned = fen.replace(" w ", " @ ").replace(" b ", " w ").replace(" @ ", " b ")
    error = fen_error((fen, fen.replace("/", "/9", 1), fen.replace("K", "Q", 1), turned, "x" + fen)[pick % 5])
    return error is None, error


_CHEAP = f"lpad(({_WORTH('piece')})::VARCHAR, 2, '0') || uci"


@position_query("q22_capture_on_square", "square string, answer string", sql=f"""
SELECT r.pos_id, x.square, x.answer FROM rows_ r LEFT JOIN (
 SELECT fen, {name('min(dest)')} AS square, arg_min(san, {_CHEAP}) AS answer FROM (SELECT *, min(dest) OVER (PARTITION BY fen) AS least FROM mv WHERE target <> '.') WHERE dest = least GROUP BY fen) x USING (fen)""")
def capture_on_square(fen):
    """The cheapest piece that may capture on the first square where anything may."""
    p = position(fen)
    takes = [m for m in p.legal() if p.board[m[1]] != "."]
    if not takes:
        return None, None
    square = min(m[1] for m in takes)
    best = min((m for m in takes if m[1] == square), key=lambda m: (VALUES[p.board[m[0]].lower()], uci(m)))
    return NAMES[square], p.san(best)


@position_query("q23_give_check", "answer string", sql=_best("san", "chk", "capture::INTEGER || uci"))
def give_check(fen):
    p = position(fen)
    checks = [m for m in p.legal() if p.push(m).in_check()]
    quiet = [m for m in checks if not p.is_capture(m)]
    return (p.san((quiet or checks)[0]) if checks else "none",)


def threaten(p: Position, pick: int, most: int = 4) -> tuple[str, str, str] | None:
    """(from, target, move): the first pair of an own piece and an enemy officer, of ``most`` each in an order that follows
    from ``pick``, such that a move of the piece attacks the officer then."""
    order = lambda s: (s * 29 + pick) % 64
    own = sorted((s for s in range(64) if p.own(p.board[s], p.white) and p.board[s] not in "kK"), key=order)[:most]
    targets = sorted((s for s in range(64) if p.own(p.board[s], not p.white) and p.board[s].lower() in "qrbn"), key=order)[:most]
    reach = p.reach()
    for s in own:
        hits = [x for x in reach if x[0][0] == s]
        for t in targets:
            for m, hit in hits:
                if t in hit:
                    return NAMES[s], NAMES[t], p.san(m)
    return None


def _ranked(alias: str, test: str) -> str:
    return f"{alias} AS (SELECT pos_id, fen, s, k FROM (SELECT r.pos_id, r.fen, s, row_number() OVER (PARTITION BY r.pos_id ORDER BY (s * 29 + pick) % 64) AS k FROM rows_ r JOIN pos_ USING (fen), range(0, 64) AS t(s) WHERE {test}) WHERE k <= 4)"


_OWN = "substr(b, s::INTEGER + 1, 1) <> '.' AND (upper(substr(b, s::INTEGER + 1, 1)) = substr(b, s::INTEGER + 1, 1))"


@position_query("q24_threaten_piece_with", "from string, target string, answer string", sql=f"""
SELECT r.pos_id, x.f AS "from", x.t AS target, coalesce(x.a, 'none') AS answer FROM rows_ r LEFT JOIN (
 SELECT o.pos_id, arg_min({name('o.s')}, o.k * 100 + e.k) AS f, arg_min({name('e.s')}, o.k * 100 + e.k) AS t, arg_min(san, (o.k * 100 + e.k) || uci) AS a
 FROM (SELECT * FROM own_) o JOIN (SELECT * FROM foe_) e ON e.pos_id = o.pos_id JOIN mv ON mv.fen = o.fen AND frm = o.s AND list_contains(hits, e.s) GROUP BY o.pos_id) x USING (pos_id)""".replace("(SELECT * FROM own_)", f"(WITH {_ranked('z', f'{_OWN} = white AND lower(substr(b, s::INTEGER + 1, 1)) <> {chr(39)}k{chr(39)}')} SELECT * FROM z)").replace("(SELECT * FROM foe_)", f"(WITH {_ranked('z', f'{_OWN} <> white AND lower(substr(b, s::INTEGER + 1, 1)) IN ({chr(39)}q{chr(39)}, {chr(39)}r{chr(39)}, {chr(39)}b{chr(39)}, {chr(39)}n{chr(39)})')} SELECT * FROM z)"), cycle=64)
def threaten_piece(fen, pick):
    return threaten(position(fen), pick) or (None, None, "none")


_OFFICERS = "len(list_filter(hits, lambda t: lower(substr(after, t::INTEGER + 1, 1)) IN ({0}) AND (upper(substr(after, t::INTEGER + 1, 1)) = substr(after, t::INTEGER + 1, 1)) <> white))"
_FORKS = f"{_OFFICERS.format(', '.join(repr(c) for c in 'nbrqk'))} >= 2"


@position_query("q25_fork_move", "answer string", sql=_best("san", _FORKS))
def fork_move(fen):
    return ((rules.fork_moves(position(fen)) or ["none"])[0],)


@position_query("q29_checkmate_in_one", "answer string", sql=_best("san", "mate"))
def checkmate_in_one(fen):
    return ((mate_in_one(position(fen)) or ["none"])[0],)


@position_query("q32_legal_moves", "answer string, n long", sql="SELECT r.pos_id, coalesce(string_agg(san, chr(10) ORDER BY san), '') AS answer, count(san) AS n FROM rows_ r LEFT JOIN mv USING (fen) GROUP BY r.pos_id")
def legal_moves(fen):
    sans = position(fen).sans()
    return "\n".join(sans), len(sans)


@position_query("q33_captures", "answer string", sql="SELECT r.pos_id, coalesce(string_agg(san, chr(10) ORDER BY san) FILTER (capture), 'none') AS answer FROM rows_ r LEFT JOIN mv USING (fen) GROUP BY r.pos_id")
def captures(fen):
    p = position(fen)
    return ("\n".join(sorted(p.san(m) for m in p.legal() if p.is_capture(m))) or "none",)


@position_query("m01_validate_move", "valid boolean, uci string, san string, error string, fen_after string, is_check boolean, is_mate boolean, is_capture boolean, captured string",
                sql=f"SELECT pos_id, valid, CASE WHEN valid THEN uci END AS uci, CASE WHEN valid THEN san END AS san, problem AS error, CASE WHEN valid THEN fen_after END AS fen_after, valid AND chk AS is_check, valid AND mate AS is_mate, valid AND capture AS is_capture, CASE WHEN valid THEN {_TAKEN} END AS captured FROM {_ROWS}", choice=5)
def validate_move(fen, pick):
    p = position(fen)
    v = rules.validate(p, said(p, pick))
    return tuple(v[k] for k in ("valid", "uci", "san", "error", "fen", "check", "mate", "capture", "captured"))


@position_query("m02_parse_flexible", "uci string, error string", sql=f"SELECT pos_id, CASE WHEN valid THEN uci END AS uci, problem AS error FROM {_ROWS}", choice=5)
def parse_flexible(fen, pick):
    p = position(fen)
    try:
        return uci(p.parse_any(said(p, pick))), None
    except ValueError as e:
        return None, str(e)


@position_query("m03_moves_of_square", "square string, moves array<string>", sql=f"SELECT r.pos_id, {name('r.pick % 64')} AS square, coalesce(list(uci ORDER BY uci) FILTER (uci IS NOT NULL), []) AS moves FROM rows_ r LEFT JOIN mv ON mv.fen = r.fen AND frm = r.pick % 64 GROUP BY r.pos_id, r.pick", cycle=64)
def moves_of_square(fen, pick):
    s = pick % 64
    return NAMES[s], [uci(m) for m in position(fen).legal() if m[0] == s]


@position_query("m04_valid_moves", "moves array<string>", sql=f"SELECT r.pos_id, coalesce((SELECT CASE WHEN n > 1 THEN [uci, other] ELSE [uci] END FROM (SELECT c.uci, c.n, d.uci AS other FROM ch c JOIN mv d ON d.fen = c.fen AND d.rn = (c.pick + 1) % c.n WHERE c.pos_id = r.pos_id)), []) AS moves FROM rows_ r", choice=1)
def valid_moves(fen, pick):
    """Of a model's list - a move, its way back, no move, the next move - what is legal, each once."""
    p = position(fen)
    found = [uci(chosen(p, pick + k)) for k in (0, 1)] if p.legal() else []
    listed = [found[0], found[0][2:4] + found[0][:2], "zz", *found[1:]] if found else ["e2e4", "zz"]
    legal = set(map(uci, p.legal()))
    return (list(dict.fromkeys(m for m in listed if m in legal)),)


@position_query("m05_categories", "captures array<string>, checks array<string>, other array<string>", sql=_lists(captures="coalesce(list(uci ORDER BY uci) FILTER (capture), [])", checks="coalesce(list(uci ORDER BY uci) FILTER (chk AND NOT capture), [])", other="coalesce(list(uci ORDER BY uci) FILTER (NOT chk AND NOT capture), [])"))
def categories(fen):
    p, out = position(fen), {"captures": [], "checks": [], "other": []}
    for m in p.legal():
        out["captures" if p.is_capture(m) else "checks" if p.push(m).in_check() else "other"].append(uci(m))
    return out["captures"], out["checks"], out["other"]


@line_query("m06_play_moves", "played array<string>, fen_after string, error string", sql="""
SELECT pos_id, list(san ORDER BY k) FILTER (k <= pick % 5) AS played, arg_max(fen, k) FILTER (k <= pick % 5) AS fen_after, CASE WHEN pick % 2 = 0 THEN 'invalid uci: ''zz''' END AS error FROM line_ GROUP BY pos_id, pick""", cycle=10)
def play_moves(fen, pick, ucis, sans):
    """SAN and UCI in turn, and after some of them a text that is no move."""
    mixed = [(s, u)[i % 2] for i, (s, u) in enumerate(zip(sans.split(), ucis.split(), strict=True))][: pick % 5 + 1]
    done, p, error = rules.play(position(fen), mixed + (["zz"] if pick % 2 == 0 else []))
    return done, p.fen(), error


_FACTS = f"""list_filter([CASE WHEN kind = 'ep' THEN 'captures pawn en passant on ' || {_TO} WHEN target <> '.' THEN 'captures ' || {_WORD('target')} || ' on ' || {_TO} END,
 CASE WHEN kind = 'castle' THEN CASE WHEN dest > frm THEN 'castles kingside' ELSE 'castles queenside' END END, CASE WHEN promo <> '' THEN 'promotes pawn to ' || {_WORD('promo')} END,
 CASE WHEN mate THEN 'delivers checkmate' WHEN chk THEN 'gives check' END,
 CASE WHEN target = '.' AND kind NOT IN ('castle', 'ep') THEN CASE WHEN lower(piece) = 'p' THEN 'advances pawn ' || CASE WHEN kind = 'double' THEN 'two squares ' ELSE '' END || 'to ' || {_TO} ELSE 'moves ' || {_WORD('piece')} || ' from ' || {_FRM} || ' to ' || {_TO} END END], lambda x: x IS NOT NULL)"""


@position_query("m07_move_facts", "move string, facts array<string>", sql=f"SELECT r.pos_id, uci AS move, CASE WHEN uci IS NULL THEN [] ELSE {_FACTS} END AS facts FROM rows_ r LEFT JOIN ch USING (pos_id)", choice=1)
def facts(fen, pick):
    p = position(fen)
    m = chosen(p, pick)
    return (uci(m), rules.move_facts(p, m)) if m else (None, [])


@line_query("m08_puzzle_questions", "q array<struct<question_fen: string, solution: string, color: string, depth: long, total: long>>", explode="q", sql="""
SELECT pos_id, fen_before AS question_fen, uci AS solution, CASE WHEN contains(fen_before, ' w ') THEN 'white' ELSE 'black' END AS color, k // 2 AS depth, n // 2 AS total FROM (SELECT *, count(*) OVER (PARTITION BY pos_id) AS n FROM line_) WHERE k % 2 = 1""", cycle=1)
def puzzle_questions(fen, pick, ucis, sans):
    return ([{"question_fen": q["fen"], **{k: q[k] for k in ("solution", "color", "depth", "total")}} for q in rules.expand_puzzle(fen, ucis)],)


def _broken(pick: int, sans: str) -> list[str]:
    """A line with an illegal move in it, or none."""
    moves = sans.split()
    at = pick % 7
    return moves[:at] + ["Ka9"] + moves[at:] if at < len(moves) else moves


_LEGAL_SHARE = "CASE WHEN pick % 7 < count(*) THEN 2 * (pick % 7)::DOUBLE / (count(*) + 1) - 1 ELSE 1.0::DOUBLE END"


@line_query("m12_line_legality", "score double", sql=f"SELECT pos_id, {_LEGAL_SHARE} AS score FROM line_ GROUP BY pos_id, pick", cycle=7)
def line_legality(fen, pick, ucis, sans):
    return (rules.line_legality(position(fen), _broken(pick, sans)),)


@line_query("m13_line_boards", "boards array<struct<ply: long, fen: string, move: string>>", explode="boards", sql="SELECT pos_id, k AS ply, fen_before AS fen, san AS move FROM line_", cycle=1)
def line_boards(fen, pick, ucis, sans):
    p, out = position(fen), []
    for k, text in enumerate(sans.split()):
        m = p.parse_san(text)
        out.append({"ply": k, "fen": p.fen(), "move": p.san(m)})
        p = p.push(m)
    return (out,)


def opening_prefix(text: str, fen: str = rules.START) -> list[str]:
    """The legal beginning of a list of moves in UCI, if two moves of it at least are legal."""
    p, out = position(fen), []
    for word in text.split():
        try:
            m = p.parse_san(word)
        except ValueError:
            break
        out.append(uci(m))
        p = p.push(m)
    return out if len(out) >= 2 else []


@line_query("m14_opening_prefix", "moves array<string>", sql="SELECT pos_id, CASE WHEN least(pick % 7, count(*)) >= 2 THEN coalesce(list(uci ORDER BY k) FILTER (k < pick % 7), []) ELSE [] END AS moves FROM line_ GROUP BY pos_id, pick", cycle=7)
def legal_prefix(fen, pick, ucis, sans):
    return (opening_prefix(" ".join(_broken(pick, sans)), fen),)


def first_legal(p: Position, text: str) -> str | None:
    for pattern, parse in ((r"\b(?:O-O(?:-O)?|[NBRQK]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?)[+#]?", p.parse_san), (r"\b[a-h][1-8][a-h][1-8][nbrq]?\b", p.parse_uci)):
        for m in re.finditer(pattern, text):
            try:
                return uci(parse(m[0]))
            except ValueError:
                pass
    return None


@position_query("m15_first_legal_move", "move string", sql="SELECT r.pos_id, uci AS move FROM rows_ r LEFT JOIN ch USING (pos_id)", choice=2)
def first_legal_move(fen, pick):
    """Of a sentence with a move of no square, the way back of a move, and the move in SAN or UCI."""
    p = position(fen)
    m = chosen(p, pick)
    if m is None:
        return (first_legal(p, "I would try Qh9 or e2e4."),)
    return (first_legal(p, f"I would try Qh9, never {NAMES[m[1]]}{NAMES[m[0]]}, but {p.san(m) if pick % 2 else uci(m)}!"),)


_KINDS = f"CASE WHEN target <> '.' THEN 'capture_' || {_WORD('target')} WHEN mate THEN 'checkmate' WHEN chk THEN 'check' WHEN lower(piece) = 'n' AND {_OFFICERS.format(', '.join(repr(c) for c in 'qrk'))} >= 2 THEN 'fork' ELSE 'positional' END"


@position_query("m16_threat_kind", "move string, kind string", sql=f"SELECT r.pos_id, uci AS move, CASE WHEN uci IS NULL THEN 'unknown' ELSE {_KINDS} END AS kind FROM rows_ r LEFT JOIN ch USING (pos_id)", choice=1)
def threat_kind(fen, pick):
    p = position(fen)
    m = chosen(p, pick)
    return (uci(m), rules.threat_kind(p, m)) if m else (None, "unknown")


@position_query("m17_hanging_by_value", "squares array<string>", sql=f"SELECT r.pos_id, coalesce(x.l[1:3], []) AS squares FROM rows_ r LEFT JOIN (SELECT fen, list({name('dest')} ORDER BY u) AS l FROM (SELECT fen, dest, min(uci) AS u FROM mv WHERE target <> '.' AND {_WORTH('target')} >= {_WORTH('piece')} GROUP BY fen, dest) GROUP BY fen) x USING (fen)")
def hanging_by_value(fen):
    """Squares where a capture wins at least the capturer's worth; three at most, as the report has it."""
    p = position(fen)
    hit = [NAMES[m[1]] for m in p.legal() if p.board[m[1]] != "." and VALUES[p.board[m[1]].lower()] >= VALUES[p.board[m[0]].lower()]]
    return (list(dict.fromkeys(hit))[:3],)


@position_query("m20_tactics_text", "text string", sql=f"SELECT r.pos_id, coalesce(array_to_string({_FACTS}, '; ') || CASE WHEN {_FORKS} THEN '; forks' ELSE '' END, '') AS text FROM rows_ r LEFT JOIN ch USING (pos_id)", choice=1)
def tactics_text(fen, pick):
    p = position(fen)
    m = chosen(p, pick)
    return ("; ".join(rules.move_facts(p, m)) + ("; forks" if rules.forks(p, m) else "") if m else "",)


@position_query("m21_legal_tool", "legal boolean, sans array<string>", sql=f"SELECT pos_id, valid AS legal, coalesce((SELECT list(san ORDER BY san) FROM mv WHERE mv.fen = x.fen), []) AS sans FROM {_ROWS} x", choice=5, memo=MEMO)
def legal_tool(fen, pick):
    p = position(fen)
    try:
        p.parse_any(said(p, pick))
    except ValueError:
        return False, p.sans()
    return True, p.sans()


class Session:
    """A game that is played move by move and taken back."""

    def __init__(self, fen: str = rules.START):
        self.past = [position(fen)]

    @property
    def position(self) -> Position:
        return self.past[-1]

    def make(self, text: str) -> str:
        """Play a move in any notation and give its SAN; ValueError leaves the game as it is."""
        p = self.position
        m = p.parse_any(text)
        self.past.append(p.push(m))
        return p.san(m)

    def undo(self) -> bool:
        """Take the last move back, if there is one."""
        if len(self.past) > 1:
            self.past.pop()
            return True
        return False

    def by_piece(self) -> str:
        return by_piece(self.position)


@lru_cache(rules.STATES)
def by_piece(p: Position) -> str:
    by = {}
    for m in p.legal():
        by.setdefault(WORDS[p.board[m[0]].lower()], []).append(p.san(m))
    return "; ".join(f"{k}: {', '.join(sorted(v))}" for k, v in sorted(by.items()))


@position_query("m22_session_moves", "grouped string, made string, after string, undone string, empty boolean", sql=f"""
SELECT pos_id, coalesce((SELECT string_agg(l, '; ' ORDER BY l) FROM (SELECT {_WORD('piece')} || ': ' || string_agg(san, ', ' ORDER BY san) AS l FROM mv WHERE mv.fen = x.fen GROUP BY {_WORD('piece')})), '') AS grouped,
 CASE WHEN valid THEN san ELSE problem END AS made, CASE WHEN valid THEN fen_after ELSE fen END AS after, fen AS undone, false AS empty FROM {_ROWS} x""", choice=5)
def session_moves(fen, pick):
    game = Session(fen)
    p, grouped = game.position, game.by_piece()
    try:
        made = game.make(said(p, pick))
    except ValueError as e:
        made = str(e)
    after = game.position.fen()
    game.undo()
    return grouped, made, after, game.position.fen(), game.undo()


_YES = "CASE WHEN {0} THEN 'True' ELSE 'False' END"


@position_query("p08_training_context", "text string", sql=f"SELECT r.pos_id, r.fen || coalesce(chr(10) || 'Move: ' || san || '; capture: ' || {_YES.format('capture')} || '; check: ' || {_YES.format('chk')}, '') AS text FROM rows_ r LEFT JOIN ch USING (pos_id)", choice=1)
def training_context(fen, pick):
    p = position(fen)
    m = chosen(p, pick)
    return (f"{fen}\nMove: {p.san(m)}; capture: {p.is_capture(m)}; check: {p.gives_check(m)}" if m else fen,)


# A quiet move is a threat where an enemy piece of more worth than the mover is attacked and not defended then.
_THREATS = f"""cct AS (SELECT fen, uci, san, chk, capture, NOT chk AND NOT capture AND EXISTS (SELECT 1 FROM geo g WHERE substr(after, g.s::INTEGER + 1, 1) <> '.' AND (upper(substr(after, g.s::INTEGER + 1, 1)) = substr(after, g.s::INTEGER + 1, 1)) <> white
  AND {_WORTH('substr(after, g.s::INTEGER + 1, 1)')} > {_WORTH('piece')} AND {attacked('after', 'g', 'white')} AND NOT {attacked('after', 'g', 'NOT white')}) AS threat FROM mv),
cct5 AS (SELECT fen, coalesce((list(san ORDER BY uci) FILTER (chk))[1:5], []) AS checks, coalesce((list(san ORDER BY uci) FILTER (capture AND NOT chk))[1:5], []) AS captures, coalesce((list(san ORDER BY uci) FILTER (threat))[1:5], []) AS threats FROM cct GROUP BY fen)"""


def with_threats(sql: str) -> str:
    return f", {_THREATS} {sql}"


@position_query("p18_checks_captures_threats", "checks array<string>, captures array<string>, threats array<string>", sql=with_threats("SELECT r.pos_id, coalesce(checks, []) AS checks, coalesce(captures, []) AS captures, coalesce(threats, []) AS threats FROM rows_ r LEFT JOIN cct5 USING (fen)"))
def cct(fen):
    found = rules.checks_captures_threats(position(fen))
    return found["checks"], found["captures"], found["threats"]


_HELD = "(CASE WHEN instr(castling, 'K') > 0 AND substr(b, 5, 1) = 'K' AND substr(b, 8, 1) = 'R' THEN 'K' ELSE '' END || CASE WHEN instr(castling, 'Q') > 0 AND substr(b, 5, 1) = 'K' AND substr(b, 1, 1) = 'R' THEN 'Q' ELSE '' END || CASE WHEN instr(castling, 'k') > 0 AND substr(b, 61, 1) = 'k' AND substr(b, 64, 1) = 'r' THEN 'k' ELSE '' END || CASE WHEN instr(castling, 'q') > 0 AND substr(b, 61, 1) = 'k' AND substr(b, 57, 1) = 'r' THEN 'q' ELSE '' END)"
_ALL = "rows_ r JOIN st_ USING (fen) JOIN pos_ USING (fen)"


@position_query("p25_global_state", "text string", sql=f"SELECT r.pos_id, concat_ws(' ', CASE WHEN white THEN 'White' ELSE 'Black' END || ' to move.', CASE WHEN in_check AND n = 0 THEN 'Checkmate!' WHEN in_check THEN 'King is in check!' WHEN n = 0 THEN 'Stalemate!' END, 'castling: ' || CASE WHEN {_HELD} = '' THEN 'none' ELSE {_HELD} END || '.') AS text FROM {_ALL}")
def global_state(fen):
    p = position(fen)
    state = "Checkmate!" if p.is_checkmate() else "King is in check!" if p.in_check() else "Stalemate!" if p.is_stalemate() else ""
    return (" ".join(x for x in (f"{'White' if p.white else 'Black'} to move.", state, f"castling: {p.rights or 'none'}.") if x),)


@position_query("p30_terminal_report", "is_check boolean, is_mate boolean, is_stalemate boolean, insufficient boolean, seventy_five boolean, can_claim boolean, outcome string",
                sql=f"SELECT r.pos_id, in_check AS is_check, in_check AND n = 0 AS is_mate, NOT in_check AND n = 0 AS is_stalemate, {_POOR} AS insufficient, halfmove >= 150 AS seventy_five, halfmove >= 100 AS can_claim, CASE WHEN n = 0 AND in_check THEN CASE WHEN white THEN '0-1' ELSE '1-0' END WHEN n = 0 OR {_POOR} THEN '1/2-1/2' END AS outcome FROM {_ALL}")
def terminal_report(fen):
    p = position(fen)
    mate, stale = p.is_checkmate(), p.is_stalemate()
    outcome = ("0-1" if p.white else "1-0") if mate else "1/2-1/2" if stale or p.insufficient() else None
    return p.in_check(), mate, stale, p.insufficient(), p.half >= 150, p.half >= 100, outcome


_PIECES = "; ".join
_INVENTORY = "array_to_string(list_filter(list_transform(string_split('K,Q,R,B,N,P,k,q,r,b,n,p', ','), lambda c: CASE WHEN contains(b, c) THEN c || ': ' || array_to_string(list_transform(list_filter(range(0, 64), lambda s: substr(b, s::INTEGER + 1, 1) = c), lambda s: substr('abcdefgh', (s % 8 + 1)::INTEGER, 1) || (s // 8 + 1)), ', ') END), lambda x: x IS NOT NULL), '; ')"


@position_query("p31_context_string", "text string", sql=f"SELECT r.pos_id, {_INVENTORY} || chr(10) || 'Legal moves: ' || coalesce((SELECT string_agg(uci, ' ' ORDER BY uci) FROM mv WHERE mv.fen = r.fen), '') AS text FROM rows_ r JOIN pos_ USING (fen)")
def context_string(fen):
    p = position(fen)
    pieces = "; ".join(f"{c}: {', '.join(NAMES[s] for s in range(64) if p.board[s] == c)}" for c in "KQRBNPkqrbnp" if c in p.board)
    return (f"{pieces}\nLegal moves: {' '.join(map(uci, p.legal()))}",)


@position_query("p32_session_info", "rights array<string>, status string, n_legal long", sql=f"SELECT r.pos_id, list_filter(string_split({_HELD}, ''), lambda c: c <> '') AS rights, CASE WHEN in_check AND n = 0 THEN 'checkmate' WHEN n = 0 THEN 'stalemate' WHEN in_check THEN 'check' ELSE 'ongoing' END AS status, n AS n_legal FROM {_ALL}")
def session_info(fen):
    p = position(fen)
    n = len(p.legal())
    return list(p.rights), "checkmate" if p.is_checkmate() else "stalemate" if not n else "check" if p.in_check() else "ongoing", n


@position_query("r02_move_context", "fen_before string, fen_after string, move string", sql="SELECT r.pos_id, r.fen AS fen_before, fen_after, san AS move FROM rows_ r LEFT JOIN ch USING (pos_id)", choice=1)
def move_context(fen, pick):
    p = position(fen)
    m = chosen(p, pick)
    return (fen, p.push(m).fen(), p.san(m)) if m else (fen, None, None)


@lru_cache(2 * rules.STATES)
def _share(p: Position, line: tuple[str, ...]) -> float:
    return rules.line_legality(p, line)


def reward_legality(p: Position | None, lines: list[list[str]]) -> float:
    """The mean share of legal moves; -1 without lines, 0 without a position."""
    if p is None:
        return 0.0
    return sum(_share(p, tuple(x)) for x in lines) / len(lines) if lines else -1.0


@line_query("r05_reward_legality", "reward double", sql=f"SELECT pos_id, CASE pick % 4 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN {_LEGAL_SHARE} WHEN 2 THEN (1 + {_LEGAL_SHARE}) / 2 ELSE 0.0::DOUBLE END AS reward FROM line_ GROUP BY pos_id, pick", cycle=28)
def legality(fen, pick, ucis, sans):
    lines = ([], [_broken(pick, sans)], [sans.split(), _broken(pick, sans)], [sans.split()])[pick % 4]
    return (reward_legality(None if pick % 4 == 3 else position(fen), lines),)


@position_query("r17_san_reward", "reward double", sql=f"SELECT pos_id, CASE WHEN valid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM {_ROWS}", choice=5)
def san_reward(fen, pick):
    """1 where the answer, in any notation, is the solution."""
    p = position(fen)
    m = chosen(p, pick)
    try:
        return (1.0 if m and p.parse_any(said(p, pick)) == m else 0.0,)
    except ValueError:
        return (0.0,)


# -- records of fixed width: see sources/fixed --

_CLASS = {c: i for i, c in enumerate(".PNBRQKpnbrqk")}


def labelled(fen: str) -> tuple[list[int] | None]:
    """Piece classes of the 64 squares; None for a FEN that can't be read."""
    try:
        return ([_CLASS[c] for c in Position(fen).board],)
    except (ValueError, IndexError):
        return (None,)


def write_records(rows: DataFrame, path: str) -> None:
    """Fixed-width records of rows (fen, terms, score), of what can be encoded."""
    fixed.registered(rows.sparkSession)
    made = per_row(rows.select("fen", "terms", "score"), ["fen"], "labels array<int>", labelled).where("labels is not null")
    made.select("fen", F.transform("terms", lambda x: x.cast("float")).alias("terms"), F.col("score").cast("float").alias("score"), "labels").write.format("position_records").mode("append").save(path)


def read_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """fen, terms, score, labels of the records under ``path``; options as the source has them (limit, range)."""
    return fixed.registered(spark).read.format("position_records").options(**options).load(path)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos_id, fen, terms, score: quarters from the key, which floats hold exactly; every 13th FEN can't be read."""
    rows = picks(positions(spark, sf_dir))
    terms = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: (((F.col("pick") + i) % 41 - 20) / 4).cast("float"))
    return rows.withColumn("terms", terms).withColumn("score", (F.col("pick") / 2).cast("float")).withColumn("fen", F.when(F.col("pick") % 13 == 0, "no position").otherwise(F.col("fen")))


_RECORDS = f"(SELECT r.pos_id, r.fen, pick, b FROM rows_ r JOIN pos_ USING (fen) WHERE pick % 13 <> 0)"


@register("k03_fixed_width_encode", f"WITH {ROWS_SQL} SELECT count(*) AS n, count(*) * 210 AS bytes FROM {_RECORDS}")
def fixed_width(spark, sf_dir):
    """Records and bytes of what is written; rows that can't be encoded are left out."""
    path = f"{shared_dir(spark)}/records"
    write_records(records(spark, sf_dir), path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bin").load(path).agg(F.coalesce(F.sum(F.expr(f"length div {fixed.SIZE}")), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


@register("s07_fixed_width_read", f"""WITH {ROWS_SQL} SELECT fen, (pick / 2.0)::DOUBLE AS score, (list_sum(list_transform(range(0, 13), lambda i: ((pick + i) % 41 - 20) / 4.0)))::DOUBLE AS terms,
 array_to_string(list_transform(range(0, 64), lambda s: instr('PNBRQKpnbrqk', substr(b, s::INTEGER + 1, 1))), ' ') AS labels FROM {_RECORDS}""")
def fixed_width_read(spark, sf_dir):
    path = f"{shared_dir(spark)}/records"
    write_records(records(spark, sf_dir), path)
    rows = read_records(spark, path)
    return rows.select("fen", F.col("score").cast("double").alias("score"), F.aggregate("terms", F.lit(0.0), lambda a, x: a + x).alias("terms"), F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))


# -- PGN: files of games, scanned a game a row --


def pgn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test games written as PGN text, and read again by ``scan``."""
    path = f"{shared_dir(spark)}/pgn"
    pgn_texts(spark, sf_dir).select("text").write.text(path)
    return scan(spark, path)


_OF = "s_suppkey % (SELECT max(no) + 1 FROM games_)"
_RESULT = "CASE s_suppkey % 6 WHEN 0 THEN '1-0' WHEN 1 THEN '1/2-1/2' WHEN 2 THEN '0-1' WHEN 3 THEN '1-0' WHEN 4 THEN '1/2-1/2' ELSE '*' END"


@register("s09_pgn_games", f"SELECT 'game ' || s_suppkey AS event, n AS n_plies, {_RESULT} AS result, f AS final_fen FROM supplier JOIN (SELECT no, count(*) AS n, arg_max(fen, ply) AS f FROM games_ GROUP BY no) ON no = {_OF}")
def pgn_games(spark, sf_dir):
    rows = per_row(pgn_rows(spark, sf_dir).withColumn("event", header("Event")), ["text"], "games array<struct<n_plies: long, result: string, final_fen: string>>", lambda text: ([{"n_plies": len(g["plies"]), "result": g["result"], "final_fen": g["final_fen"]} for g in rules.pgn_games(text)],))
    return rows.select("event", F.explode("games").alias("g")).select("event", "g.*")


@register("m09_game_replay", f"SELECT 'game ' || s_suppkey AS event, ply, san, uci, fen_before, CASE WHEN ply % 2 = 0 THEN 'white' ELSE 'black' END AS side, ply // 2 + 1 AS number FROM supplier JOIN games_ ON no = {_OF}")
def game_replay(spark, sf_dir):
    rows = per_row(pgn_rows(spark, sf_dir).withColumn("event", header("Event")), ["text"], "plies array<struct<ply: long, san: string, uci: string, fen_before: string, side: string, number: long>>", lambda text: ([{"ply": i, **m} for g in rules.pgn_games(text) for i, m in enumerate(g["plies"])],))
    return rows.select("event", F.explode("plies").alias("m")).select("event", "m.*")


@register("m10_annotated_pgn", f"""SELECT 'game ' || s_suppkey AS event, t AS text FROM supplier JOIN (
 SELECT no, string_agg(san || CASE ply WHEN 2 THEN ' short' WHEN 4 THEN ' (3. a3 (1. h3) a6)' WHEN 9 THEN ' [Position: ' || fen || '] a quiet move that leaves both sides with much to do' ELSE '' END, ' ' ORDER BY ply) AS t FROM games_ GROUP BY no) ON no = {_OF}""".replace("(1. h3)", "(1. h3)"))
def annotated_pgn(spark, sf_dir):
    rows = per_row(pgn_rows(spark, sf_dir).withColumn("event", header("Event")), ["text"], "annotated string", lambda text: (annotated_text(text),))
    return rows.select("event", F.col("annotated").alias("text"))


#: What a Termination header says, the first that it contains (fixed values, in this order).
TERMINATIONS = (("checkmate", "checkmate"), ("resignation", "resignation"), ("time", "timeout"), ("agreement", "agreement"), ("stalemate", "stalemate"))


@register("m18_result_detail", "SELECT 'game ' || s_suppkey AS event, CASE s_suppkey % 6 WHEN 0 THEN 'resignation' WHEN 1 THEN 'agreement' WHEN 2 THEN 'timeout' WHEN 3 THEN 'checkmate' WHEN 4 THEN 'stalemate' ELSE 'unterminated' END AS detail FROM supplier")
def result_detail(spark, sf_dir):
    """How a game ended, from its Termination header; the header itself where it says nothing known."""
    said = header("Termination", "unknown")
    found = reduce(lambda c, w: c.when(F.lower(said).contains(w[0]), w[1]), TERMINATIONS[1:], F.when(F.lower(said).contains(TERMINATIONS[0][0]), TERMINATIONS[0][1]))
    return pgn_rows(spark, sf_dir).select(header("Event").alias("event"), found.otherwise(said).alias("detail"))


@register("m19_game_title", """SELECT 'game ' || s_suppkey AS event, 'vs. Nation ' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ' (White, ' ELSE ' (Black, ' END
 || CASE WHEN s_suppkey % 6 IN (1, 4, 5) THEN 'Draw' WHEN (s_suppkey % 6 IN (0, 3)) = (s_suppkey % 2 = 0) THEN 'Won' ELSE 'Lost' END || ') — 2024.01.' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') AS title FROM supplier""")
def game_title(spark, sf_dir):
    """The title of a game as the supplier sees it who played it."""
    rows = pgn_rows(spark, sf_dir).select(header("Event").alias("event"), header("White", "?").alias("white"), header("Black", "?").alias("black"), header("Result", "*").alias("result"), header("Date", "????.??.??").alias("date"))
    user = F.when(F.col("white").startswith("Supplier"), F.col("white")).otherwise(F.col("black"))
    return rows.select("event", title(user).alias("title"))


def title(user) -> F.Column:
    """From columns white, black, result and date."""
    as_white, as_black = F.lower("white") == F.lower(user), F.lower("black") == F.lower(user)
    won = F.when(as_white, F.lit("1-0")).otherwise("0-1")
    outcome = F.when(F.col("result") == won, "Won").when(F.col("result").isin("1-0", "0-1"), "Lost").otherwise("Draw")
    whole = lambda other, colour, end: F.concat(F.lit("vs. "), other, F.lit(f" ({colour}, "), end, F.lit(") — "), F.col("date"))
    return F.when(as_white, whole(F.col("black"), "White", outcome)).when(as_black, whole(F.col("white"), "Black", outcome)).otherwise(whole(F.concat_ws(" vs ", "white", "black"), "?", F.col("result")))

def pgn_tokens(body: str) -> list[str]:
    """Words, comments in braces, and variations in parentheses, whatever these hold, of a game's moves."""
    out, i = [], 0
    while i < len(body):
        if body[i].isspace():
            i += 1
            continue
        start = i
        if body[i] == "{":
            i = body.find("}", i) + 1 or len(body)
        elif body[i] == "(":
            depth = 0
            while i < len(body):
                depth += {"(": 1, ")": -1}.get(body[i], 0)
                i += 1
                if not depth:
                    break
        else:
            while i < len(body) and not body[i].isspace() and body[i] not in "{(":
                i += 1
        out.append(body[start:i])
    return out


def annotated_text(pgn: str) -> str:
    """Moves with comments; a comment of more than 20 characters is preceded by the position. Variations stay as they stand."""
    out, p = [], Position()
    for token in pgn_tokens(re.sub(r"(?m)^\[.*\]$", "", pgn)):
        if token[0] == "{":
            text = re.sub(r"\s+", " ", re.sub(r"\[%[^\]]*\]", "", token.strip("{}"))).strip()
            out.append(f"[Position: {p.fen()}] {text}" if len(text) > 20 else text)
        elif token[0] == "(":
            out.append(token)
        else:
            try:
                m = p.parse_san(re.sub(r"^\d+\.+", "", token))
            except ValueError:
                continue
            out.append(p.san(m))
            p = p.push(m)
    return " ".join(x for x in out if x)
