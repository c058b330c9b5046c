"""Features and answers of a position, one expression each (see dialect)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.dialect import DUCK, SPARK, Dialect
from plyforge.operators.bitboards import bitboards, pawn_sets, settled
from plyforge.plans.registry import register
from plyforge.sources.positions import POSITIONS_SQL, positions

FEATURES: dict[str, dict[str, callable]] = {}


def feature(name: str, *, dealt: bool = False, **columns):
    """Query ``name``: pos_id and the columns, each a function of the dialect; ``dealt`` for what takes long over a row (see positions)."""
    FEATURES[name] = columns
    duck = f"SELECT pos_id, {', '.join(f'{f(DUCK)} AS {c}' for c, f in columns.items())} FROM {DUCK.decoded(f'({POSITIONS_SQL})')}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply(positions(spark, sf_dir, dealt), columns)

    register(name, duck)(run)


def decoded(df: DataFrame) -> DataFrame:
    """``df`` (with a column fen) plus placement, turn, castling, ep, halfmove, fullmove and the board ``b``."""
    rows = df.sparkSession.sql(f"SELECT * FROM {SPARK.board('{df}')}", df=df).drop("f").withColumnRenamed("b", "b_")
    # The board is made once a row: within a lambda it would be made again for every square.
    rows = settled(rows, b=F.col("b_")).drop("b_")
    return rows.selectExpr("*", f"{SPARK._where('P')} AS wp", f"{SPARK._where('p')} AS bp")


def context(df: DataFrame) -> DataFrame:
    """``df`` (decoded and with bitboards) plus the sets that pawn structure and kings are told from."""
    return settled(df, **pawn_sets())


def apply(df: DataFrame, columns) -> DataFrame:
    texts, rows = {c: f(SPARK) for c, f in columns.items()}, decoded(df)
    if any("m_" in t or "s_w" in t or "s_b" in t for t in texts.values()):
        rows = context(bitboards(rows))
    if any("n_" in t for t in texts.values()):
        rows = inventory(bitboards(rows))
    return rows.selectExpr("pos_id", *(f"{t} AS {c}" for c, t in texts.items()))


@lru_cache(1)
def _rank_names() -> str:
    """Of each rank, the names of the squares of every set of its eight, each name with ', ' behind it."""
    return "|".join("".join(f"{'abcdefgh'[f]}{r + 1}, " for f in range(8) if byte >> f & 1) for r in range(8) for byte in range(256))


def inventory(df: DataFrame) -> DataFrame:
    """``df`` (with bitboards) plus, of each kind of piece, the names of its squares in order as one text (``n_wp`` ...).

    Names are looked up a rank at a time: a lambda over eight ranks, and nothing unrolled that is too long to be compiled.
    """
    table = F.split(F.lit(_rank_names()), "[|]")
    shifted = lambda mask, r: F.call_function("shiftrightunsigned", mask, 8 * r).bitwiseAND(255).cast("int")
    text = lambda mask: F.array_join(F.transform(F.array(*map(F.lit, range(8))), lambda r: F.get(table, 256 * r + shifted(mask, r))), "")
    return df.withColumns({f"n_{c}{k}": F.rtrim(text(F.col(f"s_{c}{k}")), F.lit(", ")) for c in "wb" for k in "kqrbnp"})


# Structure is told by sets of bits in Spark and by lists of squares in DuckDB: two ways to one answer.


def on_set(mask: str) -> str:
    """The squares of a set, ascending."""
    return f"CASE WHEN {mask} = 0 THEN array() ELSE filter(sequence(0, 63), z0 -> getbit({mask}, z0) = 1) END"


def on_files(mask: str) -> str:
    """The letters of a set of files."""
    return f"CASE WHEN {mask} = 0 THEN array() ELSE transform(filter(sequence(0, 7), z0 -> getbit({mask}, z0) = 1), z0 -> substr('abcdefgh', z0 + 1, 1)) END"


def colour_of(white: bool) -> str:
    return "w" if white else "b"


def side(d: Dialect, white: bool, pieces: str) -> str:
    return pieces.upper() if white else pieces.lower()


def names(d: Dialect, squares: str) -> str:
    return d.map(squares, "q", d.name("q"))


def picked(salt: str, n: int):
    """A number below n that depends on the position's key alone."""
    def sql(d: Dialect) -> str:
        key = f"md5(cast(pos_id as string) || ':{salt}')"
        return f"cast(conv(substr({key}, 1, 8), 16, 10) as bigint) % {n}" if d.spark else f"('0x' || substr({key}, 1, 8))::BIGINT % {n}"
    return sql


def square(salt: str):
    return lambda d: d.int(picked(salt, 64)(d))


def letter_at(d, s):
    return f"CASE WHEN {d.at(s)} = '.' THEN 'empty' ELSE {d.at(s)} END"


def full_name_at(d, s):
    return f"CASE WHEN {d.at(s)} = '.' THEN 'empty' ELSE {d.colour(d.at(s))} || ' ' || {d.piece_name(d.at(s))} END"


def or_none(d, text, word="none"):
    return f"CASE WHEN {text} = '' THEN '{word}' ELSE {text} END"


def line_contents(d: Dialect, squares: str, style: int) -> str:
    held = d.filter(squares, "s", f"{d.at('s')} <> '.'")
    one = (
        f"{d.colour(d.at('s'))} || ' ' || {d.piece_name(d.at('s'))} || ' on ' || {d.name('s')}",
        f"{d.at('s')} || ':' || {d.name('s')}",
        f"{d.name('s')} || '(' || {d.piece_name(d.at('s'))} || ',' || {d.colour(d.at('s'))} || ')'",
    )[style]
    return or_none(d, d.join(d.map(held, "s", one), ", "), "empty")


def rank_squares(d, salt):
    r = f"({d.int(picked(salt, 8)(d))} * 8)"
    return d.seq(r, f"{r} + 8")


def file_squares(d, salt):
    f = d.int(picked(salt, 8)(d))
    return d.map(d.seq(0, 8), "r", f"r * 8 + {f}")


# Castling rights count only with king and rook on their home squares.
RIGHTS = (("K", 4, "K", 7, "R", "White O-O", "white can castle kingside"), ("Q", 4, "K", 0, "R", "White O-O-O", "white can castle queenside"), ("k", 60, "k", 63, "r", "Black O-O", "black can castle kingside"), ("q", 60, "k", 56, "r", "Black O-O-O", "black can castle queenside"))


def has_right(d, right):
    flag, king_at, king, rook_at, rook = right[:5]
    return f"(instr(castling, '{flag}') > 0 AND {d.at(king_at)} = '{king}' AND {d.at(rook_at)} = '{rook}')"


def rights(d: Dialect, which: int, sep: str) -> str:
    items = d.array(*(f"CASE WHEN {has_right(d, r)} THEN '{r[0] if which == 0 else r[which]}' ELSE '' END" for r in RIGHTS))
    return d.join(d.filter(items, "x", "x <> ''"), sep)


def pawns_on(d, white, f):
    return f"{d.size(d.filter(d.where(side(d, white, 'p')), 'p2', f'p2 % 8 = {f}'))}"


def doubled(white):
    return lambda d: on_files(f"m_doubled_{colour_of(white)}") if d.spark else d.map(d.filter(d.seq(0, 8), "f", f"{pawns_on(d, white, 'f')} >= 2"), "f", "substr('abcdefgh', f + 1, 1)")


def isolated(d, white):
    if d.spark:
        return on_set(f"m_isolated_{colour_of(white)}")
    own = side(d, white, "p")
    return d.filter(d.where(own), "s", f"NOT ({d.any(d.where(own, 't'), 't', 'abs(t % 8 - s % 8) = 1')})")


def passed(d, white):
    if d.spark:
        return on_set(f"m_passed_{colour_of(white)}")
    own, enemy = side(d, white, "p"), side(d, not white, "p")
    ahead = f"{d.rank('t')} {'>' if white else '<'} {d.rank('s')}"
    return d.filter(d.where(own), "s", f"NOT ({d.any(d.where(enemy, 't'), 't', f'abs(t % 8 - s % 8) <= 1 AND {ahead}')})")


def open_files(d, kind):
    if d.spark:
        return on_files("m_open" if kind == "open" else f"m_half_{kind[0]}")
    w, b = pawns_on(d, True, "f"), pawns_on(d, False, "f")
    test = {"open": f"{w} = 0 AND {b} = 0", "white": f"{w} = 0 AND {b} > 0", "black": f"{b} = 0 AND {w} > 0"}[kind]
    return d.map(d.filter(d.seq(0, 8), "f", test), "f", "substr('abcdefgh', f + 1, 1)")


def text(array):
    return lambda d: d.join(array(d), ",")


def king(d, white):
    return f"(instr(b, '{side(d, white, 'k')}') - 1)"


def shield(white):
    def sql(d):
        if d.spark:
            return f"bit_count(m_shield_{colour_of(white)})"
        k, step = king(d, white), 1 if white else -1
        near = d.filter(d.where(side(d, white, "p")), "s", f"abs(s % 8 - {k} % 8) <= 1 AND {d.rank('s')} = {d.rank(k)} + {step}")
        return f"CASE WHEN {k} < 0 THEN 0 ELSE {d.size(near)} END"
    return sql


def open_near_king(white):
    def sql(d):
        if d.spark:
            return d.join(on_files(f"m_near_{colour_of(white)}"), ",")
        k = king(d, white)
        own, other = pawns_on(d, white, "f"), pawns_on(d, not white, "f")
        free = f"abs(f - {k} % 8) <= 1 AND {own} = 0 AND ({other} >= 0)"
        return d.join(d.map(d.filter(d.seq(0, 8), "f", f"{k} >= 0 AND {free}"), "f", "substr('abcdefgh', f + 1, 1)"), ",")
    return sql


def heavy(d):
    return f"({d.material(True)} + {d.material(False)} - {d.count('P')} - {d.count('p')})"


def phase(d):
    return f"CASE WHEN {heavy(d)} > 48 THEN 'Opening' WHEN {heavy(d)} > 20 THEN 'Middlegame' ELSE 'Endgame' END"


def balance(d):
    return f"({d.material(True)} - {d.material(False)})"


def better(d):
    return f"CASE WHEN {balance(d)} > 0 THEN 'white' WHEN {balance(d)} < 0 THEN 'black' ELSE 'equal' END"


def signed(d):
    return f"CASE WHEN {balance(d)} > 0 THEN '+' || cast({balance(d)} as string) ELSE cast({balance(d)} as string) END"


def by_piece(d, white, style):
    """The inventory of a side: K, Q, R, B, N, P with their squares."""
    out = []
    for p, name in zip("kqrbnp", ("king", "queen", "rook", "bishop", "knight", "pawn"), strict=True):
        letter = side(d, white, p)
        if d.spark:
            text = f"n_{colour_of(white)}{p}"
            listed = f"CASE WHEN length({text}) > 2 THEN array_join(sort_array(split({text}, ', ')), ', ') ELSE {text} END" if style == 0 else text
            out.append(f"CASE WHEN {text} = '' THEN '' ELSE '{name}: ' || " + (f"cast((length({text}) + 2) div 4 as string)" if style == 2 else listed) + " END")
            continue
        where = names(d, d.where(letter))
        listed = d.join(d.sort(where) if style == 0 else where, ", ")
        out.append(f"CASE WHEN {d.count(letter)} = 0 THEN '' ELSE '{name}: ' || " + (f"cast({d.count(letter)} as string)" if style == 2 else listed) + " END")
    return d.join(d.filter(d.array(*out), "x", "x <> ''"), "; ")


def ascii_board(d, flip=False):
    ranks = d.seq(0, 8) if flip else d.reverse(d.seq(0, 8))
    # Lambdas are not compiled: in Spark they go over ranks, and squares are told within a function of a whole rank.
    row = "array_join(split(substr(b, r * 8 + 1, 8), ''), ' ')" if d.spark else d.join(d.map(d.seq(0, 8), "f", "substr(b, r * 8 + f + 1, 1)"), " ")
    return d.join(d.map(ranks, "r", f"cast(r + 1 as string) || ' ' || {row}"), "|")


def material_diff(d):
    parts = []
    for p in "QRBNP":
        n = f"({d.count(p)} - {d.count(p.lower())})"
        parts.append(f"CASE WHEN {n} > 0 THEN 'white +' || cast({n} as string) || '{p}' WHEN {n} < 0 THEN 'black +' || cast(-{n} as string) || '{p}' ELSE '' END")
    return f"'material: ' || {or_none(d, d.join(d.filter(d.array(*parts), 'x', f"x <> ''"), ', '), 'equal')}"


def labels(d):
    if d.spark:
        return d.map("split(b, '')", "c", "instr('PNBRQKpnbrqk', c)")
    return d.map(d.seq(0, 64), "s", "instr('PNBRQKpnbrqk', substr(b, s + 1, 1))")


def file_kind(d, s):
    w, b = pawns_on(d, True, f"({s} % 8)"), pawns_on(d, False, f"({s} % 8)")
    return f"CASE WHEN {w} = 0 AND {b} = 0 THEN 'open' WHEN {w} = 0 OR {b} = 0 THEN 'half-open' ELSE 'closed' END"


def nearest_pawn(d, s):
    away = d.map(d.filter(d.where("Pp", "p"), "p", f"p % 8 = {s} % 8 AND p <> {s}"), "p", f"abs({d.rank('p')} - {d.rank(s)}) * 64 + p")
    return d.get(d.sort(away), 0) + " % 64"


def outpost(d, white, s):
    enemy = d.where(side(d, not white, "p"), "t")
    own = d.where(side(d, white, "p"), "t")
    beyond = f"abs(t % 8 - {s} % 8) = 1 AND {d.rank('t')} {'>' if white else '<'} {d.rank(s)}"
    behind = f"abs(t % 8 - {s} % 8) = 1 AND {d.rank('t')} = {d.rank(s)} {'-' if white else '+'} 1"
    return f"(NOT ({d.any(enemy, 't', beyond)}) AND ({d.any(own, 't', behind)}))"


def html(d):
    if d.spark:
        dark, light = ("".join(f'<td class="{c}">${n}</td>' for n, c in enumerate(x, 1)) for x in ("dl", "ld"))
        row = f"regexp_replace(substr(b, r * 8 + 1, 8), '(.)(.)', CASE WHEN r % 2 = 0 THEN '{dark}' ELSE '{light}' END)"
        return f"replace('<table>' || {d.join(d.map(d.reverse(d.seq(0, 8)), 'r', f"'<tr>' || {row} || '</tr>'"), '')} || '</table>', '.', '&nbsp;')"
    cell = f"'<td class=\"' || CASE WHEN (r + f) % 2 = 0 THEN 'd' ELSE 'l' END || '\">' || replace(substr(b, r * 8 + f + 1, 1), '.', '&nbsp;') || '</td>'"
    return f"'<table>' || {d.join(d.map(d.reverse(d.seq(0, 8)), 'r', f"'<tr>' || {d.join(d.map(d.seq(0, 8), 'f', cell), '')} || '</tr>'"), '')} || '</table>'"


def most_advanced(d, white):
    squares = passed(d, white)
    key = d.map(squares, "z", f"({d.rank('z')} * 64 + 63 - z)" if white else f"((7 - {d.rank('z')}) * 64 + 63 - z)")
    top = d.get(d.reverse(d.sort(key)), 0)
    return f"coalesce({d.name(f'(63 - {top} % 64)')}, 'none')"


def tensor_planes(d):
    """Ones per plane of the 12 piece planes, the turn, four rights, the en-passant file, and the move number's share."""
    return d.array(*(f"cast({d.count(p)} as double)" for p in "PNBRQKpnbrqk"), "CASE WHEN turn = 'w' THEN cast(64 as double) ELSE cast(0 as double) END", *(f"CASE WHEN {has_right(d, r)} THEN cast(64 as double) ELSE cast(0 as double) END" for r in RIGHTS), "CASE WHEN ep <> '-' THEN cast(8 as double) ELSE cast(0 as double) END", "least(fullmove / 200.0, 1.0) * cast(64 as double)")


W, B = True, False
s1 = square("sq")
feature("q01_piece_abbr_at", square=lambda d: d.name(s1(d)), answer=lambda d: letter_at(d, s1(d)))
feature("q02_piece_name_at", square=lambda d: d.name(s1(d)), answer=lambda d: full_name_at(d, s1(d)))
feature("q03_side_to_move", answer=lambda d: "CASE WHEN turn = 'w' THEN 'white' ELSE 'black' END")
feature("q04_rank_contents", **{f"style{k}": (lambda d, k=k: line_contents(d, rank_squares(d, "rank"), k)) for k in range(3)})
feature("q05_file_contents", **{f"style{k}": (lambda d, k=k: line_contents(d, file_squares(d, "file"), k)) for k in range(3)})
feature("q06_castling_rights", moves=lambda d: or_none(d, rights(d, 5, ", ")), fen=lambda d: or_none(d, rights(d, 0, ""), "-"), prose=lambda d: or_none(d, rights(d, 6, ", ")))
feature("q07_en_passant", answer=lambda d: "CASE WHEN ep = '-' THEN 'none' ELSE ep END")
feature("q08_move_number", answer=lambda d: "cast(fullmove as string)")
feature("q09_count_piece_type", **{f"n_{p if p.islower() else 'w' + p}".lower(): (lambda d, p=p: d.count(p)) for p in "PNBRQpnbrq"})
feature("q10_count_total_material", white=lambda d: d.size(d.where("PNBRQK")), black=lambda d: d.size(d.where("pnbrqk")))
feature("q11_find_piece_type", white_knights=lambda d: or_none(d, d.join(names(d, d.where("N")), ", ")), black_pawns=lambda d: or_none(d, d.join(names(d, d.where("p")), ", ")))
feature("q12_is_square_occupied", answer=lambda d: f"CASE WHEN {d.at(s1(d))} = '.' THEN 'no' ELSE 'yes' END")
feature("q17_material_balance", answer=signed)
feature("q18_who_is_better", answer=better)
feature("q26_doubled_pawns", white=lambda d: or_none(d, text(doubled(W))(d)), black=lambda d: or_none(d, text(doubled(B))(d)))
feature("q27_isolated_pawn_at", white=lambda d: or_none(d, d.join(names(d, isolated(d, W)), ",")), black=lambda d: or_none(d, d.join(names(d, isolated(d, B)), ",")))
feature("q28_passed_pawn", white=lambda d: most_advanced(d, W), black=lambda d: most_advanced(d, B))
feature("q30_board_inventory", dealt=True, **{f"{c}{k}": (lambda d, w=w, k=k: by_piece(d, w, k)) for c, w in (("white", W), ("black", B)) for k in range(3)})
feature("q31_notation_choice", notation=lambda d: f"CASE WHEN {picked('notation', 2)(d)} = 0 THEN 'SAN' ELSE 'UCI' END")
feature("q35_piece_at", answer=lambda d: full_name_at(d, square("piece")(d)))
feature("q36_count_pieces", white=lambda d: d.size(d.where("PNBRQK")), black=lambda d: d.size(d.where("pnbrqk")))
feature("q37_piece_positions", white_pawns=lambda d: or_none(d, d.join(d.sort(names(d, d.where("P"))), ",")), black_rooks=lambda d: or_none(d, d.join(d.sort(names(d, d.where("r"))), ",")))
feature("q39_material_count", answer=lambda d: f"'white: ' || cast({d.material(W)} as string) || ', black: ' || cast({d.material(B)} as string)")
feature("q40_describe_pieces", white=lambda d: by_piece(d, W, 1), black=lambda d: by_piece(d, B, 1))
feature("p01_tensor_planes", planes=tensor_planes)
feature("p02_piece_labels", dealt=True, labels=labels)
feature("p03_ascii_board", dealt=True, board=ascii_board, flipped=lambda d: ascii_board(d, True))
feature("p04_prompt_board", dealt=True, board=lambda d: f"{ascii_board(d)} || '|  a b c d e f g h (' || CASE WHEN turn = 'w' THEN 'White' ELSE 'Black' END || ' to move)'")
feature("p05_piece_squares", pieces=lambda d: d.join(d.concat(*(d.map(d.where(p), "s", f"'{p}' || {d.name('s')}") for p in "KQRBNPkqrbnp")), " "))
feature("p06_representations", dealt=True, placement=lambda d: "placement", turn=lambda d: "turn", ep=lambda d: "ep", halfmove=lambda d: "halfmove", fullmove=lambda d: "fullmove", board=ascii_board)
feature("p07_llm_text", text=lambda d: f"'Castling: ' || {or_none(d, rights(d, 5, ', '))} || '; en passant: ' || ep || '; white ' || {by_piece(d, W, 1)} || '; black ' || {by_piece(d, B, 1)}")
feature("p09_game_phase", phase=phase, heavy=heavy)
feature("p10_passed_pawns", white=lambda d: names(d, passed(d, W)), black=lambda d: names(d, passed(d, B)))
feature("p11_doubled_files", white=doubled(W), black=doubled(B))
feature("p12_isolated_pawns", white=lambda d: names(d, isolated(d, W)), black=lambda d: names(d, isolated(d, B)))
feature("p13_open_files", **{f"{k}_files": (lambda d, k=k: open_files(d, k)) for k in ("open", "white", "black")})
feature("p15_king_shield", white=shield(W), black=shield(B), near_white=open_near_king(W), near_black=open_near_king(B))
feature("p19_pawn_flags", pawns=lambda d: d.map(d.where("Pp", "z"), "z", f"{d.name('z')} || ':' || cast({d.size(d.filter(d.where('Pp', 'y'), 'y', f'y % 8 = z % 8 AND {d.at("y")} = {d.at("z")}'))} as string)"))
feature("p21_file_rank_type", file=lambda d: file_kind(d, s1(d)), rank=lambda d: f"CASE {d.rank(s1(d))} WHEN 0 THEN 'back' WHEN 7 THEN 'back' WHEN 1 THEN 'second' WHEN 6 THEN 'second' ELSE 'middle' END")
feature("p22_nearest_pawn", square=lambda d: d.int(nearest_pawn(d, s1(d))))
feature("p23_outpost", white=lambda d: outpost(d, W, s1(d)), black=lambda d: outpost(d, B, s1(d)))
feature("p26_material_diff", text=material_diff)
feature("p28_board_json", placement=lambda d: "placement", fen=lambda d: "placement || ' ' || turn || ' ' || castling || ' ' || ep || ' ' || cast(halfmove as string) || ' ' || cast(fullmove as string)")
feature("p29_board_html", dealt=True, html=html)
CONTEXT = {
    "game_phase": phase, "move_number": lambda d: "fullmove", "material_white": lambda d: d.material(W), "material_black": lambda d: d.material(B), "material_balance": balance,
    "passed_white": lambda d: d.join(names(d, passed(d, W)), ","), "passed_black": lambda d: d.join(names(d, passed(d, B)), ","),
    "doubled_white": text(doubled(W)), "doubled_black": text(doubled(B)),
    "isolated_white": lambda d: d.join(names(d, isolated(d, W)), ","), "isolated_black": lambda d: d.join(names(d, isolated(d, B)), ","),
    "open_files": lambda d: d.join(open_files(d, "open"), ","), "half_open_white": lambda d: d.join(open_files(d, "white"), ","), "half_open_black": lambda d: d.join(open_files(d, "black"), ","),
    "shield_white": shield(W), "shield_black": shield(B), "open_near_white": open_near_king(W), "open_near_black": open_near_king(B),
}
feature("q_material_context", **CONTEXT)
feature("p17_context_text", text=lambda d: f"'Phase: ' || {phase(d)} || '. Material: ' || {signed(d)} || '. White passed: ' || {or_none(d, CONTEXT['passed_white'](d))} || '. Open files: ' || {or_none(d, CONTEXT['open_files'](d))} || '.'")
