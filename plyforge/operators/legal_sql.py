"""Legal moves as DuckDB SQL: the oracle of what the rules kernel answers, written from another side.

The kernel walks squares; here everything is a relation. ``geo`` has a row per square: jumps, the squares a pawn attacks,
and rays as lists. A ray's first piece is what is left of its text when leading dots are trimmed, so that an attack is a
test of texts. ``mv`` has every legal move of every position of the catalogue.
"""

from __future__ import annotations

from plyforge.functions.dialect import DUCK
from plyforge.sources.positions import MARK, POSITIONS_SQL

_IN = "{0} % 8 + x BETWEEN 0 AND 7 AND {0} // 8 + y BETWEEN 0 AND 7"


def _jump(steps: str) -> str:
    return f"(SELECT list((s // 8 + y) * 8 + s % 8 + x) FROM (VALUES {steps}) AS v(x, y) WHERE {_IN.format('s')})"


def _rays(steps: str) -> str:
    one = "list_transform(list_filter(range(1, 8), lambda k: s % 8 + k * x BETWEEN 0 AND 7 AND s // 8 + k * y BETWEEN 0 AND 7), lambda k: (s // 8 + k * y) * 8 + s % 8 + k * x)"
    return f"(SELECT list({one}) FROM (VALUES {steps}) AS v(x, y))"


_KNIGHT = ", ".join(f"({x}, {y})" for x in (-2, -1, 1, 2) for y in (-2, -1, 1, 2) if abs(x) != abs(y))
_KING = ", ".join(f"({x}, {y})" for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y)
GEO = f"""geo AS MATERIALIZED (SELECT s, coalesce({_jump(_KNIGHT)}, []) AS nd, {_jump(_KING)} AS kd, coalesce({_jump('(-1, 1), (1, 1)')}, []) AS wp, coalesce({_jump('(-1, -1), (1, -1)')}, []) AS bp,
 {_rays('(0, 1), (0, -1), (1, 0), (-1, 0)')} AS rook, {_rays('(1, 1), (1, -1), (-1, 1), (-1, -1)')} AS bish FROM range(0, 64) AS t(s))"""


def at(b: str, s: str) -> str:
    return f"substr({b}, ({s})::INTEGER + 1, 1)"


def _side(white: str, piece: str) -> str:
    return f"CASE WHEN {white} THEN '{piece.upper()}' ELSE '{piece}' END"


def _text(b: str, ray: str) -> str:
    return f"array_to_string(list_transform({ray}, lambda q: {at(b, 'q')}), '')"


def attacked(b: str, g: str, white: str) -> str:
    """Does that side attack the square of geo row ``g`` on board ``b``?"""
    jump = lambda dests, piece: f"len(list_filter({dests}, lambda t: {at(b, 't')} = {_side(white, piece)})) > 0"
    slide = lambda rays, piece: f"len(list_filter({rays}, lambda r: left(ltrim({_text(b, 'r')}, '.'), 1) IN ({_side(white, piece)}, {_side(white, 'q')}))) > 0"
    return f"({jump(f'{g}.nd', 'n')} OR {jump(f'{g}.kd', 'k')} OR {jump(f'CASE WHEN {white} THEN {g}.bp ELSE {g}.wp END', 'p')} OR {slide(f'{g}.rook', 'r')} OR {slide(f'{g}.bish', 'b')})"


def reached(b: str, g: str, piece: str) -> str:
    """Squares that a piece on the square of geo row ``g`` attacks."""
    seen = lambda rays: f"flatten(list_transform({rays}, lambda r: r[1:length({_text(b, 'r')}) - length(ltrim({_text(b, 'r')}, '.')) + 1]))"
    return f"CASE {piece} WHEN 'P' THEN {g}.wp WHEN 'p' THEN {g}.bp ELSE CASE lower({piece}) WHEN 'n' THEN {g}.nd WHEN 'k' THEN {g}.kd WHEN 'r' THEN {seen(f'{g}.rook')} WHEN 'b' THEN {seen(f'{g}.bish')} WHEN 'q' THEN list_concat({seen(f'{g}.rook')}, {seen(f'{g}.bish')}) END END"


def _put(b: str, s: str, c: str) -> str:
    return f"(left({b}, ({s})::INTEGER) || {c} || substr({b}, ({s})::INTEGER + 2))"


def name(s: str) -> str:
    return f"(substr('abcdefgh', (({s}) % 8 + 1)::INTEGER, 1) || (({s}) // 8 + 1))"


def moves(prefix: str, source: str) -> str:
    """CTEs up to ``{prefix}legal``: the legal moves of the rows (id, b, white, castling, ep number or null) of ``source``."""
    own = lambda c: f"({c} <> '.' AND (upper({c}) = {c}) = white)"
    foe = lambda c: f"({c} <> '.' AND (upper({c}) = {c}) <> white)"
    up, home = "CASE WHEN white THEN 8 ELSE -8 END", "CASE WHEN white THEN 4 ELSE 60 END"
    free = lambda a, z: " AND ".join(f"{at('b', f'home + {k}')} = '.'" for k in range(a, z + 1))
    safe = lambda k: f"NOT {attacked('b', f'g{k}', 'NOT white')}"
    castle = lambda flag, step, empties, through: f"""
 SELECT p.id, b, white, ep, home AS frm, {_side('white', 'k')} AS piece, home + {2 * step} AS dest, '' AS promo, 'castle' AS kind FROM (SELECT *, {home} AS home FROM {source}) p
 JOIN geo g0 ON g0.s = home JOIN geo g1 ON g1.s = home + {step}
 WHERE instr(castling, {_side('white', flag)}) > 0 AND {at('b', 'home')} = {_side('white', 'k')} AND {at('b', f"home + {3 if step > 0 else -4}")} = {_side('white', 'r')} AND {free(*empties)} AND {safe(0)} AND {safe(1)}"""  # noqa: E731
    return f"""
{prefix}own AS MATERIALIZED (SELECT p.*, s AS frm, {at('b', 's')} AS piece, nd, kd, wp, bp, rook, bish FROM {source} p JOIN geo ON {own(at('p.b', 's'))}),
{prefix}pseudo AS (
 SELECT id, b, white, ep, frm, piece, unnest(list_filter({reached('b', 'o', 'piece')}, lambda t: NOT {own(at('b', 't'))})) AS dest, '' AS promo, 'piece' AS kind FROM {prefix}own o WHERE lower(piece) <> 'p'
 UNION ALL SELECT id, b, white, ep, frm, piece, frm + up, '', 'push' FROM (SELECT *, {up} AS up FROM {prefix}own) WHERE lower(piece) = 'p' AND {at('b', 'frm + up')} = '.'
 UNION ALL SELECT id, b, white, ep, frm, piece, frm + 2 * up, '', 'double' FROM (SELECT *, {up} AS up FROM {prefix}own) WHERE lower(piece) = 'p' AND frm // 8 = CASE WHEN white THEN 1 ELSE 6 END AND {at('b', 'frm + up')} = '.' AND {at('b', 'frm + 2 * up')} = '.'
 UNION ALL SELECT id, b, white, ep, frm, piece, t, '', CASE WHEN {at('b', 't')} = '.' THEN 'ep' ELSE 'take' END FROM (SELECT *, unnest(CASE WHEN white THEN wp ELSE bp END) AS t FROM {prefix}own WHERE lower(piece) = 'p')
  WHERE {foe(at('b', 't'))} OR t = ep AND t // 8 = CASE WHEN white THEN 5 ELSE 2 END AND {at('b', 't')} = '.'
 UNION ALL {castle('k', 1, (1, 2), 1)}
 UNION ALL {castle('q', -1, (-3, -1), 1)}),
{prefix}full AS (
 SELECT id, b, white, frm, piece, dest, kind, promo FROM {prefix}pseudo WHERE NOT (lower(piece) = 'p' AND dest // 8 IN (0, 7))
 UNION ALL SELECT id, b, white, frm, piece, dest, kind, v.promo FROM {prefix}pseudo, (VALUES ('b'), ('n'), ('q'), ('r')) AS v(promo) WHERE lower(piece) = 'p' AND dest // 8 IN (0, 7)),
{prefix}moved AS (
 SELECT *, {name('frm')} || {name('dest')} || promo AS uci, {at('b', 'dest')} AS target,
  CASE kind WHEN 'ep' THEN {_put('a', 'dest - CASE WHEN white THEN 8 ELSE -8 END', "'.'")}
   WHEN 'castle' THEN CASE WHEN dest > frm THEN {_put(_put('a', 'dest + 1', "'.'"), 'dest - 1', _side('white', 'r'))} ELSE {_put(_put('a', 'dest - 2', "'.'"), 'dest + 1', _side('white', 'r'))} END
   ELSE a END AS after
 FROM (SELECT *, {_put(_put('b', 'frm', "'.'"), 'dest', "CASE WHEN promo = '' THEN piece WHEN white THEN upper(promo) ELSE promo END")} AS a FROM {prefix}full)),
{prefix}legal AS MATERIALIZED (SELECT m.*, kind IN ('ep', 'take') OR target <> '.' AS capture FROM {prefix}moved m JOIN geo g ON g.s = instr(after, {_side('white', 'k')}) - 1 WHERE NOT {attacked('after', 'g', 'NOT white')})"""


def _placement(b: str) -> str:
    rows = " || '/' || ".join(f"substr({b}, {r * 8 + 1}, 8)" for r in range(7, -1, -1))
    for n in range(8, 0, -1):
        rows = f"replace({rows}, '{'.' * n}', '{n}')"
    return rows


#: King or rook at home no more.
_RIGHTS = " || ".join(f"CASE WHEN instr(castling, '{c}') > 0 AND {at('nm.b', str(k))} = '{king}' AND {at('nm.b', str(r))} = '{rook}' AND frm NOT IN ({k}, {r}) AND dest NOT IN ({k}, {r}) THEN '{c}' ELSE '' END" for c, k, king, r, rook in (("K", 4, "K", 7, "R"), ("Q", 4, "K", 0, "R"), ("k", 60, "k", 63, "r"), ("q", 60, "k", 56, "r")))
_ORDER = "ORDER BY uci"

#: pos_ (one row per position of the catalogue, with its fields) and rows_ (pos_id, fen, pick).
ROWS_SQL = f"""pos_ AS MATERIALIZED (SELECT d.*, fen AS id, turn = 'w' AS white, CASE WHEN ep = '-' THEN NULL ELSE instr('abcdefgh', left(ep, 1)) - 1 + 8 * (substr(ep, 2, 1)::INTEGER - 1) END AS epn FROM {DUCK.decoded(f"(SELECT fen FROM {MARK})")} d),
rows_ AS (SELECT pos_id, fen, ('0x' || substr(md5(pos_id || ':pick'), 1, 8))::BIGINT % 1009 AS pick FROM ({POSITIONS_SQL}))"""

#: Also mv, a row per legal move: frm, dest, piece, target, uci, san, capture, chk, mate, after, fen_after,
#: hits (what the moved piece attacks then), rn (from 0, by uci) and n.
CTES = f"""{GEO}, {ROWS_SQL},
src_ AS (SELECT id, b, white, castling, epn AS ep FROM pos_), {moves('a_', 'src_')},
checked AS MATERIALIZED (SELECT m.*, {attacked('after', 'g', 'm.white')} AS chk FROM a_legal m JOIN geo g ON g.s = instr(after, {_side('NOT m.white', 'k')}) - 1),
next_ AS (SELECT id || ' ' || uci AS id, after AS b, NOT white AS white, '' AS castling, CASE WHEN kind = 'double' THEN (frm + dest) // 2 END AS ep FROM checked WHERE chk OR kind = 'double'), {moves('b_', 'next_')},
replies AS (SELECT id, count(*) AS replies, count(*) FILTER (kind = 'ep') AS eps FROM b_legal GROUP BY id),
named AS (SELECT c.*, coalesce(replies, 0) AS replies, coalesce(eps, 0) AS eps, chk AND coalesce(replies, 0) = 0 AS mate,
  list({{'f': frm % 8, 'r': frm // 8, 's': frm}}) OVER (PARTITION BY c.id, piece, dest) AS twins FROM checked c LEFT JOIN replies r ON r.id = c.id || ' ' || c.uci),
mv AS MATERIALIZED (
 SELECT x.id AS fen, x.b, x.white, frm, dest, piece, target, promo, kind, uci, capture, chk, mate, after, {reached('after', 'g', at('after', 'dest'))} AS hits,
  (row_number() OVER (PARTITION BY x.id {_ORDER})) - 1 AS rn, count(*) OVER (PARTITION BY x.id) AS n,
  CASE WHEN kind = 'castle' THEN CASE WHEN dest > frm THEN 'O-O' ELSE 'O-O-O' END
   WHEN lower(piece) = 'p' THEN CASE WHEN capture THEN left({name('frm')}, 1) || 'x' ELSE '' END || {name('dest')} || CASE WHEN promo = '' THEN '' ELSE '=' || upper(promo) END
   ELSE upper(piece) || CASE WHEN len(list_distinct(twins)) = 1 THEN '' WHEN len(list_filter(list_distinct(twins), lambda t: t.f = frm % 8)) = 1 THEN left({name('frm')}, 1)
     WHEN len(list_filter(list_distinct(twins), lambda t: t.r = frm // 8)) = 1 THEN right({name('frm')}, 1) ELSE {name('frm')} END || CASE WHEN capture THEN 'x' ELSE '' END || {name('dest')} END
   || CASE WHEN mate THEN '#' WHEN chk THEN '+' ELSE '' END AS san,
  {_placement('after')} || CASE WHEN x.white THEN ' b ' ELSE ' w ' END || CASE WHEN rights = '' THEN '-' ELSE rights END || ' ' || CASE WHEN eps > 0 THEN {name('(frm + dest) // 2')} ELSE '-' END || ' '
   || CASE WHEN capture OR lower(piece) = 'p' THEN 0 ELSE halfmove + 1 END || ' ' || (fullmove + CASE WHEN x.white THEN 0 ELSE 1 END) AS fen_after
 FROM (SELECT nm.*, halfmove, fullmove, {_RIGHTS} AS rights FROM named nm JOIN pos_ ON pos_.fen = nm.id) x JOIN geo g ON g.s = x.dest),
st_ AS MATERIALIZED (SELECT fen, n, in_check FROM (SELECT p.fen, count(uci) AS n FROM pos_ p LEFT JOIN mv ON mv.fen = p.fen GROUP BY p.fen) JOIN (SELECT fen, {attacked('b', 'g', 'NOT white')} AS in_check FROM pos_ JOIN geo g ON g.s = instr(b, {_side('white', 'k')}) - 1) USING (fen)),
ch AS (SELECT r.pos_id, r.pick, mv.* FROM rows_ r JOIN mv ON mv.fen = r.fen AND mv.rn = r.pick % mv.n)"""


def with_moves(sql: str) -> str:
    """``sql`` over pos_, mv (moves), st_ (n, in_check), rows_ (pos_id, fen, pick) and ch (the move a row picks, if any)."""
    return f"WITH {CTES} {sql}"
