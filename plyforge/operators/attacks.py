"""Attacks as sets of squares in one long: bit 0 is a1, bit 63 is h8.

A side's rays of one direction are filled by shifts for all its pieces at once; rays of one direction never share a square,
as each ends at the next piece. Everything about a position is arithmetic on its own row: no join, no shuffle, and rows are
exploded only where the answer has a row a piece or square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.dialect import DUCK, SPARK
from plyforge.operators.bitboards import _RAYS, _STEPS, _long, _name, bitboards, each, either, leaps, moved, ray, settled, spread
from plyforge.operators.features import CONTEXT, context, decoded, square
from plyforge.plans.registry import register
from plyforge.sources.positions import POSITIONS_SQL, positions

def kind(letter: str) -> Column:
    return F.col(_name(letter))


def sliders(white: bool, line: str) -> Column:
    """Rooks (bishops) and queens of a side."""
    case = str.upper if white else str.lower
    return kind(case(line)).bitwiseOR(kind(case("q")))


def pawn_attacks(x: Column, white: bool) -> Column:
    return moved(x, -1, 1 if white else -1).bitwiseOR(moved(x, 1, 1 if white else -1))


def attacked(white: bool) -> Column:
    """All squares that a side attacks."""
    case = str.upper if white else str.lower
    rays = [ray(sliders(white, line), F.col("free"), dx, dy) for line in "br" for dx, dy in _RAYS[line]]
    return either([pawn_attacks(kind(case("p")), white), leaps(kind(case("n")), "n"), leaps(kind(case("k")), "k"), *rays])


def attackers(at: Column, white: bool) -> Column:
    """Of a side, the pieces that attack the square of the one-bit set ``at``: what is seen from there as the piece sees."""
    case = str.upper if white else str.lower
    out = [pawn_attacks(at, not white).bitwiseAND(kind(case("p"))), leaps(at, "n").bitwiseAND(kind(case("n"))), leaps(at, "k").bitwiseAND(kind(case("k")))]
    return either(out + [either(ray(at, F.col("free"), dx, dy) for dx, dy in _RAYS[line]).bitwiseAND(sliders(white, line)) for line in "br"])


def reach_of(at: Column, piece: Column) -> Column:
    """What the piece on the square of the one-bit set ``at`` attacks."""
    rays = {line: either(ray(at, F.col("free"), dx, dy) for dx, dy in _RAYS[line]) for line in "br"}
    low = F.lower(piece)
    return (
        F.when(piece == "P", pawn_attacks(at, True)).when(piece == "p", pawn_attacks(at, False)).when(low == "n", leaps(at, "n")).when(low == "k", leaps(at, "k"))
        .when(low == "b", rays["b"]).when(low == "r", rays["r"]).otherwise(rays["b"].bitwiseOR(rays["r"]))
    )


def squares(mask: Column) -> Column:
    """The numbers of a set's squares, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda s: F.getbit(mask, s) == 1)


def square_name(s: Column) -> Column:
    return F.concat(F.substring(F.lit("abcdefgh"), s % 8 + 1, F.lit(1)), (F.shiftright(s, 3) + 1).cast("string"))


def names(mask: Column) -> Column:
    return F.transform(squares(mask), square_name)


def bit(s: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), s)


def pieces(df: DataFrame) -> DataFrame:
    """A row per piece: the columns of ``df`` (with bitboards), sq, piece, white, ``at`` (its square as a set)."""
    rows = spread(settled(df, taken=F.bitwise_not("free")), "sq", "taken").withColumn("piece", F.expr(SPARK.at("sq")))
    return rows.withColumn("white", F.col("piece") == F.upper("piece")).withColumn("at", bit(F.col("sq")))


#: Directions of bishops, then of rooks, by number.
_WAYS = [way for line in "br" for way in _RAYS[line]]


def _line_table() -> Column:
    """Of each direction and square (64 * direction + square), the squares of an empty board that are seen that way, as a set."""
    inside = lambda x, y: 0 <= x < 8 and 0 <= y < 8
    seen = lambda s, dx, dy: [(s // 8 + k * dy) * 8 + s % 8 + k * dx for k in range(1, 8) if inside(s % 8 + k * dx, s // 8 + k * dy)]
    return F.array(*(_long(sum(1 << t for t in seen(s, dx, dy))) for dx, dy in _WAYS for s in range(64)))


def nearest(line: Column, way: Column) -> Column:
    """Of a set on a line that begins before it, the first square that way: its lowest where numbers rise, else its highest."""
    rising = [i for i, (dx, dy) in enumerate(_WAYS) if 8 * dy + dx > 0]
    # Without h8, as its bit alone has no number below it.
    low = line.bitwiseAND(_long((1 << 63) - 1))
    return F.when(way.isin(*rising), F.least(F.bit_count(low.bitwiseAND(-low) - 1), F.lit(63))).otherwise(F.length(F.bin(line)) - 1).cast("int")


# The same in DuckDB, by arithmetic on squares a row each.
_SQL_STEPS = ", ".join(f"('{k}', {x}, {y}, 1)" for k, steps in _STEPS.items() for x, y in steps)
_SQL_RAYS = ", ".join(f"('{k}', {x}, {y}, 7)" for k, rays in _RAYS.items() for x, y in rays)
ATTACKS_SQL = f"""
pos AS (SELECT * FROM {DUCK.decoded(f"({POSITIONS_SQL})")}),
sq AS (SELECT *, s AS sq, substr(b, s + 1, 1) AS piece FROM pos, range(0, 64) AS t(s) WHERE substr(b, s + 1, 1) <> '.'),
moves(kind, dx, dy, far) AS (VALUES ('P', -1, 1, 1), ('P', 1, 1, 1), ('p', -1, -1, 1), ('p', 1, -1, 1), {_SQL_STEPS}, {_SQL_RAYS}),
seen AS (
  SELECT pos_id, b, turn, sq.sq, piece, upper(piece) = piece AS white, k, dx, dy, (sq.sq // 8 + k * dy) * 8 + sq.sq % 8 + k * dx AS dest,
         len(list_filter(range(1, k), lambda j: substr(b, ((sq.sq // 8 + j * dy) * 8 + sq.sq % 8 + j * dx + 1)::INTEGER, 1) <> '.')) AS blockers
  FROM sq JOIN moves ON kind = CASE WHEN lower(piece) = 'p' THEN piece ELSE lower(piece) END, range(1, 8) AS r(k)
  WHERE k <= far AND sq.sq % 8 + k * dx BETWEEN 0 AND 7 AND sq.sq // 8 + k * dy BETWEEN 0 AND 7),
attacks AS (SELECT *, substr(b, dest::INTEGER + 1, 1) AS target FROM seen WHERE blockers = 0)"""

_NAME = "substr('abcdefgh', ({0} % 8 + 1)::INTEGER, 1) || ({0} // 8 + 1)"


def duck_name(s: str) -> str:
    return _NAME.format(s)


def attack_query(key: str, oracle: str, dealt: bool = False):
    def put(fn):
        def run(spark, sf_dir):
            return fn(bitboards(decoded(positions(spark, sf_dir, dealt))))

        register(key, f"WITH {ATTACKS_SQL} {oracle}")(run)
        return fn

    return put


def listed(mask: Column, empty: str = "none") -> Column:
    text = F.array_join(names(mask), ",")
    return F.when(mask == 0, empty).otherwise(text)


@attack_query("j08_ray_join", "SELECT pos_id, sq::INTEGER AS sq, piece, dest::INTEGER AS dest, target FROM attacks")
def ray_join(df):
    """A row per piece and square that it attacks."""
    rows = spread(settled(pieces(df), hit=reach_of(F.col("at"), F.col("piece"))), "dest", "hit")
    return rows.select("pos_id", "sq", "piece", "dest", F.expr(SPARK.at("dest")).alias("target"))


@attack_query("q13_attackers_at", f"""
SELECT p.pos_id, coalesce(string_agg(a.piece || ' on ' || {duck_name('a.sq')}, ',' ORDER BY a.sq), 'none') AS white_attackers
FROM pos p LEFT JOIN attacks a ON a.pos_id = p.pos_id AND a.white AND a.dest = ('0x' || substr(md5(p.pos_id || ':sq'), 1, 8))::BIGINT % 64
GROUP BY p.pos_id""")
def attackers_at(df):
    rows = settled(df, hit=attackers(bit(F.expr(square("sq")(SPARK))), True))
    each = F.transform(squares(F.col("hit")), lambda s: F.concat(F.substring(F.col("b"), s + 1, F.lit(1)), F.lit(" on "), square_name(s)))
    return rows.select("pos_id", F.when(F.col("hit") == 0, "none").otherwise(F.array_join(each, ",")).alias("white_attackers"))


@attack_query("q14_is_pinned", f"""
SELECT p.pos_id, coalesce(string_agg(DISTINCT {duck_name('x.mid')}, ',' ORDER BY {duck_name('x.mid')}), 'none') AS pinned
FROM pos p LEFT JOIN (
  SELECT pos_id, list_filter(list_transform(range(1, k), lambda j: ((sq // 8 + j * dy) * 8 + sq % 8 + j * dx)::INTEGER), lambda t: substr(b, t + 1, 1) <> '.')[1] AS mid, b, white
  FROM seen WHERE blockers = 1 AND lower(piece) IN ('b', 'r', 'q') AND substr(b, dest::INTEGER + 1, 1) = CASE WHEN white THEN 'k' ELSE 'K' END) x
  ON x.pos_id = p.pos_id AND (upper(substr(x.b, x.mid + 1, 1)) = substr(x.b, x.mid + 1, 1)) <> x.white
GROUP BY p.pos_id""")
def pinned(df):
    """Pieces of either side that alone stand between an enemy slider and their king."""
    lines = [(white, line, dx, dy) for white in (True, False) for line in "br" for dx, dy in _RAYS[line]]
    first = {f"first{i}": ray(kind("K" if white else "k"), F.col("free"), dx, dy).bitwiseAND(F.col("s_white" if white else "s_black")) for i, (white, _, dx, dy) in enumerate(lines)}
    rows, none = settled(df, **first), F.lit(0).cast("long")
    held = [F.when(ray(F.col(f"first{i}"), F.col("free"), dx, dy).bitwiseAND(sliders(not white, line)) != 0, F.col(f"first{i}")).otherwise(none) for i, (white, line, dx, dy) in enumerate(lines)]
    rows = settled(rows, held=either(held))
    return rows.select("pos_id", F.when(F.col("held") == 0, "none").otherwise(F.array_join(F.array_sort(names(F.col("held"))), ",")).alias("pinned"))


@attack_query("q15_mobility_at", "SELECT pos_id, sq::INTEGER AS sq, piece, count(*) AS squares FROM attacks GROUP BY ALL")
def mobility_at(df):
    rows = settled(pieces(df), squares=F.bit_count(reach_of(F.col("at"), F.col("piece"))).cast("long"))
    return rows.where("squares > 0").select("pos_id", "sq", "piece", "squares")


@attack_query("q16_is_check", "SELECT p.pos_id, CASE WHEN count(a.sq) > 0 THEN 'yes' ELSE 'no' END AS answer FROM pos p LEFT JOIN attacks a ON a.pos_id = p.pos_id AND a.target = CASE WHEN p.turn = 'w' THEN 'K' ELSE 'k' END AND a.white = (p.turn = 'b') GROUP BY p.pos_id")
def is_check(df):
    return df.select("pos_id", F.when(checkers() != 0, "yes").otherwise("no").alias("answer"))


def checkers() -> Column:
    """Pieces that give check to the side to move."""
    return F.when(F.col("turn") == "w", attackers(kind("K"), False)).otherwise(attackers(kind("k"), True))


@attack_query("q34_in_check", f"SELECT pos_id, string_agg({duck_name('sq')}, ',' ORDER BY {duck_name('sq')}) AS checkers FROM attacks WHERE target = CASE WHEN turn = 'w' THEN 'K' ELSE 'k' END AND white = (turn = 'b') GROUP BY pos_id")
def in_check(df):
    rows = settled(df, checkers=checkers()).where("checkers <> 0")
    return rows.select("pos_id", F.array_join(F.array_sort(names(F.col("checkers"))), ",").alias("checkers"))


@attack_query("q21_hanging_pieces", f"""
SELECT p.pos_id, coalesce(string_agg({duck_name('s.sq')}, ',' ORDER BY s.sq), 'none') AS hanging
FROM pos p LEFT JOIN (
  SELECT pos_id, sq, piece FROM sq WHERE lower(piece) <> 'k'
  AND EXISTS (SELECT 1 FROM attacks a WHERE a.pos_id = sq.pos_id AND a.dest = sq.sq AND a.white <> (upper(sq.piece) = sq.piece))
  AND NOT EXISTS (SELECT 1 FROM attacks a WHERE a.pos_id = sq.pos_id AND a.dest = sq.sq AND a.white = (upper(sq.piece) = sq.piece))) s ON s.pos_id = p.pos_id
GROUP BY p.pos_id""")
def hanging(df):
    """Pieces but kings that the enemy attacks and nothing defends."""
    rows = df.withColumns({"by_white": attacked(True), "by_black": attacked(False)})
    w, k = F.col("by_white"), F.col("by_black")
    loose = either([F.col("s_white").bitwiseAND(k).bitwiseAND(F.bitwise_not(w)), F.col("s_black").bitwiseAND(w).bitwiseAND(F.bitwise_not(k))]).bitwiseAND(F.bitwise_not(kind("K").bitwiseOR(kind("k"))))
    return settled(rows, loose=loose).select("pos_id", listed(F.col("loose")).alias("hanging"))


@attack_query("q38_attacked_by", f"SELECT pos_id, {duck_name('dest')} AS square, string_agg({duck_name('sq')}, ',' ORDER BY {duck_name('sq')}) AS attackers FROM attacks WHERE white GROUP BY pos_id, dest")
def attacked_by(df):
    rows = spread(settled(df, hit=attacked(True)), "sq", "hit")
    rows = settled(rows, who=attackers(bit(F.col("sq")), True))
    return rows.select("pos_id", square_name(F.col("sq")).alias("square"), F.array_join(F.array_sort(names(F.col("who"))), ",").alias("attackers"))


@attack_query("p14_mobility", "SELECT p.pos_id, count(*) FILTER (a.white) AS white, count(*) FILTER (NOT a.white) AS black FROM pos p LEFT JOIN attacks a ON a.pos_id = p.pos_id AND lower(a.piece) IN ('n', 'b', 'r', 'q') GROUP BY p.pos_id")
def mobility(df):
    """Squares that a side's officers attack, counted a piece: rays of a direction are disjoint, leaps of a step too."""
    return df.select("pos_id", mobile(True).alias("white"), mobile(False).alias("black"))


def mobile(white: bool) -> Column:
    rays = [ray(sliders(white, line), F.col("free"), dx, dy) for line in "br" for dx, dy in _RAYS[line]]
    jumps = [moved(kind("N" if white else "n"), dx, dy) for dx, dy in _STEPS["n"]]
    return reduce(lambda a, b: a + b, (F.bit_count(x) for x in rays + jumps)).cast("long")


_VALUE = "CASE lower({0}) WHEN 'p' THEN 1 WHEN 'n' THEN 3 WHEN 'b' THEN 3 WHEN 'r' THEN 5 WHEN 'q' THEN 9 WHEN 'k' THEN 100 ELSE 0 END"


@attack_query("p20_xray", f"""
SELECT pos_id, {duck_name('sq')} AS slider, mid_piece, substr(b, dest::INTEGER + 1, 1) AS behind FROM (
  SELECT *, substr(b, list_filter(list_transform(range(1, k), lambda j: ((sq // 8 + j * dy) * 8 + sq % 8 + j * dx)::INTEGER), lambda t: substr(b, t + 1, 1) <> '.')[1] + 1, 1) AS mid_piece
  FROM seen WHERE blockers = 1 AND lower(piece) IN ('b', 'r', 'q'))
WHERE substr(b, dest::INTEGER + 1, 1) <> '.' AND (upper(mid_piece) = mid_piece) <> white AND (upper(substr(b, dest::INTEGER + 1, 1)) = substr(b, dest::INTEGER + 1, 1)) <> white
AND {_VALUE.format('substr(b, dest::INTEGER + 1, 1)')} > {_VALUE.format('mid_piece')}""", dealt=True)
def xray(df):
    """Sliders that see, behind an enemy piece, another of more worth: the first two pieces on each of their lines, a line a row."""
    rows = spread(settled(df, taken=F.bitwise_not("free"), sliders=either(map(kind, "BRQbrq"))), "sq", "sliders").withColumn("piece", F.expr(SPARK.at("sq")))
    rows = rows.withColumn("enemy", F.when(F.col("piece") == F.upper("piece"), F.col("s_black")).otherwise(F.col("s_white")))
    rows = rows.withColumn("way", F.explode(F.array(*map(F.lit, range(8))))).where(F.when(F.col("way") < 4, F.lower("piece") != "r").otherwise(F.lower("piece") != "b"))
    # Tests are of columns that are settled, so that each finds its numbers made.
    rows = settled(rows, held=F.get(_line_table(), F.col("way") * 64 + F.col("sq")).bitwiseAND(F.col("taken"))).where("held <> 0")
    rows = settled(rows, mid=nearest(F.col("held"), F.col("way"))).where(F.getbit("enemy", F.col("mid")) == 1)
    rows = settled(rows, held2=F.col("held").bitwiseXOR(bit(F.col("mid")))).where("held2 <> 0")
    rows = settled(rows, end=nearest(F.col("held2"), F.col("way"))).where(F.getbit("enemy", F.col("end")) == 1)
    rows = settled(rows, mid_piece=F.expr(SPARK.at("mid")), behind=F.expr(SPARK.at("end")))
    return rows.where(F.expr(f"{_VALUE.format('behind')} > {_VALUE.format('mid_piece')}")).select("pos_id", square_name(F.col("sq")).alias("slider"), "mid_piece", "behind")


@attack_query("p27_attacks_json", f"""
SELECT pos_id, {duck_name('sq')} AS square, piece, '[' || string_agg('"' || ({duck_name('dest')}) || '"', ',' ORDER BY dest) || ']' AS attacks FROM attacks GROUP BY pos_id, sq, piece""")
def attacks_json(df):
    rows = settled(pieces(df), hit=reach_of(F.col("at"), F.col("piece"))).where("hit <> 0")
    return rows.select("pos_id", square_name(F.col("sq")).alias("square"), "piece", F.to_json(names(F.col("hit"))).alias("attacks"))


@attack_query("p24_describe_square", f"""
SELECT s.pos_id, {duck_name('s.sq')} AS square, s.piece || ' attacked by ' || count(a.sq) FILTER (a.white <> (upper(s.piece) = s.piece)) || ', defended by ' || count(a.sq) FILTER (a.white = (upper(s.piece) = s.piece)) AS text
FROM sq s LEFT JOIN attacks a ON a.pos_id = s.pos_id AND a.dest = s.sq GROUP BY s.pos_id, s.sq, s.piece""")
def describe_square(df):
    rows = pieces(df)
    count = lambda white: F.bit_count(attackers(F.col("at"), white)).cast("string")
    rows = rows.withColumns({"w": count(True), "k": count(False)})
    return rows.select("pos_id", square_name(F.col("sq")).alias("square"), F.concat("piece", F.lit(" attacked by "), F.when(F.col("white"), F.col("k")).otherwise(F.col("w")), F.lit(", defended by "), F.when(F.col("white"), F.col("w")).otherwise(F.col("k"))).alias("text"))


@attack_query("l06_cheapest_attacker", f"""
SELECT p.pos_id, x.square, x.attacker FROM pos p LEFT JOIN (
 SELECT pos_id, {duck_name('dest')} AS square, {duck_name("arg_min(sq, (CASE lower(piece) WHEN 'p' THEN 1 WHEN 'n' THEN 3 WHEN 'b' THEN 3 WHEN 'r' THEN 5 WHEN 'q' THEN 9 ELSE 0 END) * 64 + sq)")} AS attacker
 FROM (SELECT *, min(dest) OVER (PARTITION BY pos_id) AS least FROM attacks WHERE white = (turn = 'w') AND target <> '.' AND (upper(target) = target) <> white) WHERE dest = least GROUP BY pos_id, dest) x ON x.pos_id = p.pos_id""")
def cheapest_attacker(df):
    """Of the side to move, the least piece that attacks the first enemy piece under attack; a king counts nothing."""
    rows = settled(df, hit=F.when(F.col("turn") == "w", attacked(True).bitwiseAND(F.col("s_black"))).otherwise(attacked(False).bitwiseAND(F.col("s_white"))))
    rows = rows.withColumn("sq", F.get(squares(F.col("hit")), F.lit(0))).withColumn("at", bit(F.col("sq")))
    rows = settled(rows, who=F.when(F.col("turn") == "w", attackers(F.col("at"), True)).otherwise(attackers(F.col("at"), False)))
    # Worth and square as one number.
    worth = lambda white: F.array(*(F.when(F.col("who").bitwiseAND(kind(k.upper() if white else k)) != 0, v * 64 + F.get(squares(F.col("who").bitwiseAND(kind(k.upper() if white else k))), F.lit(0))) for k, v in zip("kpnbrq", (0, 1, 3, 3, 5, 9), strict=True)))
    least = F.array_min(F.when(F.col("turn") == "w", worth(True)).otherwise(worth(False)))
    return rows.select("pos_id", square_name(F.col("sq")).alias("square"), square_name(least % 64).alias("attacker"))


@attack_query("p16_position_context", f"""SELECT p.*, m.white AS mobility_white, m.black AS mobility_black FROM (SELECT pos_id, {', '.join(f'{f(DUCK)} AS {c}' for c, f in CONTEXT.items())} FROM pos) p JOIN (
 SELECT p.pos_id, count(*) FILTER (a.white) AS white, count(*) FILTER (NOT a.white) AS black FROM pos p LEFT JOIN attacks a ON a.pos_id = p.pos_id AND lower(a.piece) IN ('n', 'b', 'r', 'q') GROUP BY p.pos_id) m ON m.pos_id = p.pos_id""")
def position_context(df):
    """Phase, material, pawn structure, open files, mobility and kings of a position: all its fields in one row."""
    return context(df).select("pos_id", *(F.expr(f(SPARK)).alias(c) for c, f in CONTEXT.items()), mobile(True).alias("mobility_white"), mobile(False).alias("mobility_black"))
