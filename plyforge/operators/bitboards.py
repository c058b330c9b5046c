"""Sets of squares in one long: bit 0 is a1, bit 63 is h8; shifts move whole sets, and generated code does the rest.

A side's rays of one direction are filled by shifts for all its pieces at once; rays of one direction never share a square,
as each ends at the next piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = {"n": [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)], "k": [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]}
_RAYS = {"b": [(1, 1), (1, -1), (-1, 1), (-1, -1)], "r": [(1, 0), (-1, 0), (0, 1), (0, -1)]}
_RAYS["q"] = _RAYS["b"] + _RAYS["r"]
KINDS = "PNBRQKpnbrqk"


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _files(*which: int) -> Column:
    return _long(sum(1 << (8 * r + f) for r in range(8) for f in which))


def moved(x: Column, dx: int, dy: int) -> Column:
    """The set one step on; what would leave the board is gone."""
    n = 8 * dy + dx
    y = F.shiftleft(x, n) if n > 0 else F.shiftrightunsigned(x, -n)
    if dx:
        y = y.bitwiseAND(_files(*(range(dx, 8) if dx > 0 else range(8 + dx))))
    return y


def ray(x: Column, free: Column, dx: int, dy: int) -> Column:
    """Squares that pieces on ``x`` see in a direction over ``free`` squares, the first taken one included."""
    return reduce(lambda seen, _: moved(x.bitwiseOR(free.bitwiseAND(seen)), dx, dy), range(6), moved(x, dx, dy))


def either(sets) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), sets)


def leaps(x: Column, kind: str) -> Column:
    return either(moved(x, dx, dy) for dx, dy in _STEPS[kind])


#: Half bytes of the kinds of pieces: three bits for the kind from 1, one for black.
_CODES = "0" + "".join("123456" + "9abcde")


def _plane(which: int) -> Column:
    """Of the 64 half bytes in q0 (a1 to h2, a1 lowest) to q3, one bit each, as a set."""
    out = []
    for k in range(4):
        x = F.shiftrightunsigned(F.col(f"q{k}"), which).bitwiseAND(_long(0x1111111111111111))
        for by, mask in ((3, 0x0303030303030303), (6, 0x000F000F000F000F), (12, 0x000000FF000000FF), (24, 0xFFFF)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by)).bitwiseAND(_long(mask))
        out.append(F.shiftleft(x, 16 * k))
    return either(out)


def bitboards(df: DataFrame) -> DataFrame:
    """``df`` (decoded) with a column per kind of piece (``s_wp`` ...), ``s_white``, ``s_black`` and ``free``.

    The board becomes half bytes, these become four sets of bits, and all else is arithmetic on them.
    """
    df = df.withColumn("codes_", F.expr(f"reverse(translate(b, '.{KINDS}', '{_CODES}'))"))
    # Never null, which keeps the generated code short.
    df = df.withColumns({f"q{k}": F.expr(f"coalesce(cast(conv(substr(codes_, {49 - 16 * k}, 16), 16, -10) as bigint), 0L)") for k in range(4)})
    df = df.withColumns({f"plane{i}": _plane(i) for i in range(4)})
    bit_is = lambda i, on: F.col(f"plane{i}") if on else F.bitwise_not(f"plane{i}")
    found = {_name(k): reduce(lambda x, y: x.bitwiseAND(y), (bit_is(i, int(_CODES[n + 1], 16) >> i & 1) for i in range(4))) for n, k in enumerate(KINDS)}
    some = F.col("plane0").bitwiseOR(F.col("plane1")).bitwiseOR(F.col("plane2"))
    sides = {"s_white": some.bitwiseAND(bit_is(3, False)), "s_black": F.col("plane3"), "free": F.bitwise_not(some)}
    return df.withColumns(found | sides).drop("codes_", *(f"{n}{k}" for n in ("q", "plane") for k in range(4)))


def _name(kind: str) -> str:
    return f"s_{'w' if kind.isupper() else 'b'}{kind.lower()}"


def spread(df: DataFrame, name: str, mask: str) -> DataFrame:
    """A row per square of the set in column ``mask``: all numbers are tried in generated code, which is cheaper than a list."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, range(64))))).where(F.getbit(mask, F.col(name)) == 1)


def each(df: DataFrame, name: str, items: Column) -> DataFrame:
    """A row per item. The outer form keeps the optimizer from putting a test of ``items`` below, where what they are made of
    would be made twice; as nothing is pushed below it, a test of the new column finds it made."""
    return df.withColumn(name, F.explode_outer(items)).where(F.col(name).isNotNull())


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed here, once a row: expressions over them, lambdas above all, read a value."""
    made = each(df, "made_", F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return made.select(*df.columns, *(F.col(f"made_.{n}").alias(n) for n in columns))

# -- pawns --


def _fill(x: Column, up: bool) -> Column:
    """The set and all squares ahead of it on its files."""
    for n in (8, 16, 32):
        x = x.bitwiseOR(F.shiftleft(x, n) if up else F.shiftrightunsigned(x, n))
    return x


def _beside(x: Column) -> Column:
    return moved(x, -1, 0).bitwiseOR(moved(x, 1, 0))


def _file_bits(x: Column) -> Column:
    """The files that a set touches, as eight bits."""
    return _fill(x, False).bitwiseAND(_long(0xFF))


def pawn_sets() -> dict[str, Column]:
    """Of either side (w, b): isolated and passed pawns (``m_isolated_w`` ...), and as eight bits of files, those with doubled pawns,
    half-open ones, and files without own pawns at the king; ``m_open`` are the open files, ``m_shield_w`` pawns before the king.
    """
    out, files = {}, {c: _file_bits(F.col(f"s_{c}p")) for c in "wb"}
    every = _long(0xFF)
    for c, e, up in (("w", "b", True), ("b", "w", False)):
        own, enemy, king = F.col(f"s_{c}p"), F.col(f"s_{e}p"), F.col(f"s_{c}k")
        whole = _fill(_fill(own, True), False)
        ahead = _fill(moved(enemy, 0, -1 if up else 1), not up)
        near = king.bitwiseOR(_beside(king))
        out |= {
            f"m_isolated_{c}": own.bitwiseAND(F.bitwise_not(_beside(whole))),
            f"m_passed_{c}": own.bitwiseAND(F.bitwise_not(ahead.bitwiseOR(_beside(ahead)))),
            f"m_doubled_{c}": _file_bits(own.bitwiseAND(_fill(moved(own, 0, 1), True))),
            f"m_half_{c}": F.bitwise_not(files[c]).bitwiseAND(files[e]),
            f"m_near_{c}": _file_bits(near).bitwiseAND(F.bitwise_not(files[c])),
            f"m_shield_{c}": moved(near, 0, 1 if up else -1).bitwiseAND(own),
        }
    return out | {"m_open": F.bitwise_not(files["w"].bitwiseOR(files["b"])).bitwiseAND(every)}
