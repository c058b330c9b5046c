"""Positions by number: a catalogue from random play, and the order keys that pick from it.

The catalogue follows from a seed, so that every process and both engines have the same one; nothing of it is stored. In
SQL it is the table MARK, which ``oracle`` puts in front of a query.
"""

from __future__ import annotations

import random
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.rules import START, Position, uci

SEED, SIZE, PLIES = 20_261, 2_048, 90
#: Tasks a core that keys are dealt to.
TASKS = 3
#: The table of (no, fen), numbers from 0, as SQL texts name it.
MARK = "catalogue_"


def _move(p: Position, rng: random.Random, legal):
    """A mate where one is found, else half of the moves are captures or promotions where there are some, so that games go somewhere."""
    if rng.random() < 0.7:
        mates = [m for m in legal if (after := p.push(m)).in_check() and not after.legal()]
        if mates:
            return mates[0]
    sharp = [m for m in legal if m[2] or p.is_capture(m)]
    return rng.choice(sharp if sharp and rng.random() < 0.35 else legal)


class Played(NamedTuple):
    """A ply: the move in UCI and SAN, and the position after it."""

    uci: str
    san: str
    fen: str


@lru_cache(1)
def games() -> tuple[tuple[Played, ...], ...]:
    """Games of random play from the start position."""
    rng, out, seen = random.Random(SEED), [], 0
    while seen < SIZE * 3 // 2:
        p, plies = Position(), []
        while len(plies) < PLIES and (legal := p.legal()) and not p.insufficient():
            m = _move(p, rng, legal)
            after = p.push(m)
            plies.append(Played(uci(m), p.san(m), after.fen()))
            p = after
        out.append(tuple(plies))
        seen += len(plies)
    return tuple(out)


@lru_cache(1)
def catalogue() -> tuple[str, ...]:
    """Different positions: how the games begin, what may be taken en passant, the last three of each game, then all others."""
    best, rest = {START: None}, {}
    for plies in games():
        for i, ply in enumerate(plies):
            rare = i >= len(plies) - 3 or ply.fen.split()[3] != "-"
            (best if rare else rest)[ply.fen] = None
    return tuple(list({**best, **rest})[:SIZE])


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _keys(spark: SparkSession, sf_dir: str, dealt: bool) -> DataFrame:
    """pos_id of every order; ``dealt`` by it, for what takes far longer over a row than a shuffle of its key: splits of a file may be uneven."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("pos_id"))
    return keys.repartition(max(TASKS * spark.sparkContext.defaultParallelism, keys.rdd.getNumPartitions()), "pos_id") if dealt else keys


def positions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """pos_id, fen; one row per order, nothing is shuffled but keys to be dealt: the catalogue is one constant of the plan, of a fixed size."""
    fens = F.split(F.lit("|".join(catalogue())), "[|]")
    return _keys(spark, sf_dir, dealt).select("pos_id", F.get(fens, (F.col("pos_id") % len(catalogue())).cast("int")).alias("fen"))


POSITIONS_SQL = f"SELECT o_orderkey AS pos_id, fen FROM orders JOIN {MARK} ON no = o_orderkey % (SELECT count(*) FROM {MARK})"


#: Plies of a line; the constants that hold them are split by these signs.
LINE = 6


@lru_cache(1)
def _lines() -> tuple[list[str], list[str], list[str]]:
    """From each ply of each game on: the position, and the next LINE moves in UCI and SAN."""
    fens, ucis, sans = [], [], []
    for plies in games():
        for i in range(len(plies)):
            fens.append(plies[i - 1].fen if i else START)
            ucis.append(" ".join(p.uci for p in plies[i : i + LINE]))
            sans.append(" ".join(p.san for p in plies[i : i + LINE]))
    return fens, ucis, sans


def picked_line(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """pos_id, pick (a number from the key), and of the line it picks: fen, ucis, sans (texts, LINE moves at most)."""
    pick = F.conv(F.substring(F.md5(F.concat(F.col("pos_id").cast("string"), F.lit(":line"))), 1, 8), 16, 10).cast("long")
    rows = _keys(spark, sf_dir, dealt).withColumn("pick", pick)
    at = (F.col("pick") % len(_lines()[0])).cast("int")
    return rows.select("pos_id", "pick", *(F.get(F.split(F.lit("|".join(x)), "[|]"), at).alias(c) for c, x in zip(("fen", "ucis", "sans"), _lines(), strict=True)))


#: The table of (no, ply, uci, san, fen_before, fen) of the games, numbers from 0.
GAMES = "games_"


def _unrolled(name: str, columns: str, rows: list[tuple]) -> str:
    """A table of texts as one string, which parses faster than thousands of values."""
    fields = [c.strip() for c in columns.split(",")]
    parts = ", ".join(f"string_split(r, ';')[{i + 1}]{'::INTEGER' if isinstance(rows[0][i], int) else ''} AS {f}" for i, f in enumerate(fields))
    return f"{name} AS MATERIALIZED (SELECT {parts} FROM (SELECT unnest(string_split({quoted('|'.join(';'.join(map(str, r)) for r in rows))}, '|')) AS r))"


@lru_cache(1)
def _tables() -> dict[str, str]:
    plies = [(no, i, p.uci, p.san, g[i - 1].fen if i else START, p.fen) for no, g in enumerate(games()) for i, p in enumerate(g)]
    return {MARK: _unrolled(MARK, "no, fen", list(enumerate(catalogue()))), GAMES: _unrolled(GAMES, "no, ply, uci, san, fen_before, fen", plies)}


#: line_: pos_id, pick, and the plies of the line that a row picks: k (from 0), uci, san, fen_before, fen.
LINES_SQL = f"""line_ AS (
 SELECT pos_id, pick, h.ply - g.ply AS k, h.uci, h.san, h.fen_before, h.fen FROM (SELECT o_orderkey AS pos_id, ('0x' || substr(md5(o_orderkey || ':line'), 1, 8))::BIGINT AS pick FROM orders) r
 JOIN (SELECT *, row_number() OVER (ORDER BY no, ply) - 1 AS at FROM {GAMES}) g ON g.at = pick % (SELECT count(*) FROM {GAMES}) JOIN {GAMES} h ON h.no = g.no AND h.ply BETWEEN g.ply AND g.ply + {LINE - 1})"""


def oracle(sql: str) -> str:
    """``sql`` with the tables of this module that it names."""
    tables = ", ".join(text for name, text in _tables().items() if name in sql) if any(name in sql for name in (MARK, GAMES)) else ""
    if not tables:
        return sql
    head = sql.lstrip()
    return f"WITH {tables}, {head[5:]}" if head.startswith("WITH ") else f"WITH {tables} {head}"
