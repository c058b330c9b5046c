"""The rules kernel and engine formulas as SQL functions: ``register(spark)`` makes them temporary functions of a session.

Python functions run over Arrow batches; what expressions can say is registered as SQL expressions instead.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plyforge.functions import rules
from plyforge.functions.rules import Position, uci

@lru_cache(20_000)
def _position(fen: str) -> Position:
    return Position(fen)


def _or_none(fn):
    """Null in, or a FEN that can't be read, gives null."""

    def run(fen, *rest):
        try:
            return None if fen is None or None in rest else fn(_position(fen), *rest)
        except (ValueError, IndexError):
            return None

    return run


FUNCTIONS = {
    "chess_legal_moves": ("array<string>", lambda p: [uci(m) for m in p.legal()]),
    "chess_legal_sans": ("array<string>", lambda p: sorted(map(p.san, p.legal()))),
    "chess_is_check": ("boolean", lambda p: p.in_check()),
    "chess_is_checkmate": ("boolean", lambda p: p.is_checkmate()),
    "chess_is_stalemate": ("boolean", lambda p: p.is_stalemate()),
    "chess_push": ("string", lambda p, move: p.push(p.parse_any(move)).fen()),
    "chess_san": ("string", lambda p, move: p.san(p.parse_any(move))),
    "chess_uci": ("string", lambda p, move: uci(p.parse_any(move))),
    "chess_move_facts": ("array<string>", lambda p, move: rules.move_facts(p, p.parse_any(move))),
    "chess_threat_kind": ("string", lambda p, move: rules.threat_kind(p, p.parse_any(move))),
    "chess_line_legality": ("double", lambda p, moves: rules.line_legality(p, list(moves))),
    "chess_checks_captures_threats": ("struct<checks: array<string>, captures: array<string>, threats: array<string>>", lambda p: rules.checks_captures_threats(p)),
    "chess_validate_move": ("struct<valid: boolean, uci: string, san: string, error: string, fen: string, check: boolean, mate: boolean, capture: boolean, captured: string>", lambda p, move: rules.validate(p, move)),
}

EXPRESSIONS = {
    "engine_win_probability(cp DOUBLE)": ("DOUBLE", "0.5 + 0.5 * (2 / (1 + exp(-0.00368208 * cp)) - 1)"),
    "engine_effective_cp(kind STRING, score BIGINT)": ("BIGINT", "CASE WHEN kind = 'cp' THEN score WHEN score > 0 THEN 2000 WHEN score < 0 THEN -2000 ELSE 0 END"),
    "worker_quota(total BIGINT, workers BIGINT, worker BIGINT)": ("BIGINT", "total div workers + CASE WHEN worker < total % workers THEN 1 ELSE 0 END"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (kind, fn) in FUNCTIONS.items():
        spark.udf.register(name, F.udf(_or_none(fn), kind, useArrow=True))
    for head, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [*FUNCTIONS, *(h.split("(")[0] for h in EXPRESSIONS)]
