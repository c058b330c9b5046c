"""Games as PGN files: written one game after another, scanned a game a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.sources.positions import games

#: What ends a game by the words of its Termination header (fixed values of the test games).
ENDINGS = ("{w} won by resignation", "Game drawn by agreement", "{b} won on time", "{w} won by checkmate", "Game drawn by stalemate", "unterminated")
RESULTS = ("1-0", "1/2-1/2", "0-1", "1-0", "1/2-1/2", "*")


def movetext(no: int) -> str:
    """Moves of game ``no`` with numbers, a comment after the 3rd and 10th ply, and a variation after the 5th."""
    out = []
    for i, ply in enumerate(games()[no]):
        out.append((f"{i // 2 + 1}. " if i % 2 == 0 else "") + ply.san)
        if i == 2:
            out.append("{short [%clk 0:01:00]}")
        if i == 9:
            out.append("{a quiet move that leaves both sides with much to do}")
        if i == 4:
            out.append(f"({i // 2 + 1}. a3 (1. h3) a6)")
    return " ".join(out)


def pgn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """no, text: a game a supplier, between the supplier and its nation's key, ended in one of six ways."""
    n, ways = len(games()), len(RESULTS)
    texts = spark.createDataFrame([(i, movetext(i)) for i in range(n)], "no int, moves string")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") % n).cast("int").alias("no"), "s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("other"))
    way = (F.col("s_suppkey") % ways).cast("int")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), way)
    white = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("Nation "), "other"))
    black = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Nation "), "other")).otherwise(F.col("s_name"))
    tag = lambda name, value: F.concat(F.lit(f'[{name} "'), value, F.lit('"]\n'))
    said = F.replace(F.replace(pick(ENDINGS), F.lit("{w}"), white), F.lit("{b}"), black)
    head = F.concat(tag("Event", F.concat(F.lit("game "), F.col("s_suppkey").cast("string"))), tag("Date", F.concat(F.lit("2024.01."), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"))), tag("White", white), tag("Black", black), tag("Result", pick(RESULTS)), tag("Termination", said))
    return rows.join(F.broadcast(texts), "no").select("s_suppkey", F.concat(head, F.lit("\n"), F.col("moves"), F.lit(" "), pick(RESULTS), F.lit("\n")).alias("text"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """text: a row per game of the PGN files under ``path``. The reader itself cuts where an Event header begins, so that a
    file of any length streams; what stands before the first header is a row only if it is not blank."""
    rows = spark.read.option("lineSep", "[Event ").text(path)
    return rows.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select(F.concat(F.lit("[Event "), "value").alias("text"))


def header(name: str, default: str = ""):
    found = F.regexp_extract("text", rf'(?m)^\[{name} "([^"]*)"\]', 1)
    return F.when(found == "", default).otherwise(found)
