"""Positions from files of JSON lines, in the order of the files: the first record of each position, from the front or from the tail.

A line may be blank or broken; a record has its position as ``fen`` or, before that, as ``metadata.fen``, and may have terms and a score.
The order of a line is (file, start of its split, place in the split), which Spark's text source knows without a shuffle; a split is read
by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SCHEMA = "metadata struct<fen: string>, fen string, _corrupt string"
_PAYLOAD = "sf15_terms array<double>, eval_score double"
#: Bytes of a line as a first guess, and how many times the lines of the positions asked for a tail holds (fixed values).
LINE_BYTES, TAIL = 80, 4
#: By how much a scan that has not found enough positions grows.
GROW = 4


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files, by path. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,jsonl,txt}").option("recursiveFileLookup", "true").load(path)
    return sorted((r.path, r.length) for r in found.select("path", "length").collect())


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, no, value: all lines; (file, block, no) is their order."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), "value")


ORDER = ("file", "block", "no")


def parsed(rows: DataFrame) -> DataFrame:
    """``lines`` that are not blank with ``fen`` (null: none), ``terms`` and ``score`` (both or neither), ``broken``."""
    rows = rows.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"^\s+", ""), r"\s+$", "")).where("value <> ''")
    rows = rows.withColumn("r", F.from_json("value", _SCHEMA, {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"})).withColumn("p", F.from_json("value", _PAYLOAD))
    broken = ~F.col("value").startswith("{") | F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    text = lambda c: F.nullif(c, F.lit(""))
    both = F.col("p.sf15_terms").isNotNull() & F.col("p.eval_score").isNotNull()
    return rows.select(
        *ORDER, "value", broken.alias("broken"), F.when(~broken, F.coalesce(text(F.col("r.metadata.fen")), text(F.col("r.fen")))).alias("fen"),
        F.when(both, F.col("p.sf15_terms")).alias("terms"), F.when(both, F.col("p.eval_score")).alias("score"),
    )


def broken(spark: SparkSession, path: str) -> DataFrame:
    """file, block, no, value of lines that are no records."""
    return parsed(lines(spark, [p for p, _ in files(spark, path)])).where("broken").select(*ORDER, "value")


def _firsts(rows: DataFrame, most: int | None) -> DataFrame:
    """Each position's first record, the first ``most`` of them; a task sends one row a position that it has."""
    at = F.struct(*ORDER)
    out = parsed(rows).where("fen is not null").groupBy("fen").agg(F.min(at).alias("at"), F.min_by(F.struct("terms", "score"), at).alias("p")).select("fen", "at", "p.terms", "p.score")
    return out if most is None else out.orderBy("at").limit(most)


def first_seen(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """fen, at (order), terms, score of the first record of each position, of the first ``most`` ones if it is given.

    With a limit, files are read from the front until they hold enough: a scan that comes short is made again over GROW
    times as much, so that no more than a few times the bytes needed are read.
    """
    found = files(spark, path)
    take, bytes_ = len(found) if most is None else 0, (most or 0) * LINE_BYTES
    while True:
        total = 0
        for k, (_, size) in enumerate(found):
            if k >= take and total >= bytes_:
                break
            take, total = max(take, k + 1), total + size
        if not found:
            return spark.createDataFrame([], "fen string, at struct<file: string, block: long, no: long>, terms array<double>, score double")
        out = _firsts(lines(spark, [p for p, _ in found[:take]]), most)
        if most is None or take == len(found) or out.count() >= most:
            return out
        bytes_ = total * GROW


def last_seen(spark: SparkSession, path: str, most: int, bytes_: int | None = None) -> DataFrame:
    """As ``first_seen``, of the lines that begin within the last ``bytes_`` of all files (TAIL times the lines of ``most`` positions).

    Files before the tail are not opened; sizes are summed up by split, and only in splits that the tail reaches by line.
    """
    bytes_, found, total, need = bytes_ or most * LINE_BYTES * TAIL, files(spark, path), 0, []
    for name, size in reversed(found):
        if total >= bytes_:
            break
        need.append(name)
        total += size
    if not need:
        return first_seen(spark, path, most)
    rows = lines(spark, sorted(need)).withColumn("size", F.octet_length("value") + 1)
    after = Window.orderBy(F.desc("file"), F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # A row a split.
    splits = rows.groupBy("file", "block").agg(F.sum("size").alias("whole")).withColumn("after", F.coalesce(F.sum("whole").over(after), F.lit(0))).where(F.col("after") < bytes_)
    here = Window.partitionBy("file", "block").orderBy(F.desc("no")).rowsBetween(Window.unboundedPreceding, 0)
    tail = rows.join(F.broadcast(splits), ["file", "block"]).withColumn("rest", F.col("after") + F.sum("size").over(here))
    # A line that begins where the tail does may be cut, unless it is the first of all.
    whole = sum(size for _, size in found) <= bytes_
    return _firsts(tail.where(F.lit(whole) | (F.col("rest") < bytes_)).select(*ORDER, "value"), most)


# -- lines made from a table, as the queries read them --

_FEN = "event_type || ' ' || user_id"
#: Lines of seven kinds: blank, position in its metadata, with terms, broken, no object, position behind an empty one, blanks around.
LINE_SQL = f"""CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '{{"metadata": {{"fen": "' || {_FEN} || '", "n": 1}}}}'
  WHEN 2 THEN '{{"fen": "' || {_FEN} || '", "sf15_terms": [1.5, ' || event_id % 50 || '], "eval_score": ' || event_id % 90 || '}}' WHEN 3 THEN '{{"fen": "' || {_FEN}
  WHEN 4 THEN '["' || {_FEN} || '"]' WHEN 5 THEN '{{"metadata": {{"fen": ""}}, "fen": "' || {_FEN} || '", "eval_score": 3}}' ELSE '  {{"metadata": {{}}, "fen": "' || {_FEN} || '"}} ' END"""


def written(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Events as JSON lines under ``path``, in their order."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null and user_id is not null").select("event_id", F.expr(LINE_SQL).alias("value"))
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.option("compression", "none").format("text").mode("overwrite").save(f"{path}/plain")
    return f"{path}/plain"


def numbered(found: DataFrame) -> DataFrame:
    """fen, place, score: a limited number of first records with their places from 1."""
    return found.select("fen", F.row_number().over(Window.orderBy("at")).alias("place"), F.col("score").alias("score"))


def oracle(rows: str, most: int) -> str:
    return f"""
WITH lines AS (SELECT event_id, event_id % 7 AS kind, {_FEN} AS fen, {LINE_SQL} AS value FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL),
kept AS ({rows}),
firsts AS (SELECT fen, min(event_id) AS event_id, arg_min(CASE WHEN kind = 2 THEN (event_id % 90)::DOUBLE ELSE -1 END, event_id) AS s FROM kept WHERE kind IN (1, 2, 5, 6) GROUP BY fen)
SELECT fen, (row_number() OVER (ORDER BY event_id))::INTEGER AS place, nullif(s, -1) AS score FROM firsts ORDER BY event_id LIMIT {most}"""

