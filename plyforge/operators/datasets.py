"""Dataset builds, sinks and prompts: what joins the smaller operators to records on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions.dialect import DUCK
from plyforge.functions.rules import Position
from plyforge.operators.engine import engine_query, eval_label, label_sql, notable, notable_sql, term_vector, TERMS_SQL
from plyforge.operators.features import decoded, feature, full_name_at, or_none, rights, square
from plyforge.operators.records import bucket, on, sql_bucket, table
from plyforge.operators.text import scorer, stripped
from plyforge.plans.registry import register
from plyforge.sources.positions import POSITIONS_SQL, positions
from plyforge.streaming.logs import shared_dir

# -- sinks: written to the shared folder and read again --


def written(df: DataFrame, kind: str, partition: str | None = None) -> DataFrame:
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.format(kind)
    (writer.partitionBy(partition) if partition else writer).save(path)
    return spark.read.format(kind).schema(df.schema).load(path)


@register("k01_twin_sink", f"SELECT event_id, event_type, CASE WHEN {sql_bucket('event_id', 'split', 100)} < 5 THEN 'eval' ELSE 'train' END AS split FROM events")
def twin_sink(spark, sf_dir):
    """Train and eval records in one write, a folder each."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(bucket(F.col("event_id"), "split", 100) < 5, "eval").otherwise("train").alias("split"))
    return written(rows, "json", "split")


@register("k02_part_files", "SELECT o_orderkey, o_totalprice FROM orders")
def part_files(spark, sf_dir):
    """Workers' part files; they are never joined to one unless asked for."""
    return written(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "parquet")


@register("k04_text_sink", "SELECT 'doc ' || doc_id AS value FROM documents")
def text_sink(spark, sf_dir):
    return written(table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("value")), "text")


# -- questions --


@register("q42_rare_pool", f"SELECT pos_id, pool FROM (SELECT pos_id, pool, row_number() OVER (PARTITION BY pool ORDER BY {sql_bucket('pos_id', 'rare', 1 << 30)}, pos_id) AS rn FROM (SELECT pos_id, CASE WHEN ep <> '-' THEN 'ep' WHEN castling = '-' THEN 'none' ELSE 'castling' END AS pool FROM {DUCK.decoded(f'({POSITIONS_SQL})')})) WHERE pool <> 'none' OR rn <= 60")
def rare_pool(spark, sf_dir, most=60):
    """All positions of the rare pools, and a bounded number of the rest."""
    rows = decoded(positions(spark, sf_dir)).select("pos_id", F.when(F.col("ep") != "-", "ep").when(F.col("castling") == "-", "none").otherwise("castling").alias("pool"))
    # Top-n of the common pool, which each task cuts to n rows; the rare ones are not moved.
    common = rows.where("pool = 'none'").orderBy(bucket(F.col("pos_id"), "rare", 1 << 30), "pos_id").limit(most)
    return rows.where("pool <> 'none'").unionByName(common)


# -- rewards --


@on("events", "r30_batch_health", "SELECT event_id // 64 AS step, CASE WHEN count(*) FILTER (value > 50) = 0 THEN 'error' WHEN count(*) FILTER (value > 50) < count(*) THEN 'partial' ELSE 'ok' END AS health FROM events GROUP BY 1")
def batch_health(df):
    judged, n = F.count_if(F.col("value") > 50), F.count(F.lit(1))
    return df.groupBy(F.expr("event_id div 64").alias("step")).agg(F.when(judged == 0, "error").when(judged < n, "partial").otherwise("ok").alias("health"))


# -- prompts --

scorer("x10_sentinel_injection", "regexp_replace(text, '(LINE [0-9]+: )', '\\1<|board|>', 'g') AS prompt", prompt=lambda t, n: F.regexp_replace(t, "(LINE [0-9]+: )", "$1<|board|>"))
feature("x14_coaching_prompt", prompt=lambda d: f"'Position: ' || fen || ' Side: ' || CASE WHEN turn = 'w' THEN 'white' ELSE 'black' END || ' Castling: ' || {or_none(d, rights(d, 5, ', '))} || ' Square: ' || {full_name_at(d, square('sq')(d))}")


#: Characters from which a context takes no further line (fixed value).
CONTEXT = 1500
_LINES_SQL = "SELECT conv_id, s, i, l, sum(length(l) + 1) OVER (PARTITION BY conv_id ORDER BY s, i) AS line_end FROM (SELECT conv_id, s, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT conv_id, s, string_split(text, chr(10)) AS ls FROM turns))"
_CONTEXT_SQL = "coalesce((SELECT regexp_replace(regexp_replace(string_agg(l, chr(10) ORDER BY line_end), '^\\s+', ''), '\\s+$', '') FROM lines WHERE lines.conv_id = turns.conv_id AND {0}), '')"


@register("x05_diagram_contexts", f"WITH turns AS (SELECT *, e - length(text) - 1 AS s FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, text) AS e FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations))), lines AS ({_LINES_SQL}) SELECT conv_id, turn, {_CONTEXT_SQL.format(f'line_end <= turns.s AND turns.s - line_end < {CONTEXT}')} AS text_before, {_CONTEXT_SQL.format(f'line_end - length(l) - 1 >= turns.e AND line_end - length(l) - 1 - turns.e < {CONTEXT}')} AS text_after FROM turns")
def diagram_contexts(spark, sf_dir):
    """Each diagram with the whole lines before and after it, nearest first, until they hold CONTEXT characters or more."""
    by, size = Window.partitionBy("conv_id"), lambda c: F.length(c).cast("long") + 1
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("end", F.sum(size("text")).over(by.orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - size("text"))
    lines = turns.select("conv_id", "start", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line_end", F.sum(size("line")).over(by.orderBy("start", "pos").rowsBetween(Window.unboundedPreceding, 0)))
    # A line stands where it ends for what comes after it, and where it begins for what comes before; a diagram the other way round.
    both = turns.select("conv_id", "turn", F.lit(True).alias("diagram"), F.lit(None).cast("string").alias("line"), F.col("start").alias("back"), F.col("end").alias("on"))
    both = both.unionByName(lines.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(False).alias("diagram"), "line", F.col("line_end").alias("back"), (F.col("line_end") - size("line")).alias("on")))
    near = lambda c, a, b: stripped(F.array_join(F.collect_list("line").over(by.orderBy(c).rangeBetween(a, b)), "\n"))
    found = both.select("conv_id", "turn", "diagram", near("back", 1 - CONTEXT, 0).alias("text_before"), near("on", 0, CONTEXT - 1).alias("text_after"))
    return found.where("diagram").drop("diagram")


# -- engine records --

_KEYS = ["pos_id", "multipv", "l_partkey", "l_suppkey"]
_KEY = ", ".join(_KEYS)


@engine_query("e18_labelled_lines", f"SELECT {_KEY}, move || ' (' || {label_sql('score', 'tools')} || ')' AS line FROM LINES")
def labelled_lines(df):
    return df.select(*_KEYS, F.concat("move", F.lit(" ("), eval_label(F.col("score"), "tools"), F.lit(")")).alias("line"))


@engine_query("l03_notable_five", f"SELECT {_KEY}, {notable_sql(0.05, 5)} AS top FROM (SELECT *, {TERMS_SQL} AS t FROM LINES)")
def notable_five(df):
    return df.withColumn("terms", term_vector()).select(*_KEYS, notable(0.05, 5).alias("top"))


def imbalance_label(v: Column, name: Column) -> Column:
    size = F.abs(v)
    verb = F.when(size > 2.0, "dominates in").when(size > 0.5, "leads in").otherwise("is slightly better in")
    return F.when(size >= 0.1, F.concat_ws(" ", F.when(v > 0, "White").otherwise("Black"), verb, name))


@engine_query("l05_imbalance_labels", f"SELECT {_KEY}, CASE WHEN abs(t[8]) >= 0.1 THEN CASE WHEN t[8] > 0 THEN 'White' ELSE 'Black' END || ' ' || CASE WHEN abs(t[8]) > 2 THEN 'dominates in' WHEN abs(t[8]) > 0.5 THEN 'leads in' ELSE 'is slightly better in' END || ' Mobility' END AS label FROM (SELECT *, {TERMS_SQL} AS t FROM LINES)")
def imbalance_labels(df):
    return df.withColumn("terms", term_vector()).select(*_KEYS, imbalance_label(F.get("terms", F.lit(7)), F.lit("Mobility")).alias("label"))


