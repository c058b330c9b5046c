"""Foreign texts read into rows (engine output, logs, data sets), reports of evaluations, and rewards of board reading.

The texts are made from the test tables in the forms that the tools write; the readers are expressions over one text column
and do not know where it comes from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.functions.dialect import DUCK, SPARK
from plyforge.functions.rules import checks_captures_threats, move_facts, position, uci
from plyforge.operators.engine import KEYS, TERMS, TERMS_SQL, engine_lines, engine_query, term_vector
from plyforge.operators.features import decoded, feature, html, picked
from plyforge.operators.legal_sql import with_moves
from plyforge.operators.moves import _FACTS, chosen, position_query, with_threats
from plyforge.operators.records import bucket, mean_jaccard, on, sql_bucket, table, words
from plyforge.operators.text import CLASSES, COMPLETIONS_SQL, SQL_CLASS, compatible, completions, scorer, stripped, text_class
from plyforge.plans.registry import register
from plyforge.sources.positions import POSITIONS_SQL, positions

_KEY = ", ".join(KEYS)

# -- rows of data sets --

#: How a row with two candidate moves is written (fixed value).
CANDIDATES = 'The FEN of the given chess board is "%s". Which move is better? MoveA:%s, TacticA: %s MoveB:%s, TacticB: %s'
_A, _B = "'e' || (pos_id % 8 + 1) || 'd' || (pos_id % 7 + 1)", "'a' || (pos_id % 6 + 1) || 'h' || (pos_id % 5 + 1)"
_PLAN_A, _PLAN_B = "'a fork of ' || pos_id || ' kinds'", "'pin it,' || {0} || 'then wait ' || (pos_id % 9)"


@register("s13_two_candidates", f"SELECT pos_id, fen, m AS move, t AS tactic FROM (SELECT pos_id, fen, unnest([{_A}, {_B}]) AS m, unnest([{_PLAN_A}, {_PLAN_B.format('chr(10)')}]) AS t FROM ({POSITIONS_SQL}))")
def two_candidates(spark, sf_dir):
    """A row per candidate move of a text, with its tactic, which may have several lines."""
    rows = positions(spark, sf_dir).select("pos_id", F.format_string(CANDIDATES, "fen", F.expr(_A), F.expr(_PLAN_A), F.expr(_B), F.expr(_PLAN_B.format("'\\n'"))).alias("s"))
    one = lambda x, rest: F.struct(F.regexp_extract("s", rf"Move{x}:(\w+)", 1).alias("move"), F.trim(F.regexp_extract("s", rf"(?s)Tactic{x}:\s*(.*?)\s*{rest}", 1)).alias("tactic"))
    return rows.select("pos_id", F.regexp_extract("s", r'chess board is "(.*?)"\.', 1).alias("fen"), F.explode(F.array(one("A", "MoveB:"), one("B", "$"))).alias("m")).select("pos_id", "fen", "m.*")


# -- output of engines --


def info_fields(info: Column) -> dict[str, Column]:
    """Fields of an engine's info line, null where it does not have them; a line without a multipv is line 1."""
    number = lambda k: F.expr("try_cast(x as bigint)") if k is None else F.nullif(F.regexp_extract(info, rf"\b{k} (-?\d+)", 1), F.lit("")).cast("long")
    wdl = F.regexp_extract(info, r"\bwdl (\d+) \d+ \d+", 1)
    return {
        "depth": number("depth"), "seldepth": number("seldepth"), "kind": F.regexp_extract(info, r"score (cp|mate)", 1), "value": F.regexp_extract(info, r"score (?:cp|mate) (-?\d+)", 1).cast("long"),
        "win": F.nullif(wdl, F.lit("")).cast("long"), "nodes": number("nodes"), "nps": number("nps"), "time": number("time"), "line": F.coalesce(number("multipv"), F.lit(1).cast("long")), "pv": F.split(F.regexp_extract(info, r" pv (.*)$", 1), " "),
    }


_PV = "'e2e4 m' || l_partkey || CASE WHEN l_suppkey % 2 = 0 THEN ' e7e5 g1f3' ELSE '' END"


@engine_query("s14_uci_info", f"""SELECT {_KEY}, depth::BIGINT AS depth, CASE WHEN l_partkey % 4 <> 0 THEN depth + l_suppkey % 9 END AS seldepth, score_type AS kind, score::BIGINT AS value, win::BIGINT AS win, l_partkey * 7 AS nodes,
 l_suppkey + 1000 AS nps, l_partkey % 977 AS time, CASE WHEN multipv > 1 THEN multipv ELSE 1 END AS line, string_split({_PV}, ' ') AS pv FROM LINES WHERE l_suppkey % 6 <> 0""")
def uci_info(df):
    """Lines without a pv (a sixth of them, as `info string` or a current move) give no row."""
    part = lambda test, form, *c: F.when(test, F.format_string(form, *c)).otherwise("")
    some = F.lit(True)
    text = F.concat(
        part(some, "info depth %d", F.col("depth").cast("long")), part(F.col("l_partkey") % 4 != 0, " seldepth %d", F.col("depth") + F.col("l_suppkey") % 9), part(F.col("multipv") > 1, " multipv %d", "multipv"),
        part(some, " score %s %d", "score_type", F.col("score").cast("long")), part(F.col("win").isNotNull(), " wdl %d 10 20", F.col("win").cast("long")), part(some, " nodes %d nps %d time %d", F.col("l_partkey") * 7, F.col("l_suppkey") + 1000, F.col("l_partkey") % 977),
        F.when(F.col("l_suppkey") % 6 != 0, F.concat(F.lit(" pv "), F.expr(_PV))).otherwise(" currmove e2e4"),
    )
    rows = df.withColumn("info", text).where(F.col("info").contains(" pv "))
    return rows.select(*KEYS, *(c.alias(n) for n, c in info_fields(F.col("info")).items()))


#: A row of an evaluation's printed table: a term, middle and end game of either side (fixed value).
TRACE_ROW = r"^\|\s*([A-Za-z ]+?)\s*\|\s*(\S+)\s+(\S+)\s*\|\s*(\S+)\s+(\S+)\s*\|"


def trace_rows(df: DataFrame, text: str) -> DataFrame:
    """``df`` with term, white and black of every known term in the printed table of column ``text``; dashes are 0."""
    lines = df.withColumn("line_", F.explode(F.split(text, "\n"))).where(F.col("line_").rlike(TRACE_ROW))
    part = lambda k: F.regexp_extract("line_", TRACE_ROW, k)
    cell = lambda k: F.when(part(k).contains("---"), 0.0).otherwise(part(k).try_cast("double"))
    return lines.withColumns({"term": part(1), "white": (cell(2) + cell(3)) / 2, "black": (cell(4) + cell(5)) / 2}).where(F.col("term").isin(*TERMS)).drop("line_")


_CELLS = [f"(s_suppkey * {k} + i * {k + 2}) % 401" for k in (3, 7, 11, 13)]


@on("supplier", "s16_trace_terms", f"""SELECT s_suppkey, t[i + 1] AS term, (CASE WHEN (s_suppkey + i) % 5 = 0 THEN 0.0 ELSE ({_CELLS[0]} / 4.0 - 50 + {_CELLS[1]} / 4.0 - 50) / 2 END)::DOUBLE AS white, (({_CELLS[2]} / 4.0 - 50 + {_CELLS[3]} / 4.0 - 50) / 2)::DOUBLE AS black
 FROM (SELECT s_suppkey, {list(TERMS)} AS t, unnest(range(0, {len(TERMS)})) AS i FROM supplier)""")
def trace_terms(df):
    """Each supplier's printed table: a head, a row a term, one of no known term, and a last line."""
    number = lambda c: F.format_string("%.2f", F.expr(c) / 4.0 - 50)
    name = lambda i: F.get(F.array(*map(F.lit, TERMS)), i)

    def row(i):
        at = lambda k: F.format_string("%.2f", (F.col("s_suppkey") * k + i * (k + 2)) % 401 / 4.0 - 50)
        white = F.when((F.col("s_suppkey") + i) % 5 == 0, " ----  ---- ").otherwise(F.concat(F.lit(" "), at(3), F.lit("  "), at(7), F.lit(" ")))
        return F.concat(F.lit("| "), F.lpad(name(i), 12, " "), F.lit(" |"), white, F.lit("| "), at(11), F.lit(" "), at(13), F.lit(" | 0.00  0.00 |"))

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(len(TERMS) - 1)), row), "\n")
    text = F.concat(F.lit("     Term    |    White    |    Black    | Total\n             |   MG    EG  |   MG    EG  |\n"), body, F.lit("\n| Strangeness | 1.00 1.00 | 1.00 1.00 |\n|  Mobility Final evaluation +0.3 (white side)"))
    return trace_rows(df.select("s_suppkey", text.alias("text")), "text").select("s_suppkey", "term", "white", "black")


# -- logs --

STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
ROLLOUT = r"rollout step (\d+): (\d+) completions, (\d+) correct, avg_reward (-?[\d.]+)"
BEST = r"best of step (\d+): solution (\S+) predicted (\S+)"


def log_steps(df: DataFrame, shard: str, at: str, line: str) -> DataFrame:
    """Of logs (a shard each, lines ordered by ``at``), a row per shard and step: the numbers of its rollout, and of its best
    completion the solution, the prediction and the snippet, which are the lines after it up to the next with a time stamp."""
    order = Window.partitionBy(shard).orderBy(at)
    stamped = F.col(line).rlike(STAMP)
    part = lambda pattern, k: F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))
    rows = df.withColumn("head_", F.last(F.when(stamped, F.col(line)), ignorenulls=True).over(order))
    rows = rows.withColumn("step", F.regexp_extract("head_", rf"(?:{ROLLOUT}|{BEST})", 1)).withColumn("step", F.coalesce(F.nullif("step", F.lit("")), F.nullif(F.regexp_extract("head_", BEST, 1), F.lit(""))).cast("long"))
    rows = rows.where("step is not null")
    told = F.array_sort(F.collect_list(F.when(~stamped & F.col("head_").rlike(BEST), F.struct(F.col(at), F.rtrim(line).alias("t")))))
    return rows.groupBy(shard, "step").agg(
        F.max(part(ROLLOUT, 2)).cast("long").alias("completions"), F.max(part(ROLLOUT, 3)).cast("long").alias("correct"), F.max(part(ROLLOUT, 4)).cast("double").alias("avg_reward"),
        F.max(part(BEST, 2)).alias("solution"), F.max(part(BEST, 3)).alias("predicted"), stripped(F.array_join(F.transform(told, lambda x: x["t"]), "\n")).alias("snippet"),
    )


@on("events", "s17_log_steps", """
SELECT user_id, step, max(CASE WHEN w = 0 THEN n END) AS completions, max(CASE WHEN w = 0 THEN n // 2 END) AS correct, max(CASE WHEN w = 0 THEN round(value, 2) END)::DOUBLE AS avg_reward, max(CASE WHEN w = 1 THEN 'm' || n END) AS solution, max(CASE WHEN w = 1 THEN event_type END) AS predicted,
 coalesce(string_agg(CASE WHEN w > 1 AND head = 1 THEN 'line ' || event_id END, chr(10) ORDER BY event_id), '') AS snippet
FROM (SELECT *, (rn - 1) // 5 AS step, (rn - 1) % 5 AS w, event_id % 90 + 10 AS n, CASE WHEN (rn - 1) // 5 % 4 = 3 THEN 0 ELSE 1 END AS head FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)) GROUP BY user_id, step""")
def logs(df):
    """A log a user, five lines a step; in every fourth step a stamped note stands between the best line and what follows it."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = df.withColumn("rn", rn).withColumn("step", F.expr("rn div 5")).withColumn("w", F.col("rn") % 5).withColumn("n", F.col("event_id") % 90 + 10)
    stamp = F.lit("2024-05-01 10:00:00 INFO ")
    line = F.when(F.col("w") == 0, F.concat(stamp, F.format_string("rollout step %d: %d completions, %d correct, avg_reward %.2f", F.col("step"), F.col("n"), F.expr("n div 2"), F.col("value"))))
    line = line.when(F.col("w") == 1, F.concat(stamp, F.format_string("best of step %d: solution m%d predicted %s", "step", "n", "event_type"), F.when(F.col("step") % 4 == 3, F.lit("\n2024-05-01 10:00:01 INFO saved")).otherwise("")))
    rows = rows.select("user_id", "event_id", F.posexplode(F.split(line.otherwise(F.concat(F.lit("line "), F.col("event_id").cast("string"), F.lit("  "))), "\n")).alias("k", "line"))
    return log_steps(rows.withColumn("at", F.col("event_id") * 2 + F.col("k")), "user_id", "at", "line")


# -- reports --


@on("labels", "k05_json_report", """
SELECT 'report' AS kind, '{"checkpoint":"base","total":' || sum(n) || ',"exact_accuracy":' || round(sum(exact) / sum(n)::DOUBLE, 4) || ',"per_subset":[' || string_agg('{"subset":' || toxic || ',"total":' || n || ',"exact":' || exact || ',"exact_acc":' || round(exact / n::DOUBLE, 4) || '}', ',' ORDER BY toxic) || ']}' AS line
 FROM (SELECT toxic, count(*) AS n, sum(quality) AS exact FROM labels GROUP BY toxic)
UNION ALL SELECT 'result', '{"id":' || doc_id || ',"subset":' || toxic || ',"exact":' || quality || '}' FROM labels""")
def json_report(df):
    """The report of an evaluation as JSON lines: a head with totals and one entry a subset, and a line a result, so that no
    single row holds all results."""
    accuracy = lambda a, n: F.round(a / n, 4)
    subsets = df.groupBy("toxic").agg(F.count(F.lit(1)).alias("total"), F.sum("quality").alias("exact"))
    one = F.struct(F.col("toxic").alias("subset"), "total", "exact", accuracy(F.col("exact"), F.col("total")).alias("exact_acc"))
    whole = subsets.agg(F.sum("total").alias("total"), F.sum("exact").alias("all_exact"), F.array_sort(F.collect_list(one)).alias("per_subset"))
    head = whole.select(F.lit("report").alias("kind"), F.to_json(F.struct(F.lit("base").alias("checkpoint"), "total", accuracy(F.col("all_exact"), F.col("total")).alias("exact_accuracy"), "per_subset")).alias("line"))
    return head.unionByName(df.select(F.lit("result").alias("kind"), F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("toxic").alias("subset"), F.col("quality").alias("exact"))).alias("line")))


_BOARD = "(SELECT '<table>' || string_agg(x.r, '' ORDER BY x.k) || '</table>' FROM (SELECT k, '<tr>' || string_agg('<td class=\"' || CASE WHEN (7 - k + f) % 2 = 0 THEN 'd' ELSE 'l' END || '\">' || replace(substr(b, ((7 - k) * 8 + f + 1)::INTEGER, 1), '.', '&nbsp;') || '</td>', '' ORDER BY f) || '</tr>' AS r FROM range(0, 8) AS rk(k), range(0, 8) AS fl(f) GROUP BY k) x)"


@register("k07_html_output", f"SELECT pos_id, '<html><body>' || {_BOARD} || '<p class=\"fen\">' || fen || '</p><p>' || CASE WHEN turn = 'w' THEN 'White' ELSE 'Black' END || ' to move</p></body></html>' AS html FROM {DUCK.decoded(f'({POSITIONS_SQL})')}")
def html_page(spark, sf_dir):
    """A page with the board as a table, its FEN and the side to move."""
    rows = decoded(positions(spark, sf_dir, dealt=True)).selectExpr("pos_id", "fen", "turn", f"{html(SPARK)} AS board")
    return rows.select("pos_id", F.concat(F.lit("<html><body>"), "board", F.lit('<p class="fen">'), "fen", F.lit("</p><p>"), F.when(F.col("turn") == "w", "White").otherwise("Black"), F.lit(" to move</p></body></html>")).alias("html"))


# -- questions and terms --

TASKS = ("side_to_move", "material", "castling")


@register("q41_task_per_position", f"SELECT pos_id, t AS task FROM (SELECT pos_id FROM ({POSITIONS_SQL}) ORDER BY pos_id LIMIT 1000), (VALUES ('side_to_move'), ('material'), ('castling')) AS v(t)")
def task_per_position(spark, sf_dir, target=3000):
    """One sample per active task and position, in the order of positions, until ``target`` samples are there (the feature)."""
    enough = positions(spark, sf_dir).select("pos_id").orderBy("pos_id").limit(-(-target // len(TASKS)))
    return enough.select("pos_id", F.explode(F.array(*map(F.lit, TASKS))).alias("task"))


@engine_query("l04_dominant", f"SELECT {_KEY}, CASE WHEN m >= 0.1 THEN {list(TERMS)}[p] END AS term, CASE WHEN m >= 0.1 THEN t[p] END AS value FROM (SELECT *, list_position(list_transform(t, lambda x: abs(x)), m) AS p FROM (SELECT *, list_max(list_transform(t, lambda x: abs(x))) AS m FROM (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN list_transform({TERMS_SQL}, lambda x: round(x / 100, 4)) ELSE {TERMS_SQL} END AS t FROM LINES)))")
def dominant_term(df):
    """The term of the largest size, the first of equal ones, and its value; nulls below 0.1."""
    rows = df.withColumn("t", F.when(F.col("l_partkey") % 9 == 0, F.transform(term_vector(), lambda x: F.round(x / 100, 4))).otherwise(term_vector()))
    sizes = F.transform("t", lambda x: F.abs(x))
    rows = rows.withColumn("p", F.when(F.array_max(sizes) >= 0.1, F.array_position(sizes, F.array_max(sizes)).cast("int") - 1))
    return rows.select(*KEYS, F.get(F.array(*map(F.lit, TERMS)), F.col("p")).alias("term"), F.get("t", F.col("p")).alias("value"))


#: What is said of a term that grows or shrinks.
PHRASES = {t: ((f"gains in {t.lower()}", f"is ahead in {t.lower()}", f"makes more of its {t.lower()}"), (f"falls behind in {t.lower()}", f"gives up some {t.lower()}", f"neglects its {t.lower()}", f"has trouble with {t.lower()}")) for t in TERMS}
_LISTS = "[" + ", ".join("[" + ", ".join("[" + ", ".join(f"'{w}'" for w in side) + "]" for side in PHRASES[t]) + "]" for t in TERMS) + "]"
_TERM_AT = f"{TERMS_SQL}[multipv % {len(TERMS)} + 1]"


@engine_query("e14_term_phrase", f"SELECT {_KEY}, {_LISTS}[multipv % {len(TERMS)} + 1][s][{sql_bucket('l_partkey', 'phrase', 840)} % len({_LISTS}[multipv % {len(TERMS)} + 1][s]) + 1] AS phrase FROM (SELECT *, CASE WHEN {_TERM_AT} >= 0 THEN 1 ELSE 2 END AS s FROM LINES)")
def term_phrase(df):
    """A phrase for a term, from those for a gain or for a loss, picked by the key."""
    at = (F.col("multipv") % len(TERMS)).cast("int")
    nested = F.array(*(F.array(*(F.array(*map(F.lit, side)) for side in PHRASES[t])) for t in TERMS))
    said = F.get(F.get(nested, at), F.when(F.get(term_vector(), at) >= 0, 0).otherwise(1))
    return df.select(*KEYS, F.get(said, (bucket(F.col("l_partkey"), "phrase", 840) % F.size(said)).cast("int")).alias("phrase"))


_NULL_FEN = "split_part(fen, ' ', 1) || CASE WHEN split_part(fen, ' ', 2) = 'w' THEN ' b ' ELSE ' w ' END || split_part(fen, ' ', 3) || ' - 0 1'"


@register("e17_threat_lines", f"SELECT l_orderkey AS pos_id, l_linenumber AS multipv, {_NULL_FEN} AS null_fen, cp FROM (SELECT *, cast(l_quantity * 20 - 500 AS BIGINT) AS cp FROM lineitem WHERE l_partkey % 11 <> 0) JOIN ({POSITIONS_SQL}) ON pos_id = l_orderkey WHERE cp > 50")
def threats(spark, sf_dir, least=50):
    """What the other side threatens: the engine's lines for the position with the turn passed, if they win ``least`` or more."""
    lines = engine_lines(spark, sf_dir).where("score_type = 'cp'").where(F.col("score") > least)
    passed = positions(spark, sf_dir).select("pos_id", F.expr(_NULL_FEN).alias("null_fen"))
    return lines.join(passed, "pos_id").select("pos_id", "multipv", "null_fen", F.col("score").cast("long").alias("cp"))


@engine_query("e20_tree_text", """
WITH l AS (SELECT pos_id, multipv, min(move) AS move FROM LINES WHERE multipv <= 3 GROUP BY 1, 2), n AS (
 SELECT pos_id, [multipv] AS path, move FROM l UNION ALL SELECT a.pos_id, [a.multipv, b.multipv], b.move FROM l a JOIN l b ON b.pos_id = a.pos_id + a.multipv
 UNION ALL SELECT a.pos_id, [a.multipv, b.multipv, c.multipv], c.move FROM l a JOIN l b ON b.pos_id = a.pos_id + a.multipv JOIN l c ON c.pos_id = b.pos_id + b.multipv)
SELECT pos_id, string_agg(repeat('  ', len(path)::INTEGER - 1) || move, chr(10) ORDER BY path) AS tree FROM n GROUP BY pos_id""")
def tree_text(df, width=3):
    """The tree of three levels as text, a move a line below the move it answers; 39 lines a position at most."""
    lines = df.where(F.col("multipv") <= width).groupBy("pos_id", "multipv").agg(F.min("move").alias("move"))
    first = lines.select("pos_id", F.array("multipv").alias("path"), "move", (F.col("pos_id") + F.col("multipv")).alias("after"))
    answers = lines.select(F.col("pos_id").alias("after"), F.col("multipv").alias("k"), F.col("move").alias("answer"))
    deeper = lambda level: level.join(answers, "after").select("pos_id", F.array_append("path", F.col("k")).alias("path"), F.col("answer").alias("move"), (F.col("after") + F.col("k")).alias("after"))
    second = deeper(first)
    nodes = reduce(DataFrame.unionByName, (first, second, deeper(second)))
    told = F.transform(F.array_sort(F.collect_list(F.struct("path", "move"))), lambda x: F.concat(F.repeat(F.lit("  "), F.size(x["path"]) - 1), x["move"]))
    return nodes.groupBy("pos_id").agg(F.array_join(told, "\n").alias("tree"))


#: Labels of lines as they come, and as joint records write them (fixed values); what is not known is equal.
LABELS = {"winning for white": "winning for white", "good for white": "good for white", "equal": "equal", "roughly equal": "equal", "good for black": "good for black", "winning for black": "winning for black"}
_SAID = ["Winning for white ", "good for white", "Equal", " roughly equal", "GOOD FOR BLACK", "winning for black", "unclear", ""]


def normal_label(label: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.get(F.array(F.element_at(known, stripped(F.lower(label)))), F.lit(0)), F.lit("equal"))


@engine_query("e24_label_normaliser", f"SELECT {_KEY}, CASE l_partkey % 8 WHEN 0 THEN 'winning for white' WHEN 1 THEN 'good for white' WHEN 4 THEN 'good for black' WHEN 5 THEN 'winning for black' ELSE 'equal' END AS label FROM LINES")
def normaliser(df):
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("l_partkey") % 8).cast("int"))
    return df.select(*KEYS, normal_label(said).alias("label"))


# -- rewards of board reading --

READING = ("captures", "piece_at", "in_check", "count_pieces", "material_count", "piece_positions")


def answer_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[\n,]+"), stripped), lambda x: x != ""))


def line_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(stripped(c), "\n"), stripped), lambda x: x != ""))


def answer_score(task: Column, predicted: Column, gold: Column) -> Column:
    """How right an answer is, by its task: sets by their Jaccard similarity (lists of moves as they are written, squares in any
    case), texts by equality, lines by the share of the right ones; of a list that may be `none`, no answer says the same."""
    share = lambda p, g: F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(p, g)) / F.greatest(F.size(F.array_union(p, g)), F.lit(1)))
    low_p, low_g = answer_set(F.lower(predicted)), answer_set(F.lower(gold))
    none = F.array(F.lit("none"))
    lines = line_set(gold)
    return (
        F.when(task.isin("legal_moves", "captures"), share(answer_set(predicted), answer_set(gold)))
        .when(task == "piece_at", (stripped(F.lower(predicted)) == stripped(F.lower(gold))).cast("double"))
        .when(task.isin("in_check", "attacked_by"), share(low_p, low_g))
        .when(task == "count_pieces", (stripped(predicted) == stripped(gold)).cast("double"))
        .when(task == "material_count", F.when(F.size(lines) == 0, 0.0).otherwise(F.size(F.array_intersect(line_set(predicted), lines)) / F.greatest(F.size(lines), F.lit(1))))
        .when(task == "piece_positions", F.when((F.size(low_g) == 0) | (low_g == none), ((low_p == none) | (F.size(low_p) == 0)).cast("double")).otherwise(share(low_p, low_g)))
        .otherwise(0.0)
    )


# Gold answers from the row's own text (its first words as a list, its length, ...), and answers that are wrong in five ways.
_GOLDS = "CASE conv_id % 6 WHEN 1 THEN {first} WHEN 3 THEN cast(length(own) as string) WHEN 4 THEN 'white: ' || length(own) || {nl} || 'black: ' || turn WHEN 5 THEN CASE WHEN turn % 2 = 0 THEN 'none' ELSE {listed} END ELSE {listed} END"
_ANSWERS = "CASE turn % 5 WHEN 0 THEN gold WHEN 1 THEN lower(gold) WHEN 2 THEN gold || ', extra' WHEN 3 THEN {nl} || ' ' || gold || ' ' ELSE '' END"
_OWN = "SELECT conv_id, turn, coalesce(text, '') AS own FROM conversations"
_READ_SQL = f"(SELECT *, {_ANSWERS.format(nl='chr(10)')} AS predicted FROM (SELECT *, {_GOLDS.format(first=chr(40) + 'string_split(own, chr(32))[1])', nl='chr(10)', listed='array_to_string(string_split(own, chr(32))[1:4], chr(44) || chr(32))')} AS gold FROM ({_OWN})))"
_SET = "list_distinct(list_filter(list_transform(regexp_split_to_array({0}, '[\\n,]+'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> ''))"
_LINES_OF = "list_distinct(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> ''))"


def _sql_share(p: str, g: str) -> str:
    return f"CASE WHEN len({g}) = 0 THEN 0.0 ELSE len(list_intersect({p}, {g}))::DOUBLE / greatest(len(list_distinct(list_concat({p}, {g}))), 1) END"


_LOW = (_SET.format("lower(predicted)"), _SET.format("lower(gold)"))
_SCORE = f"""CASE conv_id % 6 WHEN 0 THEN {_sql_share(_SET.format('predicted'), _SET.format('gold'))} WHEN 1 THEN CASE WHEN trim(lower(predicted), E' \\n') = trim(lower(gold), E' \\n') THEN 1.0 ELSE 0.0 END WHEN 2 THEN {_sql_share(*_LOW)}
 WHEN 3 THEN CASE WHEN trim(predicted, E' \\n') = trim(gold, E' \\n') THEN 1.0 ELSE 0.0 END WHEN 4 THEN len(list_intersect({_LINES_OF.format('predicted')}, {_LINES_OF.format('gold')}))::DOUBLE / greatest(len({_LINES_OF.format('gold')}), 1)
 ELSE CASE WHEN len({_LOW[1]}) = 0 OR {_LOW[1]} = ['none'] THEN CASE WHEN len({_LOW[0]}) = 0 OR {_LOW[0]} = ['none'] THEN 1.0 ELSE 0.0 END ELSE {_sql_share(*_LOW)} END END::DOUBLE"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, own, task, gold, predicted."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("own"))
    rows = rows.withColumn("gold", F.expr(_GOLDS.format(first="get(split(own, ' '), 0)", nl="'\\n'", listed="array_join(slice(split(own, ' '), 1, 4), ', ')")))
    task = F.get(F.array(*map(F.lit, READING)), (F.col("conv_id") % 6).cast("int"))
    return rows.withColumn("task", task).withColumn("predicted", F.expr(_ANSWERS.format(nl="'\\n'")))


@register("r18_answer_score", f"SELECT conv_id, turn, round({_SCORE}, 9) AS score FROM {_READ_SQL}")
def answer_scores(spark, sf_dir):
    return readings(spark, sf_dir).select("conv_id", "turn", F.round(answer_score(F.col("task"), F.col("predicted"), F.col("gold")), 9).alias("score"))


#: The answer in a completion (fixed value).
ANSWER = r"(?si)<answer>(.*?)</answer>"


def length_penalty(text: Column, free: int = 500, cap: int = 6144, most: float = 0.2) -> Column:
    """0 up to ``free`` words, ``most`` from ``cap`` words on, a line between."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return most * F.least(F.lit(1.0), F.greatest(F.lit(0), n - free) / float(cap - free))


def board_reading_rewards(df: DataFrame, group: list[str], order: str, diversity: float = 0.1) -> DataFrame:
    """``df`` (text, task, gold) with ``reward``: 0.01 for an answer, 0.99 times its score, less what length and likeness to the
    other completions of the group cost. A group is what was generated for one prompt, a handful of completions."""
    answer = stripped(F.regexp_extract("text", ANSWER, 1))
    exact = F.when(answer == "", 0.0).otherwise(answer_score(F.col("task"), answer, F.col("gold")))
    alike = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, words(F.col("text")).alias("t")))).alias("xs"))
    alike = alike.select(*group, F.when(F.size("xs") < 2, 0.0).otherwise(mean_jaccard(F.transform("xs", lambda x: x["t"]))).alias("alike"))
    reward = 0.01 * F.col("text").rlike(ANSWER).cast("double") + 0.99 * exact - length_penalty(F.col("text"), 20, 200) - diversity * F.col("alike")
    return df.join(alike, group).withColumn("reward", reward)


_R19 = "CASE WHEN turn % 3 = 2 THEN own ELSE 'I see ' || own || ' <Answer> ' || predicted || ' </answer>' END"
_N_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@register("r19_board_reading_reward", f"""
WITH x AS (SELECT *, {_R19} AS text, turn // 4 AS part FROM {_READ_SQL}), s AS (SELECT conv_id, part, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM x),
j AS (SELECT a.conv_id, a.part, sum(CASE WHEN len(a.t) + len(b.t) = 0 THEN 1000000000 ELSE round(1e9 * (len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t)))))::BIGINT END)::DOUBLE / count(*) / 1e9 AS alike FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.part = b.part AND a.turn < b.turn GROUP BY 1, 2)
SELECT conv_id, turn, round(CASE WHEN turn % 3 = 2 THEN 0.0 ELSE 0.01 + 0.99 * CASE WHEN trim(predicted, E' \\n') = '' THEN 0.0 ELSE {_SCORE.replace('predicted', "trim(predicted, E' \\n')")} END END - 0.2 * least(1.0, greatest(0, {_N_WORDS} - 20) / 180.0) - 0.1 * coalesce(alike, 0), 9) AS reward
FROM x LEFT JOIN j USING (conv_id, part)""")
def board_reading_reward(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 2, F.col("own")).otherwise(F.concat(F.lit("I see "), "own", F.lit(" <Answer> "), "predicted", F.lit(" </answer>")))
    rows = readings(spark, sf_dir).withColumn("text", text).withColumn("part", F.expr("turn div 4"))
    return board_reading_rewards(rows, ["conv_id", "part"], "turn").select("conv_id", "turn", F.round("reward", 9).alias("reward"))


# -- tools and retries --


@engine_query("r22_first_evaluation", f"""
SELECT pos_id, arg_min(score, (multipv, l_partkey, l_suppkey)) FILTER (l_partkey % 5 <> 0 AND score <> 0) AS score, arg_min(move, (multipv, l_partkey, l_suppkey)) FILTER (l_partkey % 5 <> 0 AND l_suppkey % 3 = 0) AS notable FROM LINES GROUP BY pos_id""")
def first_evaluation(df):
    """Of the JSON answers of tools in their order, the first score that is not zero and the first notable term; answers that
    are no JSON, or lack a field, are passed over."""
    said = F.when(F.col("l_partkey") % 5 == 0, F.lit("error: timeout")).otherwise(F.to_json(F.struct(F.struct(F.col("score").cast("long").alias("cp")).alias("eval"), F.when(F.col("l_suppkey") % 3 == 0, F.col("move")).alias("notable"))))
    rows = df.withColumn("said", said)
    score, notable = F.get_json_object("said", "$.eval.cp").try_cast("long"), F.get_json_object("said", "$.notable")
    at = F.struct("multipv", "l_partkey", "l_suppkey")
    first = lambda c, test: F.min_by(c, F.when(test, at))
    return rows.groupBy("pos_id").agg(first(score, score != 0).alias("score"), first(notable, notable.isNotNull()).alias("notable"))


_OK = f"({SQL_CLASS} = 'Unknown' OR abs(coalesce(list_position({list(CLASSES)}, {SQL_CLASS}), 0) - (conv_id % 6 + 1)) <= 0)"


@register("r25_first_valid_attempt", f"SELECT conv_id, min(turn) FILTER (ok AND k <= 3) AS accepted, least(count(*), coalesce(min(k) FILTER (ok AND k <= 3), 3)) AS attempts FROM (SELECT *, {_OK} AS ok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM ({COMPLETIONS_SQL})) GROUP BY conv_id")
def first_valid_attempt(spark, sf_dir, retries=3):
    """Of at most ``retries`` attempts, the first whose verdict agrees with the engine's class; null if none does, and how many
    were made."""
    engine = F.get(F.array(*map(F.lit, CLASSES)), (F.col("conv_id") % 6).cast("int"))
    rows = completions(spark, sf_dir).withColumn("ok", compatible(text_class(F.col("text")), engine, 0)).withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    passed = F.col("ok") & (F.col("k") <= retries)
    return rows.groupBy("conv_id").agg(F.min(F.when(passed, F.col("turn"))).alias("accepted"), F.least(F.count(F.lit(1)), F.coalesce(F.min(F.when(passed, F.col("k"))), F.lit(retries))).alias("attempts"))


# -- prompts --

PREAMBLE = r"(?s)^.*?(?=Question:)"


def benchmark_prompt(template: Column, question: Column, examples: Column, most: int = 3) -> Column:
    """A template without what stands before the question, its placeholders filled; ``most`` examples are shown."""
    shown = F.array_join(F.slice(examples, 1, most), "; ")
    return F.replace(F.replace(F.regexp_replace(template, PREAMBLE, ""), F.lit("{question}"), question), F.lit("{examples}"), shown)


_TEMPLATE = "'You are player ' || turn || '.' || {0} || 'Question: {{question}}' || {0} || 'Examples: {{examples}}'"
scorer("x18_benchmark_prompt", "'Question: ' || text || chr(10) || 'Examples: ' || array_to_string(string_split(text, ' ')[1:3], '; ') AS prompt", prompt=lambda t, n: benchmark_prompt(F.expr(_TEMPLATE.format("'\\n'")), t, F.split(t, " ")))


@position_query("x15_joint_prompt", "prompt string", sql=f"SELECT r.pos_id, '## Position' || chr(10) || r.fen || chr(10) || '## Move' || chr(10) || coalesce(san, '-') || chr(10) || '## Facts' || chr(10) || CASE WHEN uci IS NULL THEN 'none' ELSE array_to_string({_FACTS}, '; ') END AS prompt FROM rows_ r LEFT JOIN ch USING (pos_id)", choice=1)
def joint_prompt(fen, pick):
    p = position(fen)
    m = chosen(p, pick)
    facts = "; ".join(move_facts(p, m)) if m else "none"
    return (f"## Position\n{fen}\n## Move\n{p.san(m) if m else '-'}\n## Facts\n{facts}",)


@position_query("x16_puzzle_trace", "prompt string, trace string", sql=f"SELECT r.pos_id, CASE WHEN uci IS NULL THEN r.fen ELSE 'FEN: ' || r.fen || chr(10) || CASE WHEN white THEN 'White' ELSE 'Black' END || ' to move.' END AS prompt, CASE WHEN uci IS NULL THEN '' ELSE '<think>' || array_to_string({_FACTS}, '; ') || '</think>{{\"move\": \"' || uci || '\"}}' END AS trace FROM rows_ r LEFT JOIN ch USING (pos_id)", choice=1)
def puzzle_trace(fen, pick):
    p = position(fen)
    m = chosen(p, pick)
    if m is None:
        return fen, ""
    return f"FEN: {fen}\n{'White' if p.white else 'Black'} to move.", f"<think>{'; '.join(move_facts(p, m))}</think>{{\"move\": \"{uci(m)}\"}}"


_NAMED = lambda c: f"'{c}: ' || coalesce(nullif(array_to_string({c}, ', '), ''), 'none')"


@position_query("x17_inline_moves", "text string", sql=with_threats(f"SELECT r.pos_id, {_NAMED('checks')} || '; ' || {_NAMED('captures')} || '; ' || {_NAMED('threats')} AS text FROM rows_ r LEFT JOIN cct5 USING (fen)"))
def inline_moves(fen):
    found = checks_captures_threats(position(fen))
    return ("; ".join(f"{k}: {', '.join(v) or 'none'}" for k, v in found.items()),)
