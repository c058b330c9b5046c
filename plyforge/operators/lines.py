"""Whole analyses of a position, and the records made from them: position > lines > plies as nested arrays.

A table of plies (a row a ply of a line) meets by position once; lines are put in order inside that shuffle, and everything after is
expressions over the nested array, so no row holds more than one position, and no position is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.dialect import DUCK, SPARK
from plyforge.operators.engine import LINES_SQL, TERMS, TERMS_SQL, WORDS, compared, engine_lines, eval_label, label_sql, move_class, class_sql, term_vector
from plyforge.operators.features import ascii_board, decoded, phase
from plyforge.operators.readers import PHRASES
from plyforge.operators.records import bucket, sql_bucket, table
from plyforge.plans.registry import ORACLES, register
from plyforge.sources.positions import POSITIONS_SQL, positions, quoted

#: Terms of a ply that are told, and their least size (fixed values).
MOST_TERMS, LEAST = 3, 0.10
#: From these spreads on (in centipawns): plies of a line, lines beside the played one (fixed values).
BREADTH = ((200, 6, 5), (100, 6, 4), (50, 5, 3), (None, 4, 2))
#: Engine assessments as prompts write them (fixed values).
ASSESSED = {"equal": "roughly equal", None: "a forced mate sequence exists"}
SYSTEM = "You are a chess coach. Think through the engine's lines, then comment on the student's move."
TASK = "## Task\n\nAnalyse each engine key line using the SF15 eval term changes shown, then give a coaching comment to the student about their move."
NONE = "(no notable term changes)"


def told_terms(terms: Column) -> Column:
    """array of (name, v): the largest terms of a vector, by (size, name) descending."""
    named = F.transform(F.arrays_zip(terms.alias("v"), F.array(*map(F.lit, TERMS)).alias("name")), lambda x: F.struct(F.abs(x["v"]).alias("size"), x["name"].alias("name"), x["v"].alias("v")))
    top = F.slice(F.sort_array(F.filter(named, lambda x: x["size"] >= LEAST), asc=False), 1, MOST_TERMS)
    return F.transform(top, lambda x: F.struct(x["name"].alias("name"), x["v"].alias("v")))


def interpreted(key: Column, terms: Column, salt: str) -> Column:
    """A phrase for the first term and one for the second, picked by a key."""
    pool = F.create_map(*(x for t in TERMS for x in (F.lit(t), F.array(*(F.array(*map(F.lit, side)) for side in PHRASES[t])))))

    def phrase(k: int) -> Column:
        term = F.get(terms, F.lit(k))
        said = F.get(F.element_at(pool, term["name"]), F.when(term["v"] >= 0, 0).otherwise(1))
        return F.when(F.size(terms) > k, F.get(said, (bucket(key, f"{salt}{k}", 840) % F.size(said)).cast("int")))

    return F.concat_ws(", ", phrase(0), phrase(1))


def _signed(term: Column) -> Column:
    return F.concat(F.lower(term["name"]), F.when(term["v"] >= 0, " +").otherwise(" −"), F.format_string("%.2f", F.abs(term["v"])))


#: What is said of a ply: shown in prompts, told in thinking, net of a line that it begins.
SAID = ("shown", "told", "net")


def plies(lines: DataFrame, only: tuple[str, ...] = SAID) -> DataFrame:
    """``lines`` with what is said of each ply: of SAID those in ``only``."""
    if not only:
        return lines
    rows = lines.withColumn("terms", term_vector()).withColumn("top", told_terms(F.col("terms")))
    key = F.concat(F.col("pos_id").cast("string"), F.lit(":"), "move")
    signed = F.transform("top", _signed)
    said = {
        "shown": F.when(F.size("top") > 0, F.concat("move", F.lit(" ["), F.array_join(signed, "; "), F.lit("]"))).otherwise(F.col("move")),
        "told": F.concat(F.lit("    "), "move", F.lit(": "), F.when(F.size("top") > 0, F.concat(F.array_join(signed, ", "), F.lit(" → "), interpreted(key, F.col("top"), "ply"))).otherwise(NONE)),
        "net": F.when(F.size("top") > 0, F.concat(F.lit("    net: "), interpreted(key, F.col("top"), "net"))),
    }
    return rows.withColumns({c: said[c] for c in only})


PLY = ("l_partkey", "l_suppkey", "l_extendedprice")
#: Parts that a split of the input is dealt to: plies are sorted with what is said of them, far wider than in the file.
PARTS = 32


def analysed(lines: DataFrame, only: tuple[str, ...] = SAID) -> DataFrame:
    """pos_id, root_cp, spread, lines: array by multipv of (multipv, cp, label, plies: array of (move, and of SAID those in ``only``)).

    A line's score is its first ply's, in white's view; cp is null for a mate. The spread is that of the lines with a cp.
    """
    one = F.struct(*PLY, "move", "score_type", "score", *only)
    # Dealt by position, narrow as they come, plies are told and grouped twice in one place. A fixed number of parts is not
    # put together again by their size before the telling.
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS * lines.rdd.getNumPartitions())
    dealt = lines.select("pos_id", "multipv", *PLY, "move", "score_type", "score").repartition(parts, "pos_id")
    by_line = plies(dealt, only).groupBy("pos_id", "multipv").agg(F.sort_array(F.collect_list(one)).alias("plies"))
    first = F.get("plies", F.lit(0))
    cp = F.when(first["score_type"] == "cp", first["score"])
    mate = F.when(first["score"] > 0, WORDS[0]).otherwise(WORDS[4])
    line = F.struct("multipv", cp.alias("cp"), F.coalesce(F.when(cp.isNotNull(), eval_label(cp, "data")), mate).alias("label"), F.transform("plies", lambda p: F.struct(*(p[c].alias(c) for c in ("move", *only)))).alias("plies"))
    whole = by_line.select("pos_id", line.alias("line")).groupBy("pos_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    cps = F.filter(F.transform("lines", lambda x: x["cp"]), lambda c: c.isNotNull())
    spread = F.when(F.size(cps) >= 2, F.array_max(cps) - F.array_min(cps)).otherwise(0)
    return whole.select("pos_id", F.get("lines", F.lit(0))["cp"].alias("root_cp"), spread.cast("long").alias("spread"), "lines")


def step(at: int) -> Column:
    """Plies of a line (1), lines beside the played one (2), by the spread."""
    out = F.when(F.col("spread") >= BREADTH[0][0], BREADTH[0][at])
    for row in BREADTH[1:-1]:
        out = out.when(F.col("spread") >= row[0], row[at])
    return out.otherwise(BREADTH[-1][at])


def reviewed(analysis: DataFrame, played: DataFrame) -> DataFrame:
    """``played`` (pos_id, fen, turn, phase, board, move) with played line, lines beside it, loss and class of the move.

    A move that no line begins with is a line of its own, of which nothing is known.
    """
    only = [c for c in analysis.schema["lines"].dataType.elementType["plies"].dataType.elementType.names if c != "move"]
    rows = played.join(analysis, "pos_id")
    own = F.get(F.filter("lines", lambda x: F.get(x["plies"], F.lit(0))["move"] == F.col("move")), F.lit(0))
    none = F.lit(None).cast("string")
    unknown = {"move": F.col("move"), "shown": F.col("move"), "told": F.concat(F.lit("    "), "move", F.lit(f": {NONE}")), "net": none}
    alone = F.array(F.struct(*(unknown[c].alias(c) for c in ("move", *only))))
    others = F.filter("lines", lambda x: F.get(x["plies"], F.lit(0))["move"] != F.col("move"))
    rows = rows.withColumns({"depth": step(1), "own": own}).withColumns({
        "played": F.slice(F.coalesce(F.col("own")["plies"], alone), F.lit(1), F.col("depth")), "student_cp": F.col("own")["cp"],
        "beside": F.transform(F.slice(others, F.lit(1), step(2)), lambda x: F.struct(F.slice(x["plies"], F.lit(1), F.col("depth")).alias("plies"), x["label"].alias("label"), x["cp"].alias("cp"))),
    })
    loss = F.greatest(F.when(F.col("turn") == "w", 1).otherwise(-1) * (F.col("root_cp") - F.col("student_cp")), F.lit(0))
    known = F.col("root_cp").isNotNull() & F.col("student_cp").isNotNull()
    return rows.withColumn("cp_loss", F.when(known, loss).otherwise(0).cast("long")).withColumn("class", F.when(known, move_class(F.col("cp_loss"), "data")).otherwise("good"))


def thinking() -> Column:
    """The block of thinking of a reviewed move: position, class, every line with its plies and net, verdict, focus."""
    side = F.when(F.col("turn") == "w", "white").otherwise("black")
    rated = F.when(F.col("root_cp").isNull(), "forced mate").otherwise(eval_label(F.col("root_cp"), "data"))
    line = lambda name, ps, label: F.concat_ws("\n", F.concat(F.lit("  "), name, F.lit(": "), F.array_join(F.transform(ps, lambda p: p["move"]), " → "), F.lit(" | eval: "), label), F.array_join(F.transform(ps, lambda p: p["told"]), "\n"), F.get(ps, F.lit(0))["net"], F.lit(""))
    best = F.get(F.get("beside", F.lit(0))["plies"], F.lit(0))["move"]
    better = F.concat(F.lit(". "), best, F.lit(" was better"), F.coalesce(F.when(F.get("beside", F.lit(0))["cp"].isNotNull(), F.concat(F.lit(" ("), F.get("beside", F.lit(0))["label"], F.lit(")"))), F.lit("")))
    told = F.concat("move", F.lit(" is "), "class")
    verdict = F.when(F.col("root_cp").isNull() | (F.size("beside") == 0), F.concat(told, F.lit("."))).when(F.col("cp_loss") == 0, F.concat("move", F.lit(" best."))).otherwise(F.concat(told, better, F.lit(".")))
    focus = (
        F.when(F.col("class").isin("best", "great"), F.concat(F.lit("reinforce the idea behind "), "move", F.lit(" — student played well.")))
        .when(F.col("class") == "good", F.concat(F.lit("note "), "move", F.lit(" is solid; briefly mention what "), F.coalesce(best, F.lit("the engine")), F.lit(" achieves differently.")))
        .otherwise(F.concat(F.lit("explain why "), F.coalesce(best, F.lit("the engine's suggestion")), F.lit(" is stronger and what concept "), "move", F.lit(" misses.")))
    )
    played = F.coalesce(F.when(F.col("student_cp").isNotNull(), eval_label(F.col("student_cp"), "data")), F.lit("equal"))
    return F.concat_ws(
        "\n", F.concat(F.lit("POSITION: "), "phase", F.lit(" | "), side, F.lit(" to move | eval: "), rated), F.concat(F.lit("CLASSIFICATION: "), told), F.lit(""), F.lit("LINE analysis:"),
        line(F.lit("PLAYED"), F.col("played"), played),
        F.when(F.size("beside") > 0, F.array_join(F.transform("beside", lambda x, i: line(F.concat(F.lit("LINE "), (i + 1).cast("string")), x["plies"], x["label"])), "\n")),
        F.concat(F.lit("VERDICT: "), verdict), F.concat(F.lit("COACHING FOCUS: "), focus),
    )


def user_prompt() -> Column:
    rated = F.coalesce(F.when(eval_label(F.col("root_cp"), "data") == "equal", ASSESSED["equal"]).otherwise(F.when(F.col("root_cp").isNotNull(), eval_label(F.col("root_cp"), "data"))), F.lit(ASSESSED[None]))
    shown = lambda ps: F.array_join(F.transform(ps, lambda p: p["shown"]), " → ")
    key_lines = F.concat_ws("\n", F.concat(F.lit("PLAYED LINE: "), shown(F.col("played"))), F.when(F.size("beside") > 0, F.array_join(F.transform("beside", lambda x, i: F.concat(F.lit("Line "), (i + 1).cast("string"), F.lit(": "), shown(x["plies"]))), "\n")))
    return F.concat(F.lit("## Position\n\nBoard before the move:\n"), "board", F.lit("\nFEN: "), "fen", F.lit("\n\n## Move Played\n\nMove: "), "move", F.lit("\nEngine assessment: "), rated, F.lit("\n\n## Engine Key Lines\n\n"), key_lines, F.lit("\n\n"), F.lit(TASK))


def joint_records(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """pos_id, messages (system, user, assistant), metadata of every reviewed move that has a comment (pos_id, comment); others are no sample."""
    rows = reviews.join(comments, "pos_id")
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    answer = F.concat(F.lit("<think>\n"), thinking(), F.lit("\n</think>\n\n"), "comment")
    facts = F.struct(F.lit("textbook_joint_sft").alias("source"), "fen", F.col("move").alias("move_san"), F.col("class").alias("classification"), "cp_loss", F.col("spread").alias("spread_cp"), (F.size("beside") + 1).alias("n_lines"))
    return rows.select("pos_id", F.array(said("system", F.lit(SYSTEM)), said("user", user_prompt()), said("assistant", answer)).alias("messages"), facts.alias("metadata"))


# -- queries: plies of a line are the rows of lineitem with its number; the move of a position is one of nine --


def studied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(positions(spark, sf_dir)).select("pos_id", "fen", "turn", F.expr(phase(SPARK)).alias("phase"), F.expr(ascii_board(SPARK)).alias("board"))
    return rows.withColumn("move", F.concat(F.lit("m"), (F.col("pos_id") % 9).cast("string")))


_TOP = f"list_reverse(list_sort(list_filter(list_transform(range(1, {len(TERMS) + 1}), lambda i: {{'size': abs(t[i]), 'name': {list(TERMS)}[i], 'v': t[i]}}), lambda x: x.size >= {LEAST})))[1:{MOST_TERMS}]"
_SHOW = "list_transform(top, lambda x: lower(x.name) || CASE WHEN x.v >= 0 THEN ' +' ELSE ' −' END || printf('%.2f', abs(x.v)))"
_POOL = "CASE top[{k}].name " + " ".join(f"WHEN {quoted(t)} THEN CASE WHEN top[{{k}}].v >= 0 THEN [{', '.join(map(quoted, PHRASES[t][0]))}] ELSE [{', '.join(map(quoted, PHRASES[t][1]))}] END" for t in TERMS) + " END"


def _phrases(salt: str) -> str:
    one = lambda k: f"({_POOL.format(k=k + 1)})[{sql_bucket('key', f'{salt}{k}', 840)} % len({_POOL.format(k=k + 1)}) + 1]"
    return f"{one(0)} || CASE WHEN len(top) > 1 THEN ', ' || {one(1)} ELSE '' END"


_STEP = lambda at: "CASE " + " ".join(f"WHEN spread >= {row[0]} THEN {row[at]}" for row in BREADTH[:-1]) + f" ELSE {BREADTH[-1][at]} END"
#: The same by rows: plies, lines and positions are tables, put together by ordered aggregates.
STEPS_SQL = f"""
WITH ply_terms AS (SELECT *, {_TOP} AS top FROM (SELECT *, pos_id || ':' || move AS key, {TERMS_SQL} AS t FROM {LINES_SQL})),
ply_rows AS (
  SELECT pos_id, multipv, score_type, score, move, row_number() OVER (PARTITION BY pos_id, multipv ORDER BY l_partkey, l_suppkey, l_extendedprice, move) AS k,
    move || CASE WHEN len(top) > 0 THEN ' [' || array_to_string({_SHOW}, '; ') || ']' ELSE '' END AS shown,
    '    ' || move || ': ' || CASE WHEN len(top) > 0 THEN array_to_string({_SHOW}, ', ') || ' → ' || {_phrases('ply')} ELSE '{NONE}' END AS told,
    CASE WHEN len(top) > 0 THEN '    net: ' || {_phrases('net')} END AS net FROM ply_terms),
heads AS (
  SELECT pos_id, multipv, move AS head, CASE WHEN score_type = 'cp' THEN score END AS cp,
    CASE WHEN score_type = 'cp' THEN {label_sql('score', 'data')} WHEN score > 0 THEN '{WORDS[0]}' ELSE '{WORDS[4]}' END AS label,
    row_number() OVER (PARTITION BY pos_id ORDER BY multipv) AS rn FROM ply_rows WHERE k = 1),
sums AS (SELECT pos_id, max(cp) FILTER (rn = 1) AS root_cp, CASE WHEN count(cp) >= 2 THEN max(cp) - min(cp) ELSE 0 END::BIGINT AS spread FROM heads GROUP BY pos_id)
"""
REVIEW_SQL = f"""{STEPS_SQL},
studied AS (SELECT pos_id, fen, turn, {phase(DUCK)} AS phase, {ascii_board(DUCK)} AS board, 'm' || (pos_id % 9) AS move FROM {DUCK.decoded(f'({POSITIONS_SQL})')}),
seen AS (SELECT p.*, root_cp, spread, {_STEP(1)} AS depth, {_STEP(2)} AS breadth FROM studied p JOIN sums USING (pos_id)),
own AS (SELECT s.pos_id, min(multipv) AS multipv FROM seen s JOIN heads h ON h.pos_id = s.pos_id AND h.head = s.move GROUP BY s.pos_id),
beside AS (SELECT * FROM (SELECT h.*, breadth, row_number() OVER (PARTITION BY h.pos_id ORDER BY h.multipv) AS place FROM heads h JOIN seen s ON s.pos_id = h.pos_id AND h.head <> s.move) WHERE place <= breadth),
wanted AS (SELECT pos_id, multipv, 0 AS place, NULL AS label FROM own UNION ALL SELECT pos_id, multipv, place, label FROM beside),
drawn AS (
  SELECT w.pos_id, w.place, any_value(w.label) AS label, string_agg(p.move, ' → ' ORDER BY k) AS moves, string_agg(p.shown, ' → ' ORDER BY k) AS shown,
    string_agg(p.told, chr(10) ORDER BY k) || coalesce(chr(10) || max(net) FILTER (k = 1), '') || chr(10) AS told
  FROM wanted w JOIN seen s USING (pos_id) JOIN ply_rows p ON p.pos_id = w.pos_id AND p.multipv = w.multipv AND p.k <= s.depth GROUP BY w.pos_id, w.place),
grown AS (
  SELECT pos_id, string_agg('  LINE ' || place || ': ' || moves || ' | eval: ' || label || chr(10) || told, chr(10) ORDER BY place) AS told,
    string_agg('Line ' || place || ': ' || shown, chr(10) ORDER BY place) AS shown, count(*) AS n FROM drawn WHERE place > 0 GROUP BY pos_id),
joined AS (
  SELECT s.*, o.cp AS student_cp, coalesce(d.moves, s.move) AS own_moves, coalesce(d.shown, s.move) AS own_shown, coalesce(d.told, '    ' || s.move || ': {NONE}' || chr(10)) AS own_told,
    g.told AS beside_told, g.shown AS beside_shown, coalesce(g.n, 0) AS n_beside, b.head AS best, b.cp AS best_cp, b.label AS best_label
  FROM seen s LEFT JOIN own USING (pos_id) LEFT JOIN heads o ON o.pos_id = own.pos_id AND o.multipv = own.multipv
  LEFT JOIN drawn d ON d.pos_id = s.pos_id AND d.place = 0 LEFT JOIN grown g ON g.pos_id = s.pos_id LEFT JOIN beside b ON b.pos_id = s.pos_id AND b.place = 1),
lost AS (SELECT *, root_cp IS NOT NULL AND student_cp IS NOT NULL AS known, coalesce(greatest(0, CASE WHEN turn = 'w' THEN 1 ELSE -1 END * (root_cp - student_cp)), 0)::BIGINT AS cp_loss FROM joined),
reviews AS (SELECT * EXCLUDE (cp_loss), CASE WHEN known THEN cp_loss ELSE 0 END AS cp_loss, CASE WHEN known THEN {class_sql('cp_loss', 'data')} ELSE 'good' END AS class FROM lost),
blocks AS (
  SELECT *, 'POSITION: ' || phase || ' | ' || CASE WHEN turn = 'w' THEN 'white' ELSE 'black' END || ' to move | eval: ' || CASE WHEN root_cp IS NULL THEN 'forced mate' ELSE {label_sql('root_cp', 'data')} END
    || chr(10) || 'CLASSIFICATION: ' || move || ' is ' || class || chr(10) || chr(10) || 'LINE analysis:' || chr(10)
    || '  PLAYED: ' || own_moves || ' | eval: ' || CASE WHEN student_cp IS NULL THEN 'equal' ELSE {label_sql('student_cp', 'data')} END || chr(10) || own_told || chr(10) || coalesce(beside_told || chr(10), '')
    || 'VERDICT: ' || CASE WHEN root_cp IS NULL OR n_beside = 0 THEN move || ' is ' || class || '.' WHEN cp_loss = 0 THEN move || ' best.'
      ELSE move || ' is ' || class || '. ' || best || ' was better' || CASE WHEN best_cp IS NULL THEN '' ELSE ' (' || best_label || ')' END || '.' END
    || chr(10) || 'COACHING FOCUS: ' || CASE WHEN class IN ('best', 'great') THEN 'reinforce the idea behind ' || move || ' — student played well.'
      WHEN class = 'good' THEN 'note ' || move || ' is solid; briefly mention what ' || coalesce(best, 'the engine') || ' achieves differently.'
      ELSE 'explain why ' || coalesce(best, 'the engine''s suggestion') || ' is stronger and what concept ' || move || ' misses.' END AS block FROM reviews)
"""


@register("e12_line_analysis", f"""{STEPS_SQL}
SELECT pos_id, root_cp, spread, string_agg(head || ':' || coalesce(cp::VARCHAR, 'mate'), ' ' ORDER BY multipv) AS candidates, string_agg(moves || ' | ' || label, '; ' ORDER BY multipv) AS lines
FROM sums JOIN heads USING (pos_id) JOIN (SELECT pos_id, multipv, string_agg(move, ' ' ORDER BY k) AS moves FROM ply_rows GROUP BY pos_id, multipv) USING (pos_id, multipv) GROUP BY pos_id, root_cp, spread""")  # fmt: skip
def line_analysis(spark, sf_dir):
    a = analysed(engine_lines(spark, sf_dir), ())
    candidate = lambda x: F.concat(F.get(x["plies"], F.lit(0))["move"], F.lit(":"), F.coalesce(x["cp"].cast("string"), F.lit("mate")))
    line = lambda x: F.concat(F.array_join(F.transform(x["plies"], lambda p: p["move"]), " "), F.lit(" | "), x["label"])
    return a.select("pos_id", "root_cp", "spread", F.array_join(F.transform("lines", candidate), " ").alias("candidates"), F.array_join(F.transform("lines", line), "; ").alias("lines"))


#: What a prompt is told about a move of a class, without its score; {0} is the best move (fixed values).
HINTS = {
    "Great": ("This is a very strong move.",), "Good": ("This is a reasonable move.",), "Inaccuracy": ("This move is slightly imprecise.", "Consider {0} as an alternative."),
    "Mistake": ("This move has some problems.", "The engine prefers {0}."), "Blunder": ("This move is a significant error.", "The correct move is {0}."),
}
TOP, REFUTATION = "This is the engine's top choice.", 5


def context_hints(compared: DataFrame, analysis: DataFrame) -> DataFrame:
    """Of compared moves, what prompts may say: class, whether it is the best, hints, and the first plies of the best line."""
    kind = move_class(F.col("cp_loss"), "verifier")
    told = F.when(F.col("user_move") == F.col("best_move"), F.array(F.lit(TOP)))
    for name, texts in HINTS.items():
        told = told.when(kind == name, F.array(*(F.concat(F.lit(x.split("{0}")[0]), "best_move", F.lit(x.split("{0}")[1])) if "{0}" in x else F.lit(x) for x in texts)))
    line = F.slice(F.transform(F.get("lines", F.lit(0))["plies"], lambda p: p["move"]), 1, REFUTATION)
    rows = compared.join(analysis.select("pos_id", line.alias("refutation")), "pos_id")
    return rows.select("pos_id", kind.alias("classification"), (F.col("user_move") == F.col("best_move")).alias("is_best"), "best_move", F.coalesce(told, F.array().cast("array<string>")).alias("hints"), "refutation")


_SQL_HINT = lambda x: " || best_move || ".join(quoted(part) for part in x.split("{0}"))
_SQL_HINTS = f"CASE WHEN user_move = best_move THEN {quoted(TOP)} " + " ".join(f"WHEN {class_sql('cp_loss', 'verifier')} = '{k}' THEN {' || chr(10) || '.join(map(_SQL_HINT, texts))}" for k, texts in HINTS.items()) + " ELSE '' END"


@register("e21_context_hints", f"""{STEPS_SQL}, compared AS ({ORACLES['e04_compare_moves']}),
best AS (SELECT pos_id, string_agg(move, ' ' ORDER BY k) AS refutation FROM ply_rows JOIN (SELECT pos_id, multipv FROM heads WHERE rn = 1) USING (pos_id, multipv) WHERE k <= {REFUTATION} GROUP BY pos_id)
SELECT pos_id, {class_sql('cp_loss', 'verifier')} AS classification, user_move = best_move AS is_best, best_move, {_SQL_HINTS} AS hints, refutation FROM compared JOIN best USING (pos_id)""")  # fmt: skip
def hints(spark, sf_dir):
    rows = engine_lines(spark, sf_dir)
    return context_hints(compared(rows), analysed(rows, ())).withColumns({"hints": F.array_join("hints", "\n"), "refutation": F.array_join("refutation", " ")})


@register("e15_thinking_block", f"{REVIEW_SQL} SELECT pos_id, block FROM blocks")
def thinking_block(spark, sf_dir):
    return reviewed(analysed(engine_lines(spark, sf_dir), ("told", "net")), studied(spark, sf_dir)).select("pos_id", thinking().alias("block"))


@register("e16_joint_record", rf"""{REVIEW_SQL}
SELECT pos_id, '## Position' || chr(10) || chr(10) || 'Board before the move:' || chr(10) || board || chr(10) || 'FEN: ' || fen || chr(10) || chr(10) || '## Move Played' || chr(10) || chr(10) || 'Move: ' || move
    || chr(10) || 'Engine assessment: ' || CASE WHEN root_cp IS NULL THEN '{ASSESSED[None]}' ELSE replace({label_sql('root_cp', 'data')}, 'equal', '{ASSESSED['equal']}') END
    || chr(10) || chr(10) || '## Engine Key Lines' || chr(10) || chr(10) || 'PLAYED LINE: ' || own_shown || coalesce(chr(10) || beside_shown, '') || chr(10) || chr(10) || {quoted(TASK)} AS user_text,
  '<think>' || chr(10) || block || chr(10) || '</think>' || chr(10) || chr(10) || comment AS answer, class AS classification, cp_loss, spread AS spread_cp, (n_beside + 1)::INTEGER AS n_lines
FROM blocks JOIN (SELECT doc_id AS pos_id, left(md5(text), 8) || ' by ' || lang AS comment FROM documents WHERE text <> '' AND lang IS NOT NULL) USING (pos_id)""")  # fmt: skip
def joint_record(spark, sf_dir):
    """Samples of the positions that have a comment (here a short one made from a document)."""
    comments = table(spark, sf_dir, "documents").where("text <> '' and lang is not null").select(F.col("doc_id").alias("pos_id"), F.concat(F.left(F.md5("text"), F.lit(8)), F.lit(" by "), "lang").alias("comment"))
    rows = joint_records(reviewed(analysed(engine_lines(spark, sf_dir)), studied(spark, sf_dir)), comments)
    return rows.select("pos_id", F.get("messages", F.lit(1))["content"].alias("user_text"), F.get("messages", F.lit(2))["content"].alias("answer"), *(F.col("metadata")[c].alias(c) for c in ("classification", "cp_loss", "spread_cp", "n_lines")))
