"""Analytics over engine output that comes as a table.

``engine_lines`` is a long table: position, depth, multipv, score type and value, win/draw/loss, moves of the line. The
queries build one from ``lineitem`` (an order is a position, a line number a multipv), so that they run at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.plans.registry import register

LINES_SQL = """(SELECT l_orderkey AS pos_id, l_linenumber AS multipv, 10 + l_partkey % 12 AS depth, CASE WHEN l_partkey % 11 = 0 THEN 'mate' ELSE 'cp' END AS score_type,
  CASE WHEN l_partkey % 11 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END * (1 + l_suppkey % 6) ELSE cast(l_quantity * 20 - 500 AS BIGINT) END AS score,
  CASE WHEN l_partkey % 3 = 0 THEN 1000 - 10 * (l_partkey % 90) END AS win, 'm' || (l_partkey % 9) AS move, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""


def engine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    mate = F.col("l_partkey") % 11 == 0
    signed = F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1) * (1 + F.col("l_suppkey") % 6)
    return li.select(
        F.col("l_orderkey").alias("pos_id"), F.col("l_linenumber").alias("multipv"), (10 + F.col("l_partkey") % 12).alias("depth"), F.when(mate, "mate").otherwise("cp").alias("score_type"),
        F.when(mate, signed).otherwise((F.col("l_quantity") * 20 - 500).cast("long")).alias("score"), F.when(F.col("l_partkey") % 3 == 0, 1000 - 10 * (F.col("l_partkey") % 90)).alias("win"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 9).cast("string")).alias("move"), "l_partkey", "l_suppkey", "l_extendedprice",
    )


def engine_query(key: str, oracle: str | None):
    def put(fn):
        register(key, None if oracle is None else oracle.replace("LINES", LINES_SQL))(lambda spark, sf_dir: fn(engine_lines(spark, sf_dir)))
        return fn

    return put


KEY = "pos_id, multipv, l_partkey, l_suppkey"
KEYS = ["pos_id", "multipv", "l_partkey", "l_suppkey"]


def effective_cp(mate_cp: int = 2000) -> Column:
    return F.when(F.col("score_type") == "cp", F.col("score")).when(F.col("score") > 0, mate_cp).when(F.col("score") < 0, -mate_cp).otherwise(0)


CP_SQL = "CASE WHEN score_type = 'cp' THEN score WHEN score > 0 THEN 2000 WHEN score < 0 THEN -2000 ELSE 0 END"


@engine_query("e01_effective_cp", f"SELECT {KEY}, {CP_SQL} AS cp FROM LINES")
def effective(df):
    return df.select(*KEYS, effective_cp().alias("cp"))


def win_probability() -> Column:
    by_cp = 0.5 + 0.5 * (2 / (1 + F.exp(-0.00368208 * F.col("score"))) - 1)
    by_mate = F.when(F.col("score") > 0, 1.0).otherwise(0.0)
    return F.coalesce(F.col("win") / 1000.0, F.when(F.col("score_type") == "mate", by_mate).otherwise(by_cp))


WP_SQL = "coalesce(win / 1000.0, CASE WHEN score_type = 'mate' THEN CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + 0.5 * (2 / (1 + exp(-0.00368208 * score)) - 1) END)::DOUBLE"


@engine_query("e02_win_probability", f"SELECT {KEY}, {WP_SQL} AS wp FROM LINES")
def win(df):
    return df.select(*KEYS, win_probability().cast("double").alias("wp"))


def score_text() -> Column:
    return F.when(F.col("score_type") == "mate", F.concat(F.when(F.col("score") < 0, "-M").otherwise("M"), F.abs("score").cast("string"))).otherwise(F.format_string("%+.2f", F.col("score") / 100.0))


@engine_query("e03_score_text", f"SELECT {KEY}, CASE WHEN score_type = 'mate' THEN CASE WHEN score < 0 THEN '-M' ELSE 'M' END || abs(score) ELSE CASE WHEN score >= 0 THEN '+' ELSE '-' END || printf('%.2f', abs(score) / 100.0) END AS text FROM LINES")
def texts(df):
    return df.select(*KEYS, score_text().alias("text"))


#: Cut-offs of the move classes, by variant (fixed values); the last class takes the rest.
CLASSES = {
    "compare": ((10, "Great"), (30, "Good"), (80, "Inaccuracy"), (150, "Mistake"), (None, "Blunder")),
    "verifier": ((10, "Best"), (30, "Great"), (80, "Good"), (150, "Inaccuracy"), (300, "Mistake"), (None, "Blunder")),
    "data": ((0, "best"), (10, "great"), (30, "good"), (100, "inaccuracy"), (300, "mistake"), (None, "blunder")),
    "server": ((0, "Best"), (10, "Great"), (30, "Good"), (100, "Inaccuracy"), (300, "Mistake"), (None, "Blunder")),
}


def move_class(loss: Column, variant: str) -> Column:
    steps = CLASSES[variant]
    out = F.when(loss <= steps[0][0], steps[0][1])
    for most, name in steps[1:-1]:
        out = out.when(loss <= most, name)
    return out.otherwise(steps[-1][1])


def class_sql(loss: str, variant: str) -> str:
    return "CASE " + " ".join(f"WHEN {loss} <= {m} THEN '{n}'" for m, n in CLASSES[variant][:-1]) + f" ELSE '{CLASSES[variant][-1][1]}' END"


_ORDER = "(multipv, l_partkey, l_suppkey, move, score)"
# The draws of a line are half of what is not won, so its losses are the other half.
_SIDES = f"SELECT pos_id, arg_min({{'t': score_type, 's': score, 'w': win, 'm': move}}, {_ORDER}) AS best, arg_max(move, {_ORDER}) AS played FROM LINES GROUP BY pos_id"
_WP = "coalesce({w}, CASE WHEN {t} = 'mate' THEN CASE WHEN {s} > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + 0.5 * (2 / (1 + exp(-0.00368208 * {s})) - 1) END)::DOUBLE"


@engine_query("e04_compare_moves", f"""
WITH sides AS ({_SIDES}),
met AS (SELECT a.pos_id, a.played, a.best AS b, {{'t': r.best.t, 's': -r.best.s, 'w': (1000 - r.best.w - (1000 - r.best.w) // 2) / 1000.0}} AS u FROM sides a JOIN sides r ON r.pos_id = a.pos_id + 1),
lost AS (SELECT *, CASE WHEN b.t = 'cp' AND u.t = 'cp' THEN b.s - u.s ELSE 0 END AS cp_loss, round({_WP.format(w='b.w / 1000.0', t='b.t', s='b.s')} - {_WP.format(w='u.w', t='u.t', s='u.s')}, 4) + 0.0 AS wp_loss FROM met)
SELECT pos_id, played AS user_move, b.m AS best_move, cp_loss::BIGINT AS cp_loss, wp_loss, CASE WHEN played = b.m THEN 'Best' ELSE {class_sql('cp_loss', 'compare')} END AS class FROM lost""")
def compared(df):
    """A move played against the best one; the position after it is the next one of the table."""
    return compare_moves(df, df.groupBy("pos_id").agg(F.max_by("move", F.struct("multipv", "l_partkey", "l_suppkey", "move", "score")).alias("user_move")).withColumn("after_id", F.col("pos_id") + 1))


def compare_moves(lines: DataFrame, played: DataFrame) -> DataFrame:
    """``played`` (pos_id, user_move, after_id) with the best move, the loss in centipawns (not clamped; 0 where one side is a
    mate) and in the probability to win, and the class of the move.

    The first line of the position after the move is seen by the other side: its score is turned round, and its losses are
    what the mover wins.
    """
    first = F.min_by(F.struct("score_type", "score", "win", "move"), F.struct("multipv", "l_partkey", "l_suppkey", "move", "score"))
    best = lines.groupBy("pos_id").agg(first.alias("b"))
    answer = best.select(F.col("pos_id").alias("after_id"), F.col("b").alias("a"))
    rows = played.join(best, "pos_id").join(answer, "after_id")
    lost = 1000 - F.col("a.win") - F.floor((1000 - F.col("a.win")) / 2)
    chance = lambda kind, score, win: F.coalesce(win / 1000.0, F.when(kind == "mate", (score > 0).cast("double")).otherwise(0.5 + 0.5 * (2 / (1 + F.exp(-0.00368208 * score)) - 1)))
    both = (F.col("b.score_type") == "cp") & (F.col("a.score_type") == "cp")
    cp_loss = F.when(both, F.col("b.score") + F.col("a.score")).otherwise(0).cast("long")
    wp_loss = F.round(chance(F.col("b.score_type"), F.col("b.score"), F.col("b.win")) - chance(F.col("a.score_type"), -F.col("a.score"), lost), 4) + 0.0
    kind = F.when(F.col("user_move") == F.col("b.move"), "Best").otherwise(move_class(F.col("cp_loss"), "compare"))
    return rows.withColumn("cp_loss", cp_loss).select("pos_id", "user_move", F.col("b.move").alias("best_move"), "cp_loss", wp_loss.alias("wp_loss"), kind.alias("class"))


@engine_query("e05_move_classes", f"SELECT {KEY}, {class_sql('(500 - score)', 'verifier')} AS verifier, {class_sql('(500 - score)', 'data')} AS data, {class_sql('(500 - score)', 'server')} AS server FROM LINES")
def move_classes(df):
    loss = 500 - F.col("score")
    return df.select(*KEYS, *(move_class(loss, v).alias(v) for v in ("verifier", "data", "server")))


#: Eval labels: from these scores on (or above them) white's view reads so (fixed values).
LABELS = {"rewards": (300, 100, -100, -300), "tools": (299, 100, -101, -301), "data": (199, 59, -61, -201)}
WORDS = ("winning for white", "good for white", "equal", "good for black", "winning for black")


def eval_label(cp: Column, variant: str) -> Column:
    a, b, c, d = LABELS[variant]
    return F.when(cp > a, WORDS[0]).when(cp > b, WORDS[1]).when(cp > c, WORDS[2]).when(cp > d, WORDS[3]).otherwise(WORDS[4])


def label_sql(cp: str, variant: str) -> str:
    return "CASE " + " ".join(f"WHEN {cp} > {x} THEN '{w}'" for x, w in zip(LABELS[variant], WORDS)) + f" ELSE '{WORDS[4]}' END"


@engine_query("e06_eval_labels", f"SELECT {KEY}, " + ", ".join(f"{label_sql(f'({CP_SQL})', v)} AS {v}" for v in LABELS) + " FROM LINES")
def eval_labels(df):
    return df.select(*KEYS, *(eval_label(effective_cp(), v).alias(v) for v in LABELS))


@engine_query("e07_label_distance", f"SELECT {KEY}, abs(list_position({list(WORDS)}, {label_sql(f'({CP_SQL})', 'rewards')}) - 3) AS distance FROM LINES")
def label_distance(df):
    place = F.array_position(F.array(*map(F.lit, WORDS)), eval_label(effective_cp(), "rewards"))
    return df.select(*KEYS, F.abs(place - 3).cast("int").alias("distance"))


#: Terms of a static evaluation, in the order of their vector (fixed values).
TERMS = ("Material", "Imbalance", "Pawns", "Knights", "Bishops", "Rooks", "Queens", "Mobility", "King safety", "Threats", "Passed", "Space", "Winnable")


def term_vector() -> Column:
    """White less black per term, in TERMS order. Both are hundredths, so one division gives the difference to its last place,
    and nothing is left to round to the 4 places that a vector has."""
    one = lambda i: (((F.col("l_partkey") * (i + 3)) % 401) - ((F.col("l_suppkey") * (i + 5)) % 397)) / 100.0
    return F.array(*map(one, range(len(TERMS))))


TERMS_SQL = "[" + ", ".join(f"round(((l_partkey * {i + 3}) % 401) / 100.0 - ((l_suppkey * {i + 5}) % 397) / 100.0, 4)" for i in range(len(TERMS))) + "]"


@engine_query("e08_term_vector", f"SELECT {KEY}, t AS terms, round(list_sum(t), 4) AS total FROM (SELECT *, {TERMS_SQL} AS t FROM LINES)")
def terms(df):
    rows = df.withColumn("terms", term_vector())
    return rows.select(*KEYS, "terms", F.round(F.aggregate("terms", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@engine_query("e09_term_diff", f"SELECT {KEY}, list_transform(list_zip(t, lag(t) OVER w), lambda z: round((z[1] - coalesce(z[2], 0)) * CASE WHEN multipv % 2 = 0 THEN 1 ELSE -1 END, 2) + 0.0) AS diff FROM (SELECT *, {TERMS_SQL} AS t FROM LINES) WINDOW w AS (PARTITION BY pos_id ORDER BY multipv, l_partkey, l_suppkey)")
def term_diff(df):
    """Change against the line before, seen by the mover."""
    before = F.lag("terms").over(Window.partitionBy("pos_id").orderBy("multipv", "l_partkey", "l_suppkey"))
    rows = df.withColumn("terms", term_vector()).withColumn("before", before)
    sign = F.when(F.col("multipv") % 2 == 0, 1).otherwise(-1)
    zero = F.array_repeat(F.lit(0.0), len(TERMS))
    return rows.select(*KEYS, F.zip_with("terms", F.coalesce("before", zero), lambda a, b: F.round((a - b) * sign, 2) + 0.0).alias("diff"))


def notable(least: float, first: int) -> Column:
    """`Term +d` of the largest changes, by (size, name) descending."""
    term = lambda i: F.get("terms", F.lit(i))
    # Small terms are nulls in generated code, and leave before the sort.
    named = F.array(*(F.when(F.abs(term(i)) >= least, F.struct(F.abs(term(i)).alias("size"), F.lit(n).alias("name"), term(i).alias("v"))) for i, n in enumerate(TERMS)))
    top = F.slice(F.sort_array(F.array_compact(named), asc=False), 1, first)
    return F.array_join(F.transform(top, lambda x: F.concat(x["name"], F.lit(" "), F.format_string("%+.2f", x["v"]))), "; ")


def notable_sql(least: float, first: int) -> str:
    items = f"list_transform(range(1, {len(TERMS) + 1}), lambda i: {{'size': abs(t[i]), 'name': {list(TERMS)}[i], 'v': t[i]}})"
    top = f"list_reverse(list_sort(list_filter({items}, lambda x: x.size >= {least})))[1:{first}]"
    return f"array_to_string(list_transform({top}, lambda x: x.name || ' ' || CASE WHEN x.v >= 0 THEN '+' ELSE '-' END || printf('%.2f', abs(x.v))), '; ')"


@engine_query("e10_notable_terms", f"SELECT {KEY}, {notable_sql(0.05, 5)} AS summary FROM (SELECT *, {TERMS_SQL} AS t FROM LINES)")
def notable_terms(df):
    return df.withColumn("terms", term_vector()).select(*KEYS, notable(0.05, 5).alias("summary"))


@engine_query("l02_top_terms", f"SELECT {KEY}, {notable_sql(0.10, 3)} AS top FROM (SELECT *, {TERMS_SQL} AS t FROM LINES)")
def top_terms(df):
    return df.withColumn("terms", term_vector()).select(*KEYS, notable(0.10, 3).alias("top"))


@engine_query("e11_annotated_move", f"SELECT {KEY}, move || CASE WHEN s = '' THEN ' (no notable term changes)' ELSE ' [' || replace(s, '-', '−') || ']' END AS text FROM (SELECT *, {notable_sql(0.10, 3)} AS s FROM (SELECT *, {TERMS_SQL} AS t FROM LINES))")
def annotated(df):
    rows = df.withColumn("terms", term_vector()).withColumn("s", notable(0.10, 3))
    return rows.select(*KEYS, F.concat("move", F.when(F.col("s") == "", " (no notable term changes)").otherwise(F.concat(F.lit(" ["), F.replace("s", F.lit("-"), F.lit("−")), F.lit("]")))).alias("text"))


def dominant() -> Column:
    """The term of the largest size (the first of equals), null below 0.1."""
    sizes = F.transform("terms", lambda x: F.abs(x))
    at = F.array_position(sizes, F.array_max(sizes)).cast("int") - 1
    return F.when(F.array_max(sizes) >= 0.1, F.concat(F.get(F.array(*map(F.lit, TERMS)), at), F.lit(" favours "), F.when(F.get("terms", at) > 0, "white").otherwise("black")))


_DOM = f"list_position(list_transform(t, lambda x: abs(x)), list_max(list_transform(t, lambda x: abs(x))))"


@engine_query("q20_dominant_term", f"SELECT {KEY}, CASE WHEN list_max(list_transform(t, lambda x: abs(x))) >= 0.1 THEN {list(TERMS)}[{_DOM}] || ' favours ' || CASE WHEN t[{_DOM}] > 0 THEN 'white' ELSE 'black' END END AS answer FROM (SELECT *, {TERMS_SQL} AS t FROM LINES)")
def dominant_term(df):
    return df.withColumn("terms", term_vector()).select(*KEYS, dominant().alias("answer"))


#: Tiers of an evaluation in pawns: lower bounds (fixed values).
TIERS = ((2.5, "white is winning"), (1.0, "white is clearly better"), (0.3, "white is slightly better"), (-0.3, "approximately equal"), (-1.0, "black is slightly better"), (-2.5, "black is clearly better"))


@engine_query("q19_eval_tier", f"SELECT {KEY}, CASE " + " ".join(f"WHEN score / 100.0 >= {x} THEN '{w}'" for x, w in TIERS) + " ELSE 'black is winning' END AS tier, greatest(-500, least(500, round_even(score / 100.0, 0) * 100))::BIGINT AS cp FROM LINES")
def eval_tier(df):
    pawns = F.col("score") / 100.0
    out = F.when(pawns >= TIERS[0][0], TIERS[0][1])
    for x, w in TIERS[1:]:
        out = out.when(pawns >= x, w)
    return df.select(*KEYS, out.otherwise("black is winning").alias("tier"), F.greatest(F.lit(-500), F.least(F.lit(500), F.bround(pawns, 0) * 100)).cast("long").alias("cp"))


@engine_query("e13_line_selection", f"SELECT {KEY} FROM (SELECT *, row_number() OVER (PARTITION BY pos_id ORDER BY multipv, l_partkey, l_suppkey) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY pos_id, move ORDER BY multipv, l_partkey, l_suppkey) AS again FROM LINES) WHERE again = 1) WHERE rn <= 2")
def line_selection(df, lines=2):
    order = ("multipv", "l_partkey", "l_suppkey")
    first = df.withColumn("again", F.row_number().over(Window.partitionBy("pos_id", "move").orderBy(*order))).where("again = 1")
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("pos_id").orderBy(*order))).where(F.col("rn") <= lines).select(*KEYS)


@engine_query("e19_tree", "WITH l AS (SELECT pos_id, multipv, min(move) AS move FROM LINES WHERE multipv <= 3 GROUP BY 1, 2) SELECT a.pos_id, a.move || ' ' || b.move || ' ' || c.move AS path FROM l a JOIN l b ON b.pos_id = a.pos_id + a.multipv JOIN l c ON c.pos_id = b.pos_id + b.multipv")
def tree(df, width=3):
    """Paths of three levels: the position after a line is another row of the table; two equi-joins."""
    lines = df.where(F.col("multipv") <= width).groupBy("pos_id", "multipv").agg(F.min("move").alias("move")).withColumn("after", F.col("pos_id") + F.col("multipv"))
    level = lambda n: lines.select(*(F.col(c).alias(f"{c}{n}") for c in lines.columns))
    two = level(1).join(level(2), F.col("after1") == F.col("pos_id2"))
    return two.join(level(3), F.col("after2") == F.col("pos_id3")).select(F.col("pos_id1").alias("pos_id"), F.concat_ws(" ", "move1", "move2", "move3").alias("path"))


@engine_query("e22_correction", f"SELECT {KEY}, 'The move is a ' || lower({class_sql('(500 - score)', 'verifier')}) || '; it loses ' || (500 - score) || ' centipawns.' AS text FROM LINES")
def correction(df):
    loss = 500 - F.col("score")
    return df.select(*KEYS, F.concat(F.lit("The move is a "), F.lower(move_class(loss, "verifier")), F.lit("; it loses "), loss.cast("string"), F.lit(" centipawns.")).alias("text"))


@engine_query("e23_template_comment", f"SELECT {KEY}, CASE {class_sql('(500 - score)', 'verifier')} WHEN 'Best' THEN 'The strongest choice.' WHEN 'Great' THEN 'Nearly the strongest.' WHEN 'Good' THEN 'Sound.' WHEN 'Inaccuracy' THEN 'There was better.' WHEN 'Mistake' THEN 'This hurts.' ELSE 'This loses much.' END AS text FROM LINES")
def template(df):
    c = move_class(500 - F.col("score"), "verifier")
    return df.select(*KEYS, F.when(c == "Best", "The strongest choice.").when(c == "Great", "Nearly the strongest.").when(c == "Good", "Sound.").when(c == "Inaccuracy", "There was better.").when(c == "Mistake", "This hurts.").otherwise("This loses much.").alias("text"))
